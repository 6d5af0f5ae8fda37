"""Centroids, vector codes and source mixing against plain Python, ties, edges and repeats."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import oracle
import pytest
from brute import WORD

from tidemark.llm import clustering, mixing, queries, vector_codes, whole_vectors

PLANS, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_source_mixing", "op13_vector_codes"])
def test_queries_give_the_rows_of_their_sql(spark, folder, name):
    assert oracle.compare(spark, PLANS[name], SQL[name], folder) == ""


def whole(v, d):
    if v is None or len(v) != d or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(1024 * x) for x in v]


def lloyd(rows, centres, rounds):
    """(centres, label and squared distance of each row) in Python's whole numbers."""
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        label = [min((far(x, c), k) for k, c in enumerate(centres)) for x in rows]
        if turn < rounds:
            for k in range(len(centres)):
                own = [x for x, (_, j) in zip(rows, label) if j == k]
                if own:
                    centres = [*centres[:k], [sum(c) // len(own) for c in zip(*own)], *centres[k + 1 :]]
    return centres, [(j, d) for d, j in label]


def vectors(rng, n, d, step):
    """Few distinct values, so that there are many ties; and rows that have no place."""
    rows = [(rng.choice([None, rng.randrange(n)]) if rng.random() < 0.1 else k, [rng.randrange(-3, 4) * step * rng.choice((1, 1, 4)) for _ in range(d)], rng.choice(["a", "b", None])) for k in range(n)]
    rows += rows[:5]
    bad = [None, [], [0.5] * (d - 1), [0.5] * (d + 1), [None] + [0.5] * (d - 1), [float("nan")] + [0.5] * (d - 1), [float("-inf")] + [0.5] * (d - 1)]
    return rows + [(1000 + k, v, "b") for k, v in enumerate(bad)]


@pytest.mark.parametrize("seed", range(2))
def test_clusters_are_those_of_plain_rounds(spark, seed):
    rng = random.Random(seed)
    rows = vectors(rng, 60, 4, 0.37)
    found, centroids = clustering.cluster(spark.createDataFrame([(i, v, c, 1) for i, v, c in rows], "vec_id long, embedding array<double>, cluster string, hint int"), clusters=5, rounds=3, dimension=4, salt=3)
    kept = [(i, q) for i, v, _ in rows if (q := whole(v, 4)) is not None]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centres, label = lloyd([q for _, q in kept], [q for _, q in order[:5]], 3)
    inertia = [sum(d for j, d in label if j == k) for k in range(5)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    want = [(i, j, d, inertia[j], sum(inertia), sha[j]) for (i, _), (j, d) in zip(kept, label)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr) and centroids.tolist() == centres


def test_an_annulus_holds_all_nearest_and_few_others():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-50, 50, (40, 8)) * rng.integers(1, 40, (40, 1))
    centroids[7] = centroids[3]
    x = centroids[rng.integers(0, 40, 3000)] + rng.integers(-3, 4, (3000, 8))
    x[:40] = (centroids + centroids[::-1]) // 2  # on boundaries, if even
    full = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    a = clustering.Annulus(centroids)
    for hint in (rng.integers(0, 40, 3000), full.argmin(1), a.by_norm(x)):
        label, best, taken = a.nearest(x, hint)
        assert (label == full.argmin(1)).all() and (best == full.min(1)).all()
    assert a.nearest(x, full.argmin(1))[2] < 0.3 * full.size


def test_few_vectors_and_none(spark):
    shape = "vec_id long, embedding array<float>, label int"
    none = spark.createDataFrame([], shape)
    assert clustering.cluster(none)[0].collect() == [] and vector_codes.compress(none)[0].collect() == []
    two = spark.createDataFrame([(2, [1.0] * 64, None), (1, [0.5] * 64, 4)], shape)
    assert {(r.vec_id, r.distance, r.inertia) for r in clustering.cluster(two)[0].collect()} == {(1, 0, 0), (2, 0, 0)}
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.compress(two)[0].collect()} == {(1, "00000000", 0, 0), (2, "01010101", 0, 0)}
    huge = spark.createDataFrame([(1, [1e30] * 64, 1)], shape)
    with pytest.raises(Exception, match="do not fit"):
        clustering.cluster(huge)


@pytest.mark.parametrize("seed", range(2))
def test_codes_are_those_of_plain_rounds(spark, seed):
    rng = random.Random(seed)
    rows = vectors(rng, 80, 8, 0.37)
    found, books = vector_codes.compress(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string, codes string"), parts=4, entries=6, rounds=3, dimension=8)
    kept = [(i, q, c) for i, v, c in rows if (q := whole(v, 8)) is not None]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0], np.array(r[1], "<i4").tobytes()))[:6]
    runs = [lloyd([q[2 * p : 2 * p + 2] for _, q, _ in kept], [q[2 * p : 2 * p + 2] for _, q, _ in start], 3) for p in range(4)]
    code = ["".join(f"{run[1][k][0]:02x}" for run in runs) for k in range(len(kept))]
    error = [sum(run[1][k][1] for run in runs) for k in range(len(kept))]
    by_label = {c: sum(e for e, r in zip(error, kept) if r[2] == c) for c in ("a", "b", None)}
    sha = hashlib.sha256(",".join(str(x) for run in runs for c in run[0] for x in c).encode()).hexdigest()
    want = [(i, code[k], error[k], by_label[c], sha) for k, (i, _, c) in enumerate(kept)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert [b.tolist() for b in books] == [run[0] for run in runs]


@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_bounds_spare_scans_and_lose_no_tie(scale):
    rng = np.random.default_rng(2)
    entries = rng.integers(-40, 40, (30, 4)) * scale
    entries[9] = entries[4]
    x = np.concatenate([entries[rng.integers(0, 30, 4000)] + rng.integers(-2, 3, (4000, 4)) * scale, (entries[:15] + entries[15:]) // 2])
    book = vector_codes.Codebook(entries)
    code, upper, lower = book.scan(x)
    scans = []
    for _ in range(6):
        full = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
        assert (code == full.argmin(1)).all()
        assert (upper >= np.sqrt(full.min(1))).all()
        others = np.where(np.arange(len(entries)) == code[:, None], np.inf, full).min(1)
        assert (lower <= np.sqrt(others)).all()
        sums = {k: ((code == k).sum(), x[code == k].sum(0).tolist()) for k in set(code.tolist())}
        book = vector_codes.Codebook(whole_vectors.moved(book.entries, {k: (int(n), s) for k, (n, s) in sums.items()}), book.entries)
        code, upper, lower, n = book.step(x, code, upper, lower)
        scans.append(n)
    assert scans[-1] < len(x) / 4


def shares(sizes, weights, most):
    """Targets, one source after another taken out where it is above."""
    capped = set()
    while True:
        left = sum(sizes) - sum(most * sizes[k] for k in capped)
        weight = sum(w for k, w in enumerate(weights) if k not in capped)
        out = [Fraction(most * s) if k in capped else Fraction(weights[k] * left, weight) for k, s in enumerate(sizes)]
        new = {k for k, t in enumerate(out) if t > most * sizes[k]}
        if not new:
            return out
        capped |= new


def docs_of(rng, n):
    sources = ["a", "b", "Z", "é", "\U0001f600", "", None, "hot", "hot", "hot", "hot", "tiny", "blank"]
    rows = []
    for k in range(n):
        source = rng.choice(sources)
        words = 0 if source == "blank" else 1 if source == "tiny" else rng.choice((0, 1, 5, rng.randrange(400)))
        rows.append((rng.choice((k, None, 3)), rng.choice((None, "", " \t")) if not words else "x y " * words, source, "own"))
    return rows + rows[:7] + [(n, "w " * 5000, "a", "own")]


def test_a_mix_meets_its_targets(spark):
    rows = docs_of(random.Random(3), 900)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    mixed = mixing.mix(df, carry=["text", "key"])
    got = mixed.collect()
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = lambda t: len(WORD.findall(t or ""))
    sizes = [sum(size(t) for _, t, s, _ in rows if s == name) for name in names]
    target = shares(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    assert len(got) == len(rows) and {r.key for r in got} == {"own"}
    for k, name in enumerate(names):
        own = [r for r in got if r.source == name]
        assert {(r.source_size, round(r.target, 6)) for r in own} == {(sizes[k], round(float(target[k]), 6))}
        assert all(r.size == size(r.text) and r.taken == r.copies * r.size and r.copies in (math.floor(target[k] / sizes[k]), math.ceil(target[k] / sizes[k])) for r in own) if sizes[k] else all(r.taken == 0 for r in own)
        assert abs(sum(r.taken for r in own) - target[k]) <= max(r.size for r in own)
    assert max(r.copies for r in got) == 3
    again = mixing.mix(df.repartition(7), carry=["text", "key"]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.emitted(mixed).count() == sum(r.copies for r in got)
    other = mixing.mix(df, seed=13, carry=["text", "key"]).collect()
    assert sorted(map(repr, got)) != sorted(map(repr, other))


def test_mixes_of_little(spark):
    shape = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], shape)).collect() == []
    empty = mixing.mix(spark.createDataFrame([(1, None, None), (1, "", "a")], shape)).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    one = mixing.mix(spark.createDataFrame([(1, "a b", None)] * 3, shape)).collect()
    assert [(r.target, r.taken) for r in one] == [(6.0, 2)] * 3
    with pytest.raises(ValueError, match="clash"):
        mixing.mix(spark.createDataFrame([(1, "a b", None, 2)], shape + ", taken long"), carry=["taken"])


def test_a_hot_source_is_numbered_in_ranges(spark):
    rows = spark.range(20000).selectExpr("id as doc_id", "'x y' as text", "if(id % 20 = 0, 'b', 'a') as source")
    out = mixing.numbered(rows, "source", "text")
    assert [r[0] for r in out.select("rank").orderBy("rank").collect()] == list(range(20000))
    assert out.where("source = 'a'").agg({"rank": "max"}).first()[0] == 18999
