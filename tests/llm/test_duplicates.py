"""Repeated passages, exact and near duplicates, decontamination: brute force and edge cases."""

import hashlib
import random

import brute
import oracle
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import decontamination, exact_dedup, near_dedup, queries, shared, substring_dedup

SHAPE = "doc_id long, text string, id long, key string, rep long, cluster string, bucket int, chunk int, n long, `row` long, block string"
LONG = " ".join(f"w{k * k * 31 % 30011}" for k in range(30_000))
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two three"), (7, "ONE two three"), (8, LONG), (9, LONG + " end"), (10, "é Ünï x 漢字 \x85"), (11, "É Ünï x 漢字 \x85"), (12, None), (13, "one two three four")]
EXTRA = [0, "k", 1, "c", 2, 3, 4, 5, "b"]


def table(spark, docs):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in docs], SHAPE)


def real(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def planted():
    """Copies from two to many, near copies in chains, and a passage that many texts share."""
    rng = random.Random(4)
    name = lambda k: "".join(chr(97 + (k * 31 + j * 7) % 26) for j in range(2 + k % 5)) + str(k)
    passage = [name(rng.randrange(400)) for _ in range(60)]
    docs = []
    for k in range(12):
        base = [name(rng.randrange(3000)) for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(rng.choice([1, 2, 25])):
            docs.append(list(base))
            for at in range(0, len(base), 30):
                if rng.random() < 0.4:
                    base[at] = name(rng.randrange(3000))
    docs += [d[: len(d) // 2] + passage + d[len(d) // 2 :] for d in docs[::3]]
    return [(k, " ".join(d)) for k, d in enumerate(docs)]


def test_repeats_on_edges(spark):
    for window in (1, 2, 3, 35):
        want = brute.kept_words([t for _, t in EDGES], window)
        got = {r.doc_id: r for r in substring_dedup.remove_repeats(table(spark, EDGES), window=window).collect()}
        assert len(got) == len(EDGES)
        for (i, _), (words, kept) in zip(EDGES, want):
            assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(words), len(words) - len(kept), " ".join(kept)), (window, i)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25).map(" ".join), max_size=8), st.integers(1, 6))
def test_repeats_by_chance(spark, texts, window):
    found = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=window)
    assert {r.doc_id: r.kept_text for r in found.collect()} == {k: " ".join(kept) for k, (_, kept) in enumerate(brute.kept_words(texts, window))}


def test_repeats_of_the_query(spark, folder):
    docs = real(spark, folder)
    got = {r.doc_id: r for r in queries.op2_substring_dedup(spark, folder).collect()}
    for (i, _), (words, kept) in zip(docs, brute.kept_words([t for _, t in docs], 35), strict=True):
        assert (got[i].n_words, got[i].n_removed) == (len(words), len(words) - len(kept))
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_repeated_rows_and_null_ids(spark):
    docs = [(1, "a b c d"), (1, "a b c d"), (None, "x y z"), (None, None)]
    got = sorted(map(repr, (tuple(r)[:3] for r in substring_dedup.remove_repeats(table(spark, docs), window=3).collect())))
    assert got == sorted(map(repr, [(1, 4, 4), (1, 4, 4), (None, 3, 0), (None, 0, 0)]))
    got = sorted(map(repr, (tuple(r) for r in near_dedup.near_duplicates(table(spark, docs)).collect())))
    assert got == sorted(map(repr, [(1, 1, 1, True), (1, 1, 1, True), (None, 1, None, False), (None, 0, None, False)]))
    exact = exact_dedup.exact_duplicates(table(spark, docs)).collect()
    assert len(exact) == 4 and sorted(r.group_size for r in exact) == [1, 1, 2, 2] and sum(r.kept for r in exact) == 3
    assert exact_dedup.one_of_each_text(table(spark, docs)).count() == 3


@pytest.mark.parametrize("shingle", [1, 2, 5])
def test_near_groups(spark, shingle):
    for docs in (EDGES, planted()):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, docs), shingle=shingle).collect()}
        want = brute.groups(docs, shingle, 80)
        assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_a_cluster_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    docs = planted()
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, docs), shingle=2).collect()}
    assert got == {i: c for i, (_, c) in brute.groups(docs, 2, 80).items()}


def test_near_groups_of_the_query(spark, folder):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_minhash_near_dedup(spark, folder).collect()}
    assert got == brute.groups(real(spark, folder), 2, 80)


def test_chance_neighbours_make_no_clusters(spark, monkeypatch):
    """Texts of a small vocabulary share keys by chance; only what is near becomes a cluster, and every link is found."""
    rng = random.Random(11)
    words = [f"t{k}" for k in range(14)]
    docs = [(k, " ".join(rng.choices(words, k=20))) for k in range(600)]
    docs += [(1000 + k, f"{t} {rng.choice(words)}") for k, t in docs[:40]]
    seen = {}

    def watched(edges, f=near_dedup.components):
        out = f(edges)
        seen.setdefault("sizes", sorted((r["count"] for r in out.groupBy("component").count().collect()), reverse=True))
        return out

    monkeypatch.setattr(near_dedup, "components", watched)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, docs), shingle=1, percent=80).collect()}
    assert got == brute.groups(docs, 1, 80)
    far = [(k, " ".join(rng.choices([f"u{k}" for k in range(110)], k=24))) for k in range(3000)] + [(5000 + k, " ".join(f"x{k}y{j}" for j in range(30))) for k in range(50) for _ in (0, 1)]
    seen.clear()
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, far), shingle=1, percent=80).collect()}
    assert got == {i: c for i, (_, c) in brute.groups(dict(far).items(), 1, 80).items()} and sum(seen["sizes"]) < 300


@pytest.mark.parametrize("compared", [0, 4, 512])
def test_keys_of_many_classes(spark, monkeypatch, compared):
    monkeypatch.setattr(near_dedup, "COMPARED", compared)
    docs = planted()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, docs), shingle=2, percent=80).collect()}
    assert got == brute.groups(docs, 2, 80)


def thue_morse(n):
    """A word and its complement whose polynomial hashes modulo 2**64 agree."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 16, 31, 32, 33, 4096])
def test_patterned_words_are_told_apart(spark, n):
    frame = " ".join(f"w{k}" for k in range(34))
    docs = [(k, f"{frame} {w}") for k, w in enumerate(thue_morse(n))]
    assert {r.n_removed for r in substring_dedup.remove_repeats(table(spark, docs)).collect()} == {0}
    lone = [(k, f"{w} x") for k, w in enumerate(thue_morse(n))]
    assert {r.component_id for r in near_dedup.near_duplicates(table(spark, lone), shingle=2).collect()} == {0, 1}


def test_patterned_sequences_are_told_apart(spark):
    word, other = ("".join(f"{c} " for c in w) for w in thue_morse(4096))
    docs = [(0, word + "end"), (1, other + "stop"), (2, "x " + word[: 2 * 40])]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(table(spark, docs), window=35).collect()}
    want = {i: (len(own), len(own) - len(kept)) for (i, _), (own, kept) in zip(docs, brute.kept_words([t for _, t in docs], 35))}
    assert got == want


def test_short_words_have_digests_of_their_own():
    import numpy as np

    from tidemark.llm import bytescan

    words = sorted({a + b for a in ("a", "b", "\0", "é", "日") for b in ("", "a", "\0", "aa", "a\0", *("a" * k for k in range(3, 40)))})
    raw = " ".join(words).encode()
    found = bytescan.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(found.start) == len(words) == len(set(found.digests().tolist())) == len(set(found.digests(check=True).tolist()))
    for n in (1, 2, 5, 8, 18, 35):
        first, h = found.windows(n)
        assert len(set(h.tolist())) == len(first) == len(words) - n + 1


@pytest.mark.parametrize("one_task", [1 << 17, 1])
def test_components_with_a_hub(spark, monkeypatch, one_task):
    monkeypatch.setattr(shared, "ONE_TASK", one_task)
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1100)] + [(1050, 1050), (7, None)] + [(2000, 399)]
    got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in (*range(400), 2000)} | {k: 1000 for k in range(1000, 1101)}


def test_components_take_few_jobs(spark, monkeypatch):
    """Jobs of a round and plans that hold a step several times are memory of the driver."""
    monkeypatch.setattr(shared, "ONE_TASK", 40)
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1040)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    context, group = spark.sparkContext, "components"
    context.setJobGroup(group, group)
    try:
        got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    least = {x: x for e in edges for x in e}
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {x: c for x, c in least.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert len(context.statusTracker().getJobIdsForGroup(group)) <= 80


def test_components_that_do_not_settle_raise(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        shared.components(spark.createDataFrame([(1, 2)], "a long, b long"))


def test_signatures_within_reach_share_a_key():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dedup.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        b[rng.permutation(near_dedup.SYMBOLS)[: near_dedup.REACH]] += np.uint16(1)
        assert set(near_dedup.keys(a[None]).ravel()) & set(near_dedup.keys(b[None]).ravel())


def test_exact_groups_on_edges(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(table(spark, EDGES)).collect()}
    same = {}
    for i, t in EDGES:
        same.setdefault(brute.low(t), []).append(i)
    assert got == {i: (max(own), len(own), i == max(own), hashlib.sha256(t.encode()).hexdigest()) for t, own in same.items() for i in own}


def test_exact_groups_of_the_query(spark, folder):
    assert oracle.compare(spark, queries.op6_exact_dedup, queries.oracle_sql()["op6_exact_dedup"], folder) == ""


def test_one_of_each_text_with_any_columns(spark):
    shape = "doc_id long, text string, __id string, __sha string, key int, doc string, n long, text_sha256 string"
    rows = [(1, "A b", "p", "q", 1, "d", 2, "s"), (2, "a B", "r", "y", 1, "d", 2, "s"), (2, "a B", "r", "y", 1, "d", 2, "s"), (None, "c", "u", "v", 1, "d", 2, "s"), (3, None, "w", "z", 1, "d", 2, "s"), (4, "", "w2", "z2", 1, "d", 2, "s")]
    for own, want in ((rows, {"y", "v", "z2"}), (rows[:2] + rows[3:], {"y", "v", "z2"}), (rows[1:3], {"y"}), ([], set())):
        df = spark.createDataFrame(own, shape)
        out = exact_dedup.one_of_each_text(df)
        assert out.columns == df.columns and sorted(r["__sha"] for r in out.collect()) == sorted(want)


def test_hot_chunks_and_recipes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(shared, "ONE_TASK", 0)
    docs = [(k, "the same text" if k % 3 else f"text {k % 5} " * 400) for k in range(300)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(table(spark, docs)).collect()}
    own = {}
    for k, t in docs:
        own.setdefault(t, []).append(k)
    assert got == {k: (max(own[t]), len(own[t]), k == max(own[t])) for k, t in docs}


def test_chunks_meet_again_after_an_insertion(spark):
    found = exact_dedup.recipes(table(spark, [(1, LONG), (2, "new words first " + LONG)])).collect()
    one, two = ({c.digest for c in r.chunks} for r in found)
    assert len(one) > 20 and len(one & two) >= len(one) - 2


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_items_on_edges(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", block)
    items = [(1, "one two three four five six seven"), (2, "x"), (3, ""), (4, None), (5, "Five-six"), (6, LONG[:400]), (7, "one two three four five six seven"), (None, "two three four five six"), (None, None)]
    docs = [*EDGES, (20, "a one, two; THREE four five six seven b"), (21, "one two three four five six"), (22, "y x z five six")]
    asked = spark.createDataFrame([(*x, "t", 0) for x in items], "item_id long, text string, id string, width int")
    got = {tuple(r) for r in decontamination.contained_items(table(spark, docs), asked).collect()}
    assert got == brute.contained(docs, items) and (20, None, 1, 1) in got and {(20, 1, 3, 3), (22, 2, 1, 1), (22, 5, 1, 1)} <= got
    left = {r.doc_id for r in decontamination.clean(table(spark, docs), asked).collect()}
    assert left == {i for i, _ in docs} - {i for i, *_ in got}


def test_items_of_the_query(spark, folder):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {tuple(r) for r in queries.op7_decontamination(spark, folder).collect()}
    assert got and got == brute.contained(real(spark, folder), items)


def test_items_that_are_too_many_to_broadcast(spark, folder, monkeypatch):
    docs, items = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    whole = sorted(decontamination.contained_items(docs, items).collect())
    left = sorted(r.doc_id for r in decontamination.clean(docs, items).collect())
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 500)
    assert whole and sorted(decontamination.contained_items(docs, items).collect()) == whole
    assert sorted(r.doc_id for r in decontamination.clean(docs, items).collect()) == left


def test_empty_tables(spark):
    none = table(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == near_dedup.near_duplicates(none).count() == exact_dedup.exact_duplicates(none).count() == 0
    assert near_dedup.one_of_each_group(none).count() == exact_dedup.one_of_each_text(none).count() == 0
    assert decontamination.contained_items(none, items).count() == decontamination.clean(none, items).count() == 0
    assert decontamination.clean(table(spark, EDGES), items).count() == len(EDGES)
