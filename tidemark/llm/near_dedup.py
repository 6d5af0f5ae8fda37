"""Near-duplicate groups by a multi-index Hamming join of MinHash signatures.

A signature has ``CHUNKS * WIDTH`` symbols of 16 bits. Split into chunks, two signatures
that differ in fewer than ``CHUNKS * (ERRORS + 1)`` symbols agree, by pigeonhole, on some
chunk but for at most ``ERRORS`` symbols; so each chunk is indexed once for every symbol
that may be wrong, without that symbol, and all pairs under the threshold meet in a key.

Texts with equal shingle sets are one class from the start. Classes that share a key are
candidates if their signatures differ in few enough symbols; candidates form clusters,
found by connected components over a spanning forest of each key. In a key of very many
classes, which are mostly copies, all are tied to the least, whatever their distance. Whole shingle sets are then compared exactly, star first: the
members of a cluster meet in blocks of bounded size, its least class in each of them. Only
members that no chain of links in their block ties to it are left, and these alone meet
every other block of their cluster. So every link that may join two groups is seen, and a
cluster of copies costs what its members cost, not their pairs. A block reports a spanning
forest of its links, and components of these are the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytescan as B
from tidemark.llm.shared import components, cut, partitions, spread_join, written

U64 = np.uint64
CHUNKS, WIDTH, ERRORS = 10, 6, 1
SYMBOLS = CHUNKS * WIDTH
#: Signatures that differ in at most this many symbols always share a key.
REACH = CHUNKS * (ERRORS + 1) - 1
#: Classes and shingles of a block, about, and columns of an incidence matrix.
BLOCK, BLOCK_SHINGLES, SLAB = 256, 1 << 20, 4096
#: Candidates differ in at most this many symbols. A pair at a similarity of 0.8 differs in more with a chance of 4e-7.
NEAR = 29
#: Classes of a key up to which signatures are compared.
COMPARED = 512

_RNG = np.random.default_rng(5)
_FLIP = _RNG.integers(1, 2**63, SYMBOLS, dtype=U64)
_SPREAD = _RNG.integers(1, 2**62, SYMBOLS, dtype=U64) * U64(2) + U64(1)


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of SYMBOLS 16-bit symbols for the shingle sets; a row of zeros for an empty set."""
    out = np.zeros((len(offsets) - 1, SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    for k in range(SYMBOLS if len(full) else 0):
        x = (h ^ _FLIP[k]) * _SPREAD[k]
        out[full, k] = (B.mix(np.minimum.reduceat(x, offsets[full])) & U64(0xFFFF)).astype(np.uint16)
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """The index keys of each signature: one for every chunk and symbol left out of it."""
    s = signature.reshape(-1, CHUNKS, WIDTH).astype(U64)
    out = np.empty((len(s), CHUNKS * WIDTH), U64)
    for c in range(CHUNKS):
        for gone in range(WIDTH):
            k = np.full(len(s), c * WIDTH + gone + 1, U64)
            for j in range(WIDTH):
                if j != gone:
                    k = B.mix(k * U64(0x10001) + s[:, c, j])
            out[:, c * WIDTH + gone] = k
    return out


def _sketch(shingle: int):
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in B.text_slices(batch["text"]):
                h, at = B.shingle_sets(B.Words(data, offsets, lower=True), shingle)
                raw = memoryview(h.tobytes())
                digest = np.frombuffer(b"".join(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at.tolist(), at[1:].tolist())), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({
                    "id": batch["id"].slice(i, j - i),
                    "n": pa.array(np.diff(at), pa.int64()),
                    "high": pa.array(digest[:, 0]), "low": pa.array(digest[:, 1]),
                    "signature": B.binary([x.tobytes() for x in signatures(h, at)]),
                })

    return run


def _index(batches):
    for batch in batches:
        s = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        flat = pa.array(keys(s).view(np.int64).ravel())
        yield pa.RecordBatch.from_pydict({"rep": pa.array(np.repeat(np.asarray(batch["rep"]), SYMBOLS)), "key": flat})


def _low_bytes(batches):
    """The low byte of each symbol of a signature."""
    for batch in batches:
        s = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint16).astype(np.uint8).reshape(-1, SYMBOLS)
        yield pa.RecordBatch.from_pydict({"rep": batch["rep"], "low": B.binary([x.tobytes() for x in s])})


def _close(reps: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of a key's classes whose signatures differ in at most NEAR symbols."""
    label = _labels(reps, np.stack([(s != row).sum(1) <= NEAR for row in s]))
    tied = reps != label
    return reps[tied], label[tied]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not the least of its component, with that least node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = np.split(place, 2)
    label = np.arange(len(nodes))
    while True:
        best, low = label.copy(), np.minimum(label[i], label[j])
        for x in (i, j, label[i], label[j]):
            np.minimum.at(best, x, low)
        best = best[best]
        if (best == label).all():
            tied = label != np.arange(len(nodes))
            return nodes[tied], nodes[label[tied]]
        label = best


def _candidates(table: pa.Table) -> pa.Table:
    """Edges (a, b) that span what the keys of a group tie together: classes that may be near."""
    key, rep = table["key"].to_numpy(), table["rep"].to_numpy()
    s = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(-1, SYMBOLS)
    order = np.lexsort((rep, key))
    key, rep, s = key[order], rep[order], s[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    two = start[size == 2]  # most keys
    two = two[(s[two] != s[two + 1]).sum(1) <= NEAR]
    found = [(rep[two + 1], rep[two])]
    for at, n in zip(start[size > 2], size[size > 2]):
        found.append(_close(rep[at : at + n], s[at : at + n]))
    a, b = (np.concatenate(x) for x in zip(*found))
    a, b = _stars(a, b)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets(shingle: int, names: list[str]):
    """Shingle sets in place of texts; the named columns stay."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in B.text_slices(batch["text"]):
                h, at = B.shingle_sets(B.Words(data, offsets, lower=True), shingle)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), B.binary([h[a:b].tobytes() for a, b in zip(at, at[1:])])], [*names, "shingles"])

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, a slab of shingles at a time."""
    if len(left) == len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    whole = np.concatenate([*left, *right])
    values, column = np.unique(whole, return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, len(values), SLAB):
        i, j = np.searchsorted(column, (at, at + SLAB))
        x = np.zeros((len(left) + len(right), min(SLAB, len(values) - at)), np.float32)
        x[row[i:j], column[i:j] - at] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return np.rint(out).astype(np.int64)


def _labels(reps: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least rep of its component."""
    label = reps.copy()
    while True:
        best = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (best == label).all():
            return label
        label = best


def _linked(sizes_a: np.ndarray, sizes_b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return (100 * both >= percent * (sizes_a[:, None] + sizes_b[None, :] - both)) & (both > 0)


def _by_cluster(table: pa.Table):
    """(cluster, reps, sides, shingle sets) of a group's clusters in turn."""
    cluster, rep, side = (table[c].to_numpy() for c in ("cluster", "rep", "side"))
    sets = [np.frombuffer(x, U64) for x in table["shingles"].to_pylist()]
    order = np.argsort(cluster, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1) if len(order) else ():
        yield cluster[own[0]], rep[own], side[own], [sets[k] for k in own]


def _rows(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def _inside(percent: int):
    """Links of the members of a block; a loop (a, a) tells of a member that is not tied to its cluster's least class."""

    def run(table: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        for star, reps, _, sets in _by_cluster(table):
            sizes = np.array([len(s) for s in sets])
            label = _labels(reps, _linked(sizes, sizes, _shared(sets, sets), percent))
            found += [(int(r), int(x)) for r, x in zip(reps, label) if r != x]
            found += [(int(r), int(r)) for r, x in zip(reps, label) if x != star]
        return _rows(found)

    return run


def _across(percent: int):
    """Links between the members that are left (side 0) and another block (side 1)."""

    def run(table: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        for _, reps, side, sets in _by_cluster(table):
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(a) and len(b):
                left, right = [sets[k] for k in a], [sets[k] for k in b]
                linked = _linked(np.array([len(s) for s in left]), np.array([len(s) for s in right]), _shared(left, right), percent)
                linked &= reps[a][:, None] != reps[b][None, :]
                square = np.zeros((len(reps), len(reps)), bool)
                square[np.ix_(a, b)] = linked
                label = _labels(reps, square | square.T)
                found += [(int(r), int(x)) for r, x in zip(reps, label) if r != x]
        return _rows(found)

    return run


def _blocks() -> Column:
    """How many blocks the classes of a group fill."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept) for every row of docs.

    A set holds the distinct ``shingle``-word windows of the text, A-Z lower-cased; fewer
    words give one window of all. Rows link when 100 * intersection >= percent * union;
    component_id is the least id that links reach and kept says that it is the row's own.

    Null and empty texts have no shingles and no links. Ids are integers; rows of one id
    are one document; a row without an id links with nothing and has a null component and
    kept false. Ties do not arise, copies of a row fall in one component, an empty table
    gives no rows, other columns are ignored. A key holds a class at most once and a class
    has 60 keys, so one key has at most a sixtieth of the rows that are dealt.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sketch = cut(rows.mapInArrow(_sketch(shingle), "id long, n long, high long, low long, signature binary"))
    named = sketch.where("id is not null and n > 0")
    classes = cut(named.groupBy("high", "low", "n").agg(F.min("id").alias("rep"), F.max("signature").alias("signature")))

    index = classes.select("rep", "signature").mapInArrow(_index, "rep long, key long")
    met = index.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    met = cut(met.withColumn("many", F.col("n") > COMPARED))
    shared = cut(spread_join(index, met, "key", "rep", SYMBOLS * classes.count()))
    # The low bytes of the symbols differ in no more places than the symbols do.
    low = classes.mapInArrow(_low_bytes, "rep long, low binary")
    few = shared.where("not many").join(low, "rep").withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(16 * parts)))
    edges = few.select("bin", "key", "rep", "low").groupBy("bin").applyInArrow(_candidates, "a long, b long")
    edges = edges.union(shared.where("many").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    links = _links(rows, classes, components(edges).withColumnsRenamed({"node": "rep", "component": "cluster"}), shingle, percent)

    joined = components(links).withColumnsRenamed({"node": "rep"})
    known = classes.select("high", "low", "n", "rep").join(joined, "rep", "left").select("high", "low", "n", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("id", "n", "high", "low").join(known, ["high", "low", "n"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _links(rows: DataFrame, classes: DataFrame, clusters: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of classes that span the groups inside each cluster."""
    parts = partitions(rows.sparkSession)
    clusters = cut(clusters.join(classes.select("rep", "n"), "rep"))
    sized = clusters.groupBy("cluster").agg(_blocks().alias("blocks"), F.count("*").alias("members")).withColumnRenamed("members", "n")
    clusters = cut(spread_join(clusters.withColumnRenamed("n", "size"), sized, "cluster", "rep", clusters.count()))
    clusters = clusters.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    # Texts are dealt once, and what is compared later reads the members' sets only.
    texts = rows.join(clusters, rows["id"] == clusters["rep"]).select("rep", "cluster", "blocks", "block", "text")
    shape = "rep long, cluster long, blocks int, block int, shingles binary"
    members = written(texts.mapInArrow(_sets(shingle, ["rep", "cluster", "blocks", "block"]), shape), "sets")

    # The least class of a cluster goes to each of its blocks, any other class to its own.
    at = F.when(F.col("rep") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = members.withColumn("block", F.explode(at))
    small = F.col("blocks") == 1
    dealt = dealt.select(
        F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(16 * parts))).otherwise(F.col("cluster")).alias("bin"),
        F.when(small, -1).otherwise(F.col("block")).alias("at"), "rep", "cluster", F.lit(0).alias("side"), "shingles",
    )
    links = cut(dealt.groupBy("bin", "at").applyInArrow(_inside(percent), "a long, b long"))
    left = links.where("a = b").select(F.col("a").alias("rep")).distinct().join(clusters.where("blocks > 1").select("rep", "cluster", "blocks", F.col("size").alias("n")), "rep")
    left = cut(left)
    if left.isEmpty():
        return links
    lots = left.groupBy("cluster").agg(_blocks().alias("lots"))
    left = left.join(lots, "cluster").withColumn("lot", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("lots")).cast("int"))
    large = members.where("blocks > 1")
    own = left.join(large.select("rep", "shingles"), "rep")
    own = own.select("rep", "cluster", F.lit(0).alias("side"), F.array("lot").alias("lots"), F.sequence(F.lit(0), F.col("blocks") - 1).alias("at"), "shingles")
    other = large.join(lots, "cluster").select("rep", "cluster", F.lit(1).alias("side"), F.sequence(F.lit(0), F.col("lots") - 1).alias("lots"), F.array("block").alias("at"), "shingles")
    dealt = own.unionByName(other).withColumn("lot", F.explode("lots")).withColumn("at", F.explode("at"))
    return links.union(dealt.select("cluster", "lot", "at", "rep", "side", "shingles").groupBy("cluster", "lot", "at").applyInArrow(_across(percent), "a long, b long"))


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of docs but for those that link to a smaller id; rows without an id stay. All columns stay."""
    found = near_duplicates(docs, id_column, text_column, **options)
    gone = found.where(F.col("component_id") < F.col(id_column)).select(id_column).distinct()
    return docs.join(gone, id_column, "left_anti").select(*docs.columns)
