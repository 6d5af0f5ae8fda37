"""Exact substring removal by fixed-block anchors.

Every text is cut into non-overlapping blocks of ``(window + 1) // 2`` words; any repeat
of ``window`` words holds one whole block of the text it repeats. The blocks form the
index. Every rolling window of block length probes it. A hit that also occurs elsewhere
is an anchor; windows of full length around anchors are then compared over the corpus, by
digests of 127 bits, so that hits grow into maximal exact repeats: the union of all windows
found twice.

Texts are dealt into chunks and hashes into buckets, both sized by the corpus, and both
into tasks of bounded size. A chunk sends a bucket its distinct hashes as one packed row,
however often they occur, so a passage that a third of all documents share costs one entry
a chunk; a bucket answers each chunk with the hashes that count. A row has an entry at
least, so rows never outnumber the words of the corpus, and chunks grow with the corpus, up
to a bound, so that rows stay packed. No pairs of documents are made and nothing is gathered
on the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytescan as B
from tidemark.llm.shared import partitions, text_bytes

U64 = np.uint64
#: Bytes of text of a chunk, at least and at most; of the texts behind a bucket; of a task.
CHUNK_BYTES, CHUNK_MOST, BUCKET_BYTES, TASK_BYTES = 16 << 20, 64 << 20, 32 << 20, 96 << 20
#: Bits of a probe that travel beside the bucket it is sent to.
REST = 30
SENT = "chunk long, bucket long, payload binary"


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, byte plane by byte plane, for the shuffle's codec."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return d.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpack(payload: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(payload, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(44)) * U64(buckets)) >> U64(20)


def probe_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(h, buckets) << U64(REST) | (h >> U64(14)) & U64((1 << REST) - 1)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted x with a flag in the lowest bit: distinct values without it, whether several, the flag of any."""
    value = x >> x.dtype.type(1)
    at = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0)
    last = np.append(at[1:], len(x))[: len(at)] - 1
    return value[at], last > at, (x[last] & x.dtype.type(1)).astype(bool)


def _rows(chunk: int, bucket: np.ndarray, values: np.ndarray, second: np.ndarray | None = None) -> pa.Table:
    """One row for each bucket; values, alone or with a second column, are in order of bucket."""
    edges = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]) != 0) if len(bucket) else np.zeros(0, int)
    ends = np.append(edges[1:], len(bucket)).astype(int)
    return pa.table({
        "chunk": pa.array(np.full(len(edges), chunk), pa.int64()),
        "bucket": pa.array(bucket[edges].astype(np.int64), pa.int64()),
        "payload": B.binary([pack(values[i:j]) if second is None else pack_pairs(values[i:j], second[i:j]) for i, j in zip(edges, ends)]),
    })


def _send_probes(block: int, buckets: int):
    def send(docs: pa.Table) -> pa.Table:
        parts = [np.zeros(0, U64)]
        for _, _, data, offsets in B.text_slices(docs["text"]):
            words = B.Words(data, offsets)
            first, h = words.windows(block)
            own = words.rows[np.searchsorted(words.rows, first, "right") - 1]
            parts.append(probe_of(h, buckets) << U64(1) | ((first - own) % block == 0).astype(U64))
        x = np.concatenate(parts)
        x.sort()
        value, several, indexed = _distinct(x)
        flags = several.astype(np.uint32) << np.uint32(1) | indexed.astype(np.uint32)
        rest = (value & U64((1 << REST) - 1)).astype(np.uint32) << np.uint32(2) | flags
        return _rows(docs["chunk"][0].as_py() if len(docs) else 0, value >> U64(REST), rest)

    return send


def pack_pairs(first: np.ndarray, second: np.ndarray) -> bytes:
    """Two columns of equal length, the first one sorted."""
    return pack(first) + second.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(payload) // 2
    return unpack(payload[:half], U64), np.ascontiguousarray(np.frombuffer(payload[half:], np.uint8).reshape(8, -1).T).view(U64).ravel()


def _reply(sent: pa.Table, replies: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({
        "chunk": pa.array([c for c, _ in replies], pa.int64()),
        "bucket": pa.array([sent["bucket"][0].as_py()] * len(replies), pa.int64()),
        "payload": B.binary([p for _, p in replies]),
    })


def _anchors(sent: pa.Table) -> pa.Table:
    """Tells each chunk which of its probes meet an indexed block elsewhere."""
    chunks, payloads = sent["chunk"].to_pylist(), [unpack(x, np.uint32) for x in sent["payload"].to_pylist()]
    x, ends = np.concatenate(payloads), np.cumsum([len(p) for p in payloads])
    value = x >> np.uint32(2)
    order = np.argsort(value, kind="stable")
    at = np.flatnonzero(np.diff(value[order], prepend=~value[order[:1]]) != 0)
    n = np.diff(np.append(at, len(x)))
    flags = np.bitwise_or.reduceat(x[order] & np.uint32(3), at)
    good = np.zeros(len(x), bool)
    good[order] = np.repeat((flags & 1 > 0) & ((n > 1) | (flags & 2 > 0)), n)
    return _reply(sent, [(c, pack(np.unique(value[i:j][good[i:j]]))) for c, i, j in zip(chunks, np.append(0, ends[:-1]), ends) if good[i:j].any()])


def _twice(sent: pa.Table) -> pa.Table:
    """Tells each chunk which of its windows stand elsewhere too."""
    chunks, pairs = sent["chunk"].to_pylist(), [unpack_pairs(x) for x in sent["payload"].to_pylist()]
    first, second = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    ends = np.cumsum([len(p) for p, _ in pairs])
    value = first >> U64(1)
    order = np.lexsort((second, value))
    new = np.ones(len(value), bool)
    new[1:] = (np.diff(value[order]) != 0) | (np.diff(second[order]) != 0)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(value)))
    several = np.bitwise_or.reduceat(first[order] & U64(1), at) > 0
    good = np.zeros(len(value), bool)
    good[order] = np.repeat((n > 1) | several, n)
    return _reply(sent, [(c, pack_pairs(value[i:j][good[i:j]], second[i:j][good[i:j]])) for c, i, j in zip(chunks, np.append(0, ends[:-1]), ends) if good[i:j].any()])


def _member(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def _member_pairs(first: np.ndarray, second: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) are among (first, second), in order of both."""
    found = np.zeros(len(x), bool)
    at = np.searchsorted(first, x)
    open_ = np.arange(len(x))
    while len(open_):
        open_ = open_[at[open_] < len(first)]
        open_ = open_[first[at[open_]] == x[open_]]
        found[open_] = second[at[open_]] == y[open_]
        open_ = open_[~found[open_]]
        at[open_] += 1
    return found


def _send_windows(block: int, window: int, buckets: int):
    def send(docs: pa.Table, hits: pa.Table) -> pa.Table:
        anchors = np.concatenate([np.zeros(0, U64), *(unpack(p, np.uint32).astype(U64) | U64(b) << U64(REST) for b, p in zip(hits["bucket"].to_pylist(), hits["payload"].to_pylist()))])
        anchors.sort()
        what, other = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for _, _, data, offsets in B.text_slices(docs["text"]) if len(anchors) else ():
            words = B.Words(data, offsets)
            first, h = words.windows(block)
            seen = np.zeros(len(words.start) + 1, np.int64)
            seen[first + 1] = _member(anchors, probe_of(h, buckets))
            seen = np.cumsum(seen)
            first, h = words.windows(window)
            near = seen[first + window - block + 1] > seen[first]
            if near.any():
                other.append(h[near])
                what.append(words.windows(window, check=True)[1][near] >> U64(1))
        what, other = np.concatenate(what), np.concatenate(other)
        where = bucket_of(other, buckets)
        order = np.lexsort((other, what, where))
        where, what, other = where[order], what[order], other[order]
        new = np.ones(len(what), bool)
        new[1:] = (np.diff(what) != 0) | (np.diff(other) != 0)
        at = np.flatnonzero(new)
        several = np.diff(np.append(at, len(what))) > 1
        return _rows(docs["chunk"][0].as_py() if len(docs) else 0, where[at], what[at] << U64(1) | several.astype(U64), other[at])

    return send


def _remove(window: int):
    def remove(docs: pa.Table, found: pa.Table) -> pa.Table:
        pairs = [(np.zeros(0, U64), np.zeros(0, U64)), *map(unpack_pairs, found["payload"].to_pylist())]
        repeated, other = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        order = np.lexsort((other, repeated))
        repeated, other = repeated[order], other[order]
        texts, n_words, n_removed, kept, spans = docs["text"], [], [], [], []
        for i, j, data, offsets in B.text_slices(texts):
            words = B.Words(data, offsets)
            covered = np.zeros(len(words.start) + 1, np.int64)
            if len(repeated):
                first, h = words.windows(window)
                first = first[_member_pairs(repeated, other, words.windows(window, check=True)[1] >> U64(1), h)]
                np.add.at(covered, first, 1)
                np.add.at(covered, first + window, -1)
            covered = np.cumsum(covered)[:-1] > 0
            raw = data.tobytes()
            for k in range(j - i):
                gone = covered[words.rows[k] : words.rows[k + 1]]
                own = raw[offsets[k] : offsets[k + 1]].split()
                n_words.append(len(own))
                n_removed.append(int(gone.sum()))
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)) if n_removed[-1] else []
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                kept.append(b" ".join(itertools.compress(own, ~gone) if n_removed[-1] else own).decode("utf-8", "surrogatepass"))
        return pa.table({
            "id": docs["id"],
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.string()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    return remove


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 35) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_text, removed) for every row of docs.

    Words are runs of bytes other than ASCII white space. A word goes if some window of
    ``window`` words over it starts elsewhere too, in any row or the same one; windows are
    judged on the input. ``removed`` lists the word spans. A null text has no words, and a
    text shorter than the window loses none; a null or repeated id is carried through, one
    row out for one row in; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    size = text_bytes(docs, text_column)
    parts = partitions(spark)
    chunk_bytes = min(CHUNK_MOST, max(CHUNK_BYTES, size >> 14))
    n_chunks, buckets = max(2 * parts, -(-size // chunk_bytes)), min(1 << 20, max(parts, -(-size // BUCKET_BYTES)))
    parts = max(parts, -(-size // TASK_BYTES))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n_chunks)))
    rows = rows.repartition(parts, "chunk")
    probes = rows.groupBy("chunk").applyInArrow(_send_probes(block, buckets), SENT)
    anchors = probes.groupBy("bucket").applyInArrow(_anchors, SENT)
    sent = rows.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_send_windows(block, window, buckets), SENT)
    found = sent.groupBy("bucket").applyInArrow(_twice, SENT)
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_remove(window), out).withColumnRenamed("id", id_column)
