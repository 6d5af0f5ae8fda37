"""Exact duplicates by content-defined chunk recipes.

A text (A-Z lower-cased) is cut where a rolling hash of its last bytes says so, so equal
stretches give equal chunks wherever they stand. A chunk travels as a 64-bit hash and a
128-bit digest of its bytes, never as text. The dictionary of distinct chunks gives each
an identifier, (hash, place among the digests of that hash): digests verify that one
identifier is one content. A text's recipe is its ordered list of identifiers; texts are
equal when their recipes are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytescan as B
from tidemark.llm.shared import cut, spread_join

U64 = np.uint64
#: Bytes that decide a cut, and the mean size of a chunk as a power of two.
REACH, SIZE_BITS = 48, 10
SHAPE = "id long, n_bytes long, text_sha256 string, chunks array<struct<place:int,hash:long,digest:binary>>"
_CHUNK = pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64()), ("digest", pa.binary())]))


def cuts(prefix: np.ndarray, n: int) -> np.ndarray:
    """Ends of chunks among n bytes whose rolling prefix sums are given; the last is n."""
    if n <= REACH:
        return np.array([n] if n else [], np.int64)
    end = np.arange(REACH, n)
    h = B.BYTES.spans(prefix, end - REACH, end)
    return np.append(end[h >> U64(64 - SIZE_BITS) == 0], n)


def _recipes(batches):
    for batch in batches:
        for i, j, data, offsets in B.text_slices(batch["text"]):
            low = B.lower_ascii(data)
            raw, n_bytes, sha, chunks = low.tobytes(), np.diff(offsets), [], []
            for a, b in zip(offsets, offsets[1:]):
                prefix = B.BYTES.prefix(B.BYTES.table[low[a:b]])
                end = cuts(prefix, int(b - a))
                start = np.append(0, end[:-1])[: len(end)]
                h = B.BYTES.spans(prefix, start, end).view(np.int64).tolist()
                sha.append(hashlib.sha256(raw[a:b]).hexdigest())
                chunks.append([{"place": k, "hash": x, "digest": hashlib.sha256(raw[a + s : a + e]).digest()[:16]} for k, (x, s, e) in enumerate(zip(h, start, end))])
            yield pa.RecordBatch.from_pydict({
                "id": batch["id"].slice(i, j - i), "n_bytes": pa.array(n_bytes, pa.int64()),
                "text_sha256": pa.array(sha, pa.string()), "chunks": pa.array(chunks, _CHUNK),
            })


def recipes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Checkpointed rows (row, id, n_bytes, text_sha256, chunks) with a number for each row."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(_recipes, SHAPE)
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def chunk_dictionary(used: DataFrame) -> DataFrame:
    """Rows (hash, digests, n) of all chunks, n of them with the hash; a chunk's identifier is its hash and its place in digests."""
    return used.groupBy("hash").agg(F.sort_array(F.collect_set("digest")).alias("digests"), F.count("*").alias("n"))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256, n_chunks) for every row of docs.

    Null counts as empty and empty texts are equal. Of equal texts the row with the largest
    id stays, a missing id below all others and, among rows of one id, the last read; so
    each group keeps one row. An empty table gives no rows; other columns are ignored.
    Very long texts only add chunks to their own recipe. A chunk or a recipe that many rows
    hold is spread over tasks.
    """
    found = recipes(docs, id_column, text_column)
    used = found.select("row", F.explode("chunks").alias("c")).select("row", "c.place", "c.hash", "c.digest")
    chunks = found.agg(F.sum(F.size("chunks"))).first()[0] or 0
    used = spread_join(used, chunk_dictionary(used), "hash", "row", chunks)
    used = used.select("row", F.struct("place", "hash", F.array_position("digests", F.col("digest")).alias("nth")).alias("chunk"))
    lists = used.groupBy("row").agg(F.sort_array(F.collect_list("chunk")).alias("recipe"))
    lists = lists.select("row", F.size("recipe").alias("n_chunks"), F.sha2(F.to_json("recipe"), 256).alias("recipe"))
    rows = found.select("row", "id", "text_sha256").join(lists, "row", "left").fillna({"n_chunks": 0, "recipe": ""})
    rows = cut(rows)
    groups = cut(rows.groupBy("recipe").agg(F.max(F.struct("id", "row")).alias("stays"), F.count("*").alias("group_size"), F.count("*").alias("n")))
    out = spread_join(rows, groups, "recipe", "row", rows.count())
    return out.select(
        F.col("id").alias(id_column), F.col("stays.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256", "n_chunks",
    )


def one_of_each_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns, whatever these are called.

    Where ids repeat, a row is known by id and text, and equal rows are kept once. Null
    counts as an empty text, a null id is an id like any other, and no rows give none.
    """
    found = cut(exact_duplicates(docs, id_column, text_column).select(F.col(id_column).alias("id"), "kept", "text_sha256"))
    kept = found.where("kept").select(F.struct("id").alias("key"), "text_sha256")
    rows, ids = found.agg(F.count("*"), F.count_distinct(F.coalesce(F.col("id").cast("string"), F.lit("")))).first()
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.struct(F.col(id_column).cast("long").alias("id")).alias("key"), F.col(text_column).alias("text"))
    if rows == ids:
        return packed.drop("text").join(kept.select("key"), "key", "left_semi").select("doc.*")
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = packed.select("doc", "key", F.sha2(low, 256).alias("text_sha256"))
    return named.join(kept, ["key", "text_sha256"], "left_semi").dropDuplicates(["key", "text_sha256"]).select("doc.*")
