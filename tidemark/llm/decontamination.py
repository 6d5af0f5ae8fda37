"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so plain MinHash similarity says nothing; what
counts is the share of an item's shingles that a document holds. Items are partitioned by
shingle count into classes of powers of two. Each class sketches an item by its smallest
MinHash values, as many as make containment certain to show: an item with q shingles of
which a share t is held misses at most (1 - t) * q, so any (1 - t) * q + 1 of them hold a
hit. Documents are searched whole for sketch values; candidates are then verified by the
exact share of distinct shingles.

A benchmark of a bounded number of shingles, which is checked, is broadcast as an index and
the documents are read once without a shuffle. A larger one is joined: a document's
shingles that a bitmap of all item shingles lets through meet the sketches by value, and
the pairs found so are verified by a join with the items' whole sets. Texts are known by
their digest there, so copies are searched once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytescan as B
from tidemark.llm.shared import cut

U64 = np.uint64
#: Shingles and sketch values of items that are broadcast at most, 16 bytes each; places of the bitmap for more.
BLOCK_SHINGLES, BITMAP_BITS = 1 << 20, 26
FOUND = "id long, item_id long, n_item_shingles long, n_shared long"


def _item_shingles(width: int):
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in B.text_slices(batch["text"]):
                words = B.Words(data, offsets, separators="plain", lower=True)
                h, at = B.shingle_sets(words, width)
                yield pa.RecordBatch.from_pydict({
                    "item_id": batch["item_id"].slice(i, j - i),
                    "width": pa.array(np.minimum(words.count, width), pa.int32()),
                    "shingles": pa.array([h[a:b].view(np.int64) for a, b in zip(at, at[1:])], pa.list_(pa.int64())),
                })

    return run


def sketch(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The least MinHash values, as many as the item's size class needs."""
    top = 1 << int(len(shingles)).bit_length()
    need = min(len(shingles), top * (100 - percent) // 100 + 1)
    return shingles[np.argsort(B.mix(shingles * U64(0x9E3779B97F4A7C15)))[:need]]


class Index:
    """The items: whole shingle sets, and the sketch values that open a candidate."""

    def __init__(self, items: list[tuple[int, int, list[int]]], percent: int):
        self.percent = percent
        self.ids = [i for i, _, _ in items]
        self.width = np.array([w for _, w, _ in items], np.int64)
        sets = [np.array(s, np.int64).view(U64) for _, _, s in items]
        self.size = np.array([len(s) for s in sets], np.int64)
        sketches = [sketch(s, percent) for s in sets]
        self.by_width = {int(w): self._tables(np.flatnonzero(self.width == w), sets, sketches) for w in np.unique(self.width)}

    @staticmethod
    def _tables(items, sets, sketches):
        def flat(parts):
            value, owner = np.concatenate([parts[k] for k in items]), np.repeat(items, [len(parts[k]) for k in items])
            order = np.argsort(value, kind="stable")
            return value[order], owner[order]

        return (*flat(sketches), *flat(sets))

    def search(self, words: B.Words, width: int):
        """(row, item, shared shingles) of the rows that hold enough of an item."""
        value, _, every, owner = self.by_width[width]
        first, h = words.windows(width)
        low = np.zeros(1 << 16, bool)
        low[(value >> U64(48)).astype(np.int64)] = True
        near = np.flatnonzero(low[(h >> U64(48)).astype(np.int64)])
        near = near[_inside(value, h[near])]
        row_of = np.searchsorted(words.rows, first[near], "right") - 1
        out = []
        for row in np.unique(row_of):
            a, b = np.searchsorted(first, words.rows[row : row + 2])
            own = np.unique(h[a:b])
            own = own[_inside(every, own)]
            left, right = np.searchsorted(every, own), np.searchsorted(every, own, "right")
            shared = np.bincount(np.concatenate([owner[i:j] for i, j in zip(left, right)]), minlength=len(self.ids))
            hit = np.flatnonzero((shared > 0) & (100 * shared >= self.percent * self.size))
            out += [(int(row), int(k), int(shared[k])) for k in hit if self.width[k] == width]
        return out


def _inside(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _filter(index, at: int):
    def run(batches):
        own = index.value
        for batch in batches:
            clean_rows = np.ones(batch.num_rows, bool)
            for i, _, data, offsets in B.text_slices(batch.column(at)):
                words = B.Words(data, offsets, separators="plain", lower=True)
                for w in own.by_width:
                    clean_rows[[i + r for r, _, _ in own.search(words, w)]] = False
            yield batch.filter(pa.array(clean_rows))

    return run


def _search(index):
    def run(batches):
        own = index.value
        for batch in batches:
            ids = batch["id"].to_pylist()
            for i, _, data, offsets in B.text_slices(batch["text"]):
                words = B.Words(data, offsets, separators="plain", lower=True)
                found = [(ids[i + r], own.ids[k], own.size[k], n) for w in own.by_width for r, k, n in own.search(words, w)]
                if found:
                    yield pa.RecordBatch.from_pydict({name: pa.array(x, pa.int64()) for name, x in zip(("id", "item_id", "n_item_shingles", "n_shared"), zip(*found))})

    return run


def _sketches(percent: int):
    def run(batches):
        for batch in batches:
            parts = [sketch(np.array(s, np.int64).view(U64), percent).view(np.int64) for s in batch["shingles"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["item"], batch["width"], pa.array(parts, pa.list_(pa.int64()))], ["item", "width", "values"])

    return run


def _values(widths: list[int], bitmap):
    """Rows (text, width, value): a text's digest and its shingles that the bitmap knows."""

    def run(batches):
        known = bitmap.value
        for batch in batches:
            for _, _, data, offsets in B.text_slices(batch["text"]):
                words, raw = B.Words(data, offsets, separators="plain", lower=True), memoryview(data.tobytes())
                for width in widths:
                    first, h = words.windows(width)
                    slot = h >> U64(64 - BITMAP_BITS)
                    near = np.flatnonzero(known[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8) & 1)
                    row, value = np.searchsorted(words.rows, first[near], "right") - 1, h[near]
                    order = np.lexsort((value, row))
                    row, value = row[order], value[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (np.diff(row) != 0) | (np.diff(value) != 0)
                    row, value = row[new], value[new]
                    digest = {int(r): hashlib.sha256(raw[offsets[r] : offsets[r + 1]]).digest() for r in np.unique(row)}
                    yield pa.RecordBatch.from_pydict({
                        "text": B.binary([digest[r] for r in row.tolist()]), "width": pa.array(np.full(len(row), width), pa.int32()), "value": pa.array(value.view(np.int64)),
                    })

    return run


def _bitmap(sets: DataFrame) -> np.ndarray:
    """Which places of 2 ** BITMAP_BITS the items' shingles take: at most so many bits come to the driver, however many items there are."""
    slots = sets.select(F.explode("shingles").alias("value")).select(F.shiftrightunsigned("value", 64 - BITMAP_BITS).alias("slot"))
    pieces = slots.groupBy((F.col("slot") / 32768).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
    out = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    for r in pieces.toLocalIterator():
        out[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _joined(docs: DataFrame, sets: DataFrame, text_column: str, percent: int) -> DataFrame:
    """Rows (text, item_id, n_item_shingles, n_shared) of the texts, by digest, that hold an item."""
    sets = cut(sets.withColumn("item", F.monotonically_increasing_id()))
    widths = sorted(r["width"] for r in sets.select("width").distinct().collect())
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(sets))
    values = docs.select(F.col(text_column).alias("text")).mapInArrow(_values(widths, bitmap), "text binary, width int, value long")
    values = cut(values.distinct())
    sketches = sets.select("item", "width", "shingles").mapInArrow(_sketches(percent), "item long, width int, values array<long>")
    near = values.join(sketches.select("item", "width", F.explode("values").alias("value")), ["width", "value"]).select("text", "item").distinct()
    whole = sets.select("item", "item_id", "width", F.size("shingles").cast("long").alias("n_item_shingles"), F.explode("shingles").alias("value"))
    held = near.join(whole, "item").join(values, ["text", "width", "value"], "left_semi")
    shared = held.groupBy("text", "item", "item_id", "n_item_shingles").agg(F.count("*").alias("n_shared"))
    return shared.where(100 * F.col("n_shared") >= percent * F.col("n_item_shingles")).drop("item")


def _item_sets(items: DataFrame, item_id: str, item_text: str, shingle: int) -> tuple[DataFrame, int]:
    """(rows (item_id, width, shingles) of the items with words, shingles of them all)."""
    sets = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    sets = cut(sets.mapInArrow(_item_shingles(shingle), "item_id long, width int, shingles array<long>").where(F.size("shingles") > 0))
    return sets, sets.agg(F.sum(F.size("shingles"))).first()[0] or 0


def _broadcast_index(sets: DataFrame, percent: int):
    """The index of items whose number of shingles has been checked."""
    return sets.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["width"], r["shingles"]) for r in sets.collect()], percent))


def contained_items(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """Rows (id, item_id, n_item_shingles, n_shared), one for each row of docs and item it holds.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A
    row holds an item when it has at least ``percent`` of the item's distinct shingles; an
    item of fewer words than a shingle is held when its words stand in the text in order.
    Null and wordless items or texts give nothing; equal items are each reported, with a
    null item_id where they have none; rows of docs that repeat an id are each reported; a
    null id is carried; empty tables give no rows; other columns are ignored. A text is
    read whole, however long.
    """
    sets, total = _item_sets(items, item_id, item_text, shingle)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    if not total:
        found = docs.sparkSession.createDataFrame([], FOUND)
    elif 2 * total <= BLOCK_SHINGLES:
        found = rows.mapInArrow(_search(_broadcast_index(sets, percent)), FOUND)
    else:
        named = rows.select("id", F.unhex(F.sha2("text", 256)).alias("text"))
        found = named.join(_joined(docs, sets, text_column, percent), "text").drop("text")
    return found.withColumnRenamed("id", id_column)


def clean(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that hold no item by contained_items(), with all their columns.

    Null, empty and wordless texts hold nothing and stay; repeated rows stay or go
    together; without items, or docs, docs are returned as they are.
    """
    sets, total = _item_sets(items, item_id, item_text, shingle)
    if not total:
        return docs
    if 2 * total <= BLOCK_SHINGLES:
        return docs.mapInArrow(_filter(_broadcast_index(sets, percent), docs.columns.index(text_column)), docs.schema)
    gone = _joined(docs, sets, text_column, percent).select("text").distinct().withColumnRenamed("text", "__text_sha256")
    return docs.join(gone, F.unhex(F.sha2(F.col(text_column), 256)) == gone["__text_sha256"], "left_anti")
