"""Vector code compression: each part of a vector as the number of its nearest codebook entry.

The codebooks are learned by Lloyd's rounds with Hamerly's bounds. With each part of a
vector its entry, an upper bound of the distance to it and one lower bound of the distance
to any other entry are stored; from round to round the bounds move by what the entries
moved. While the upper bound is strictly less than the lower one, or than half the way from
the entry to the next one, the entry is the only nearest and stays. Otherwise the upper
bound is made exact, and if that does not do either, the part is compared with all entries
in whole numbers, the lower index winning ties. Bounds are stored as 32-bit floats, rounded
away from each other, so that they err only towards a comparison.

A round reads one written table and writes the next over the one before that, so two are
on disk at most.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import whole_vectors as W
from tidemark.llm.shared import shared_folder, spread_join, written

#: Parts that are compared with all entries at a time.
STEP = 1 << 13


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-7)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * np.where(x > 0, 1 - 1e-7, 1 + 1e-7)).astype(np.float32), np.float32(-np.inf))


class Codebook:
    """The entries of one part position, how far each has moved, and half its way to the nearest other."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.squares = (entries * entries).sum(axis=1)
        self.largest = int(np.abs(entries).max(initial=0))
        self.moved = np.zeros(len(entries))
        self.half = np.full(len(entries), np.inf)
        if before is not None:
            self.moved = np.sqrt(((entries - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-9)
            if len(entries) > 1:
                apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2).astype(np.float64)
                np.fill_diagonal(apart, np.inf)
                self.half = np.sqrt(apart.min(axis=1)) * (0.5 - 1e-9)

    def distance(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        return ((x - self.entries[code]) ** 2).sum(axis=1)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lowest nearest entry, upper bound, lower bound of all others), by comparing with every entry in whole numbers."""
        code, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
        kind = np.float64 if max(self.largest, int(np.abs(x).max(initial=0))) <= W.EXACT else np.int64
        entries = self.entries.T.astype(kind)
        for at in range(0, len(x), STEP):
            own = x[at : at + STEP]
            rest = self.squares - (2 * (own.astype(kind) @ entries)).astype(np.int64)
            code[at : at + STEP] = k = rest.argmin(axis=1)
            square = (own * own).sum(axis=1)
            upper[at : at + STEP] = np.sqrt((rest[np.arange(len(own)), k] + square).astype(np.float64))
            if rest.shape[1] > 1:
                rest[np.arange(len(own)), k] = np.iinfo(np.int64).max >> 1
                lower[at : at + STEP] = np.sqrt((rest.min(axis=1) + square).astype(np.float64))
        return code, _up(upper), _down(lower)

    def step(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The parts' entries and bounds after the entries have moved, and how many parts were compared with all entries."""
        code, far = code.astype(np.int64), np.sort(self.moved)[-2:]
        others = np.where(self.moved[code] == far[-1], far[0], far[-1]) if len(far) > 1 else np.zeros(len(code))
        upper, lower = _up(upper + self.moved[code]), _down(lower - others)
        bound = np.maximum(lower, _down(self.half)[code])
        open_ = np.flatnonzero(~(upper < bound))
        upper[open_] = _up(np.sqrt(self.distance(x[open_], code[open_]).astype(np.float64)))
        open_ = open_[~(upper[open_] < bound[open_])]
        code[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return code, upper, lower, len(open_)


STATE = "id long, carry {carry}, vector binary, codes binary, upper binary, lower binary"


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4, dimension: int = 64,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows (id, code, error, label_error, codebooks_sha256), codebooks by part).

    A row for every vector of ``dimension`` components, none of them null or not finite;
    others have no row. Components become floor(1024 * x); one beyond 131,072 raises, as its
    square would not fit. Codebooks start at the smallest ids, equal ids by their components
    and a missing id last; fewer vectors than ``entries`` make fewer entries, and entries
    without parts stay. Of equally near entries the lower index wins. Null and repeated ids
    and labels are carried, null labels are one label, repeated rows each have a row, an
    empty table gives no rows, other columns are ignored.
    """
    if dimension % parts or not 1 <= entries <= 256:
        raise ValueError("a vector has equal parts, and two hex digits name 256 entries")
    spark, width = vectors.sparkSession, dimension // parts
    table = W.packed(vectors, id_column, vector_column, dimension, carry=label_column)
    state = STATE.format(carry=table.schema["carry"].dataType.simpleString())
    first = table.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = np.array([np.frombuffer(r.vector, "<i4") for r in first], np.int64).reshape(-1, parts, width)
    books = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
    slots = [f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}-{k}" for k in (0, 1)]

    def assigned(shared):
        def run(batches):
            for batch in batches:
                x = W.matrix(batch["vector"], "<i4", dimension).astype(np.int64).reshape(-1, parts, width)
                if "codes" not in batch.schema.names:
                    found = [book.scan(x[:, p]) for p, book in enumerate(shared.value)]
                else:
                    codes, upper, lower = (W.matrix(batch[name], kind, parts) for name, kind in (("codes", np.uint8), ("upper", "<f4"), ("lower", "<f4")))
                    found = [book.step(x[:, p], codes[:, p], upper[:, p], lower[:, p])[:3] for p, book in enumerate(shared.value)]
                codes, upper, lower = (np.stack([f[k] for f in found], axis=1) for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["carry"], batch["vector"], W.rows_of(codes.astype(np.uint8)), W.rows_of(upper.astype("<f4")), W.rows_of(lower.astype("<f4"))],
                    ["id", "carry", "vector", "codes", "upper", "lower"],
                )

        return run

    def keyed(batch):
        x = W.matrix(batch["vector"], "<i4", dimension).astype(np.int64).reshape(-1, width)
        return (W.matrix(batch["codes"], np.uint8, parts).astype(np.int64) + np.arange(parts) * entries).ravel(), x

    now = [Codebook(b) for b in books]
    for turn in range(rounds if len(first) else 0):
        shared = spark.sparkContext.broadcast(now)
        table.mapInArrow(assigned(shared), state).write.mode("overwrite").option("compression", "zstd").parquet(slots[turn % 2])
        table = spark.read.schema(state).parquet(slots[turn % 2])
        found = W.grouped_sums(table.select("vector", "codes"), parts * entries, width, keyed)
        books = [W.moved(b, {k - p * entries: v for k, v in found.items() if k // entries == p}) for p, b in enumerate(books)]
        now = [Codebook(b, c.entries) for b, c in zip(books, now)]
    shared = spark.sparkContext.broadcast(now)

    def coded(batches):
        for batch in assigned(shared)(batches):
            x = W.matrix(batch["vector"], "<i4", dimension).astype(np.int64).reshape(-1, parts, width)
            codes = W.matrix(batch["codes"], np.uint8, parts)
            error = sum((book.distance(x[:, p], codes[:, p]) for p, book in enumerate(shared.value)), np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["carry"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["id", "carry", "code", "error"])

    digest = hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()
    carry = table.schema["carry"].dataType.simpleString()
    out = written(table.mapInArrow(coded, f"id long, carry {carry}, code string, error long").withColumn("label", F.to_json(F.struct("carry"))), "coded")
    facts = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = spread_join(out, facts, "label", "id", out.count())
    return out.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books
