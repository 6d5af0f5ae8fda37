"""Quality scores by a factorisation machine.

Features of a text are its distinct hashed words, with equal weights of unit length, and
statistics of its structure and size. Each feature has a weight and a short vector; pairs
of features interact by the product of their vectors, summed in linear time as half the
square of the sum less the sum of the squares. The machine is trained by mini-batch
gradient descent in numpy on a bounded sample of labelled rows, and its scores calibrated
on rows of the sample that training leaves out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytescan as B
from tidemark.llm.language_id import held_out

U64 = np.uint64
WORD_BITS, RANK = 13, 6
#: The most labelled rows that are learned from.
SAMPLE_ROWS = 4000
EPOCHS, STEP, BATCH, DECAY = 12, 0.08, 64, 2e-4
STATISTICS = 12

_CLASS = np.full(256, 4)  # 0 small letter, 1 capital, 2 digit, 3 white space, 4 other ASCII, 5 other
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0, 1, 2, 5
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets in order of row, range of them that each row owns, statistics by row)."""
    rows = len(offsets) - 1
    words = B.Words(data, offsets, lower=True)
    bucket = (words.digests() >> U64(64 - WORD_BITS)).astype(np.int64)
    owned = np.unique(words.row_of_word() << WORD_BITS | bucket)
    own = np.searchsorted(owned >> WORD_BITS, np.arange(rows + 1))

    def per_row(flags, at=offsets):
        sums = np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])
        return np.diff(sums[at])

    size = np.maximum(1.0, np.diff(offsets))
    kinds = np.stack([per_row(_CLASS[data] == k) for k in range(6)], 1)
    n = np.maximum(1.0, words.count)
    length = words.end - words.start
    last = _CLASS[data[words.end - 1]] if len(words.end) else np.zeros(0, int)
    whole = np.where(length == 1, last, -1)
    joint = np.zeros(len(data))
    joint[1:] = (_CLASS[data[1:]] == 4) & (data[1:] == data[:-1])
    statistics = np.stack([
        np.log1p(size) / 5, np.log1p(n) / 5, per_row(length, words.rows) / n / 8,
        kinds[:, 1] / size * 4, kinds[:, 2] / size * 8, kinds[:, 4] / size * 8, kinds[:, 3] / size * 4,
        per_row(last == 4, words.rows) / n * 2, per_row(whole == 4, words.rows) / n * 4,
        np.diff(own) / n, per_row(data == 0x0A) / n * 10, per_row(joint) / n * 2,
    ], 1)
    return owned & ((1 << WORD_BITS) - 1), own, np.minimum(statistics, 4.0).astype(np.float32)


def _sample_features(batches):
    for batch in batches:
        buckets, numbers = [], []
        for _, _, data, offsets in B.text_slices(batch["text"]):
            bucket, own, statistics = features(data, offsets)
            buckets += [bucket[a:b].astype(np.int32) for a, b in zip(own, own[1:])]
            numbers += list(statistics)
        yield pa.RecordBatch.from_pydict({
            "quality": batch["quality"], "part": batch["part"],
            "bucket": pa.array(buckets, pa.list_(pa.int32())), "numbers": pa.array(numbers, pa.list_(pa.float32())),
        })


class Machine:
    """Weights and vectors of word buckets and statistics, and the calibration of scores."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int, bool]], seed: int = 7):
        """rows: (word buckets, statistics, label, kept for calibration)."""
        rng = np.random.default_rng(seed)
        width = (1 << WORD_BITS) + STATISTICS
        self.bias = np.zeros(1, np.float32)
        self.weight = np.zeros(width, np.float32)
        self.vector = rng.normal(0, 0.05, (width, RANK)).astype(np.float32)
        self.centre, self.spread = np.zeros(STATISTICS, np.float32), np.ones(STATISTICS, np.float32)
        self.line = (1.0, 0.0)
        labels = {r[2] for r in rows}
        if len(labels) < 2:
            share = (sum(r[2] for r in rows) + 0.5) / (len(rows) + 1)
            self.line = (0.0, float(np.log(share / (1 - share))))
            return
        train = [r for r in rows if not r[3]]
        train = train if len({r[2] for r in train}) == 2 else rows
        numbers = np.array([r[1] for r in train])
        self.centre, self.spread = numbers.mean(0), np.maximum(numbers.std(0), 1e-3)
        squares = [np.full_like(p, 1e-4) for p in (self.bias, self.weight, self.vector)]
        for epoch in range(EPOCHS):
            for own in np.array_split(rng.permutation(len(train)), -(-len(train) // BATCH)):
                x, y = self._dense([train[k] for k in own])
                s = x @ self.vector
                z = self.bias + x @ self.weight + 0.5 * ((s * s) - (x * x) @ (self.vector**2)).sum(1)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
                gx = g[:, None] * x
                grads = (g.sum(keepdims=True), gx.sum(0) + DECAY * self.weight, gx.T @ s - (gx * x).sum(0)[:, None] * self.vector + DECAY * self.vector)
                for value, square, d in zip((self.bias, self.weight, self.vector), squares, grads):
                    square += d * d
                    value -= (STEP * (1 - epoch / EPOCHS) * d / np.sqrt(square)).astype(np.float32)
        kept = [r for r in rows if r[3]]
        if len({r[2] for r in kept}) == 2:
            x, y = self._dense(kept)
            s = x @ self.vector
            self.line = self._calibrate(self.bias + x @ self.weight + 0.5 * ((s * s) - (x * x) @ (self.vector**2)).sum(1), y)

    def _dense(self, rows):
        x = np.zeros((len(rows), (1 << WORD_BITS) + STATISTICS), np.float32)
        for k, (bucket, numbers, _, _) in enumerate(rows):
            x[k, bucket] = 1 / np.sqrt(max(1, len(bucket)))
            x[k, 1 << WORD_BITS :] = self._scaled(numbers)
        return x, np.array([r[2] for r in rows], np.float32)

    def _scaled(self, numbers):
        return np.clip((numbers - self.centre) / self.spread, -4, 4) / 2

    @staticmethod
    def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and offset of a logistic line through the scores, by Newton's method on smoothed labels, in steps that lower the loss."""
        scale = max(1.0, float(np.abs(z).mean()))
        y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        x, w = np.stack([z / scale, np.ones_like(z)], 1).astype(np.float64), np.array([1.0, 0.0])

        def loss(w):
            t = x @ w
            return (np.logaddexp(0, t) - y * t).sum() + 5e-4 * ((w - [1.0, 0.0]) ** 2).sum()

        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, x.T @ (p - y) + 1e-3 * (w - [1.0, 0.0]))
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
        return float(max(w[0], 1e-3)) / scale, float(w[1])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, own, numbers = features(data, offsets)
        unit = 1 / np.sqrt(np.maximum(1, np.diff(own)))

        def total(values):
            sums = np.concatenate([[0.0], np.cumsum(values[bucket], dtype=np.float64)])
            return np.diff(sums[own])

        x = self._scaled(numbers)
        deep = 1 << WORD_BITS
        z = self.bias[0] + unit * total(self.weight) + x @ self.weight[deep:]
        z = z - 0.5 * (unit**2 * total((self.vector**2).sum(1)) + (x * x) @ (self.vector[deep:] ** 2).sum(1))
        for f in range(RANK):
            z = z + 0.5 * (unit * total(self.vector[:, f]) + x @ self.vector[deep:, f]) ** 2
        return 1 / (1 + np.exp(-np.clip(self.line[0] * z + self.line[1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Learns from labelled rows that are not held out, at most sample_rows of them by a hash of the id.

    An id counts once, however often docs or labels repeat it, with its first text and, of
    that, its first label in order. Ids without a text in docs, and null labels, are left out.
    """
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.select(F.col(id_column).alias("id"), (F.col(label_column) > 0).cast("int").alias("quality"), F.xxhash64(id_column).alias("at"))
    n = known.count()
    few = known.where(F.pmod("at", F.lit(1 << 20)) < min(1.0, (1.3 * sample_rows + 100) / max(n, 1)) * (1 << 20))
    few = few.orderBy("at", "id").limit(sample_rows)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(few), "id").groupBy("id").agg(F.min(F.struct("text", "quality", "at")).alias("r")).select("r.*")
    rows = rows.select("quality", (F.pmod("at", F.lit(5)) == 0).alias("part"), "text")
    got = rows.mapInArrow(_sample_features, "quality int, part boolean, bucket array<int>, numbers array<float>").toArrow().to_pylist()
    return Machine([(np.array(r["bucket"], np.int64), np.array(r["numbers"], np.float32), r["quality"], r["part"]) for r in got])


def score(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, score) for every row of docs.

    Null counts as empty; an empty text has no words and zero statistics, and is scored all
    the same; texts are scored whole; null and repeated ids are carried; an empty table
    gives no rows; other columns are ignored. If the sample has one label only, or none,
    every score is its smoothed share.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            parts = [shared.value.scores(data, offsets) for _, _, data, offsets in B.text_slices(batch["text"])]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "score": pa.array(np.concatenate(parts) if parts else [], pa.float64())})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)
