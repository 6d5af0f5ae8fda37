"""Language identification by averaged hashed subword embeddings.

A text's subwords are its byte 3- and 4-grams inside words, word edges included. Each is
hashed to a row of an embedding table; the average of the rows feeds a linear softmax.
Table and softmax are trained by mini-batch gradient descent in numpy on a sample of
labelled rows, bounded for each language; scoring is linear in the average, so a batch
needs one table lookup a subword. A temperature and a rejection bound are calibrated on
rows of the sample that training leaves out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytescan as B
from tidemark.llm.shared import cut

UNKNOWN = "und"
BUCKET_BITS, DIM = 14, 8
#: The sample's bounds, parameters of fit(): labelled rows of one language and of all, but at least MIN_ROWS of each language.
ROWS_PER_LANGUAGE, SAMPLE_ROWS, MIN_ROWS = 500, 100_000, 5
EPOCHS, STEP, BATCH = 12, 0.5, 32
#: Rows of the sample that are scored at once.
SCORED = 512
#: Rejection stays under this score, however the sample scores.
HIGHEST_BOUND = 0.4

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def held_out(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string")) % 5 == 0


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: (buckets, range of them that each row owns)."""
    n = len(offsets) - 1
    text = np.full(len(data) + n + 1, 0x20, np.uint8)
    at = np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(offsets))
    text[at] = np.where(_LETTER[data], B.lower_ascii(data), 0x20)
    edge = offsets + np.arange(n + 1)
    letter = text != 0x20
    wide = text.astype(np.uint32)
    out = []
    for size in (3, 4):
        inner = letter[1 : len(text) - size + 2].copy()
        for k in range(2, size - 1):
            inner &= letter[k : len(text) - size + 1 + k]
        gram = np.zeros(len(inner), np.uint32)
        for k in range(size):
            gram = gram * np.uint32(0x01000193) + wide[k : len(text) - size + 1 + k] * np.uint32(0x9E3779B1)
        start = np.flatnonzero(inner)
        gram = gram[start] * np.uint32(0x85EBCA6B) + np.uint32(size)
        gram ^= gram >> np.uint32(15)
        out.append(((gram * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS), np.searchsorted(start, edge)))
    return out


def _features(batches):
    """Counts of buckets for the rows of the sample."""
    for batch in batches:
        bucket, count = [], []
        for _, _, data, offsets in B.text_slices(batch["text"]):
            grams = subwords(data, offsets)
            for k in range(len(offsets) - 1):
                value, n = np.unique(np.concatenate([g[r[k] : r[k + 1]] for g, r in grams]), return_counts=True)
                bucket.append(value.astype(np.int32))
                count.append(n.astype(np.float32))
        yield pa.RecordBatch.from_pydict({
            "lang": batch["lang"], "part": batch["part"],
            "bucket": pa.array(bucket, pa.list_(pa.int32())), "count": pa.array(count, pa.list_(pa.float32())),
        })


class Model:
    """Languages, a score for each bucket and language, their bias, temperature and rejection bound."""

    def __init__(self, names: list[str], rows: list[tuple[np.ndarray, np.ndarray, int, bool]], seed: int = 3):
        """rows: (buckets, counts, language's place, kept for calibration)."""
        self.names = names
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
        weight, bias = rng.normal(0, 0.5, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
        squares = [np.full_like(p, 1e-3) for p in (embed, weight, bias)]
        train = [r for r in rows if not r[3]] or rows
        for epoch in range(EPOCHS if len(names) > 1 else 0):
            for own in np.array_split(rng.permutation(len(train)), -(-len(train) // BATCH)):
                x, y = self._dense([train[k] for k in own])
                hidden = x @ embed
                p = self._softmax(hidden @ weight + bias)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                grads = (x.T @ (p @ weight.T), hidden.T @ p, p.sum(0))
                for value, square, g in zip((embed, weight, bias), squares, grads):
                    square += g * g
                    value -= STEP * (1 - epoch / EPOCHS) * 0.3 * g / np.sqrt(square)
        self.table, self.bias = (embed @ weight).astype(np.float32), bias
        self.heat, self.bound = 1.0, 0.0
        kept = [r for r in rows if r[3]]
        if kept and len(names) > 1:
            logits = np.concatenate([self._dense(kept[k : k + SCORED])[0] @ self.table + bias for k in range(0, len(kept), SCORED)])
            y = np.array([r[2] for r in kept])
            heats = np.geomspace(0.25, 8, 41)
            losses = [-np.log(self._softmax(logits / t)[np.arange(len(y)), y] + 1e-9).mean() for t in heats]
            self.heat = float(heats[int(np.argmin(losses))])
            self.bound = min(HIGHEST_BOUND, 0.5 * float(np.quantile(self._softmax(logits / self.heat).max(1), 0.005)))

    @staticmethod
    def _dense(rows):
        x = np.zeros((len(rows), 1 << BUCKET_BITS), np.float32)
        for k, (bucket, count, _, _) in enumerate(rows):
            x[k, bucket] = count / max(1.0, count.sum())
        return x, np.array([r[2] for r in rows])

    @staticmethod
    def _softmax(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros((len(offsets) - 1, len(self.names)))
        n = np.zeros(len(offsets) - 1)
        for bucket, own in subwords(data, offsets):
            n += np.diff(own)
            for k in range(len(self.names)):
                sums = np.zeros(len(bucket) + 1)
                np.cumsum(self.table[:, k][bucket], out=sums[1:], dtype=np.float64)
                total[:, k] += np.diff(sums[own])
        return self._softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.heat)


def fit(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS
) -> Model | None:
    """Learns from rows that are not held out and have a language and a text; None if there are none.

    Every language of the table is learned. The sample holds at most rows_per_language rows
    of each, and fewer where these would exceed sample_rows together, by a hash of the id;
    rows of one id are ordered by their text, and repeated rows count each.
    """
    rows = docs.where(~held_out(id_column) & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    rows = rows.select(F.xxhash64(id_column).alias("at"), F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    names = sorted(r["lang"] for r in counts.select("lang").collect())
    if not names:
        return None
    most = max(MIN_ROWS, min(rows_per_language, sample_rows // len(names)))
    share = F.least(F.lit(1.0), (1.3 * most + 100) / F.col("n"))
    # One row a language, as the model itself has; a first cut by hash keeps the groups that are ordered small.
    few = rows.join(F.broadcast(counts), "lang").where(F.pmod("at", F.lit(1 << 20)) < share * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "id", "text"))
    few = few.withColumn("place", place).where(F.col("place") <= most)
    few = few.select("lang", "text", (F.col("place") % 5 == 0).alias("part"))
    got = few.mapInArrow(_features, "lang string, part boolean, bucket array<int>, count array<float>").toArrow().to_pylist()
    at = {x: k for k, x in enumerate(names)}
    return Model(names, [(np.array(r["bucket"], np.int64), np.array(r["count"], np.float32), at[r["lang"]], r["part"]) for r in got])


def _judge(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted language, score and rejection of each text."""
    names, scores, rejected = [np.zeros(0, object)], [np.zeros(0)], [np.zeros(0, bool)]
    for _, _, data, offsets in B.text_slices(texts):
        raw = data.tobytes()
        ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 0x80))])
        known = np.diff(ascii_letters[offsets]) > 0
        for k in np.flatnonzero(~known):
            known[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace"))
        known &= model is not None
        p = model.scores(data, offsets) if model else np.zeros((len(known), 1))
        top = np.where(known, p.max(1), 0.0)
        names.append(np.where(known, np.array(model.names if model else [UNKNOWN], object)[p.argmax(1)], UNKNOWN))
        scores.append(top)
        rejected.append(~known | (top < (model.bound if model else 1.0)))
    return np.concatenate(names), np.concatenate(scores), np.concatenate(rejected)


def _predict(shared):
    def run(batches):
        for batch in batches:
            name, score, rejected = _judge(shared.value, batch["text"])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(name, pa.string()), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, rejected) for every row of docs.

    ``und`` with score 0, and rejected, where the text is null or has no letter, or nothing
    was learned; else the likeliest language and its calibrated probability, rejected
    under the model's bound. Ties go to the first language by name. Null and repeated ids
    are carried; an empty table gives no rows; very long texts are averaged whole.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_predict(shared), f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_column)


def keep_identified(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """The rows of docs that identify() does not reject, with all their columns, whatever their names.

    A null text, one without letters, and any text if nothing was learned, is rejected;
    repeated rows stay or go together; null ids do not matter; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~_judge(shared.value, batch.column(at))[2]))

    return docs.mapInArrow(run, docs.schema)
