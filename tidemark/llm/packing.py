"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Lengths are whole numbers up to the capacity, so the histogram has at most that many rows
whatever the corpus; only it reaches the driver. The plan works on counts: lengths above a
third of the capacity are matched, the longest with the longest that fits beside it, at
most two in a sequence; shorter ones then go, longest first, into the smallest gap that
holds them. One step places all sequences of a kind at once, so the plan's size depends on
the capacity, not on the corpus. Pieces then take the places of their length by rank, and
ranks are counted in salted groups, as a third of all pieces may have one length.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import cut, partitions


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, how many in each)]) for all pieces of the histogram."""
    left = {s: n for s, n in counts.items() if n > 0}
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    third = capacity // 3
    large = sorted((s for s in left if s > third), reverse=True)
    for s in large:
        while left[s]:
            mate = next((m for m in large if m <= min(s, capacity - s) and left[m] > (m == s)), None)
            if mate is None:
                n, own = left[s], [(s, 1)]
            elif mate == s:
                n, own = left[s] // 2, [(s, 2)]
            else:
                n, own = min(left[s], left[mate]), [(s, 1), (mate, 1)]
            for size, k in own:
                left[size] -= n * k
            gaps[capacity - sum(size * k for size, k in own)].append((n, own))
    for s in sorted((s for s in left if s <= third), reverse=True):
        open_gaps = [g for g in gaps if g >= s and gaps[g]]
        heapq.heapify(open_gaps)
        while left[s]:
            while open_gaps and not gaps[open_gaps[0]]:
                heapq.heappop(open_gaps)
            gap = open_gaps[0] if open_gaps else capacity
            n, own = gaps[gap].pop() if open_gaps else (left[s], [])
            fit = gap // s
            bins = min(n, left[s] // fit)
            each = fit if bins else left[s]
            bins = bins or 1
            if open_gaps and n > bins:
                gaps[gap].append((n - bins, own))
            rest = gap - each * s
            left[s] -= bins * each
            gaps[rest].append((bins, [*own, (s, each)]))
    return [kind for group in gaps.values() for kind in group]


class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, kinds: list[tuple[int, list[tuple[int, int]]]]):
        rows, base, taken = [], 0, defaultdict(int)
        for n, own in kinds:
            offset = 0
            for length, each in own:
                rows.append((length, taken[length], n, base, offset))
                taken[length] += n * each
                offset += length * each
            base += n
        rows.sort()
        self.length, self.first, self.n, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.sequences = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        key, at = self.length << 44 | self.first, length << 44 | rank
        k = np.searchsorted(key, at, "right") - 1
        r = rank - self.first[k]
        return self.base[k] + r % self.n[k], self.offset[k] + r // self.n[k] * length


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank, from 0, among the pieces of one length; pieces has a unique row."""
    salts = 4 * partitions(pieces.sparkSession)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    sizes = sizes.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    return salted.withColumn("own", own).join(sizes, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "before", "own")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a long ``length`` from 1 to capacity.

    Each sequence is filled without gaps from offset 0. Pieces of one length are alike to
    the plan, so ties are settled by row, and repeated rows each have a place; null ids are
    carried; no pieces give no rows. Any other columns, whatever their names, come out as
    they are; columns named sequence_id or offset are replaced. A length that is null or
    outside 1 to capacity has no place in any sequence and raises.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = cut(pieces.select(F.struct(*names).alias("piece"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("row")))
    counts = {r["length"]: r["count"] for r in rows.groupBy(F.when(F.col("length").between(1, capacity), F.col("length")).alias("length")).count().collect()}
    if None in counts:
        raise ValueError(f"{counts[None]} pieces have no length from 1 to {capacity}")
    shared = spark.sparkContext.broadcast(Places(plan(counts, capacity)))

    def run(batches):
        for batch in batches:
            sequence, offset = shared.value.find(np.asarray(batch["length"]), np.asarray(batch["rank"]))
            yield pa.RecordBatch.from_arrays([batch["piece"], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["piece", "sequence_id", "offset"])

    out = T.StructType([T.StructField("piece", rows.schema["piece"].dataType), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked(rows).select("piece", "length", "rank").mapInArrow(run, out).select("piece.*", "sequence_id", "offset")
