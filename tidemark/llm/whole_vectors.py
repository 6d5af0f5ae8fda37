"""Vectors as whole numbers: exact fixed-point components, packed for repeated passes, and grouped sums of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytescan import binary
from tidemark.llm.shared import written

#: A component x becomes floor(SCALE * x); as x is binary, the product is exact.
SCALE = 1024
#: Components beyond this raise: 64 squares of differences then still fit a long.
LARGEST = 1 << 27
#: Components up to this may be multiplied as doubles, whose sums of 64 products are exact.
EXACT = 1 << 22


def components(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that have ``dimension`` components, none null or not finite; their whole components)."""
    place = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(place)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    good = np.isfinite(x).all(axis=1)
    x = np.floor(SCALE * x[good])
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}: its squares do not fit a long")
    return place[good], x.astype(np.int32)


def matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """A binary column of ``width`` numbers a row."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def rows_of(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    return binary([r.tobytes() for r in np.ascontiguousarray(x)])


def packed(vectors: DataFrame, id_column: str, vector_column: str, dimension: int, carry: str | None = None) -> DataFrame:
    """A written table (id, carry, vector) of the vectors that ``components`` keeps; vector holds little-endian 32-bit numbers."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), *([F.col(carry).alias("carry")] if carry else []), F.col(vector_column).alias("vector"))

    def run(batches):
        for batch in batches:
            place, x = components(batch["vector"], dimension)
            own = batch.take(pa.array(place))
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], rows_of(x)], own.schema.names)

    kept = rows.schema.fields[:-1]
    shape = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "vector binary"])
    return written(rows.mapInArrow(run, shape), "vectors")


def grouped_sums(table: DataFrame, groups: int, width: int, keyed: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[int, list[int]]]:
    """{group: (rows, sums by component)} of what ``keyed`` makes of each batch: (group of each row, matrix of ``width`` columns).

    A task adds up all its rows, so it sends at most one row a group; the sums then reach the driver, ``groups`` rows.
    """

    def run(batches):
        n, total = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
        for batch in batches:
            key, x = keyed(batch)
            n += np.bincount(key, minlength=groups)
            for k in range(width):  # sums of a batch are exact as doubles
                total[:, k] += np.bincount(key, x[:, k], groups).astype(np.int64)
        used = np.flatnonzero(n)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used]), sums], ["key", "n", "sums"])

    parts = table.mapInArrow(run, "key long, n long, sums array<long>")
    whole = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    return {r[0]: (r[1], [int(x) for x in r[2:]]) for r in parts.groupBy("key").agg(F.sum("n"), *whole).collect()}


def moved(centres: np.ndarray, found: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Centres at the floors of their rows' means; those without rows stay."""
    out = centres.copy()
    for k, (n, sums) in found.items():
        out[k] = [s // n for s in sums]
    return out
