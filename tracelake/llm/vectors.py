"""What the vector searches share: valid rows, clusters of a sample, packed blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK = "cell int, ids binary, data binary"


def valid(df: DataFrame, vector: str = "embedding", zero: bool = True) -> DataFrame:
    """``vec_id long, v array<double>``: one row per id, only vectors that can be compared.

    Null ids, null vectors and vectors with null or non-finite components take no part, nor, with
    ``zero=False``, those without a non-zero component. Of rows that share an id the smallest
    vector stays. Other columns are not read.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def dimension(rows: DataFrame) -> int:
    """The most common vector length (the smaller on a tie), 0 without rows; others take no part."""
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return first[0]["d"] if first else 0


def sample(rows: DataFrame, size: int) -> np.ndarray:
    """The ``size`` rows with the smallest hash of their id, as a matrix (the bound on what is collected)."""
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matrix(batch.column(1)).tobytes()], pa.binary())], names=["data"])

    found = [np.frombuffer(r["data"]) for r in taken.mapInArrow(run, "data binary").collect()]
    return np.concatenate(found) if found else np.zeros(0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.float64).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows of a and rows of b, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def kmeans(data: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Centres and each row's nearest centre; fewer centres where rows coincide."""
    dice = np.random.default_rng(seed)
    centres = np.unique(data[dice.choice(len(data), min(k, len(data)), replace=False)], axis=0)
    for _ in range(rounds):
        nearest = squared(data, centres).argmin(1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, data)
        kept = counts > 0
        centres = sums[kept] / counts[kept, None]
    return centres, squared(data, centres).argmin(1)


def packed(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """Rows (cell int, vec_id, v) in packs of at most ``size`` neighbours in (cell, vec_id) order.

    Rows are dealt by range, so that a cell with many rows is spread over tasks; a pack holds
    rows of one cell, its ids as 64-bit integers and its vectors as doubles.
    """
    dealt = rows.select("cell", "vec_id", "v").repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(ids):
                continue
            data = matrix(batch.column(2))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
            out = [[], [], []]
            for a, b in zip(starts, starts[1:]):
                for at in range(a, b, size):
                    end = min(at + size, b)
                    out[0].append(int(cells[a]))
                    out[1].append(ids[at:end].tobytes())
                    out[2].append(data[at:end].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                                             names=["cell", "ids", "data"])

    return dealt.mapInArrow(run, PACK)


def unpack(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data).reshape(len(ids), -1)


def cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with ``cell``, the number of the nearest centre (centres come from a bounded sample)."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                near = squared(matrix(batch.column(1)), sent.value).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(near), batch.column(0), batch.column(1)], names=["cell", "vec_id", "v"])

    return rows.select("vec_id", "v").mapInArrow(run, "cell int, vec_id bigint, v array<double>")
