"""Whole-table order without a single-task window.

Rows are range-partitioned on the full order (ending in a unique id, so even one
hot timestamp is split), checkpointed so the slices stay fixed, and neighbours
across slice edges are found from one row per slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.times import utc_text
from tracelake.session import cut_lineage


def ordered_slices(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in range-partitioned slices numbered in order (column ``_slice``)."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))


def _edge(per_slice: DataFrame, step: int) -> DataFrame:
    """Value of the slice before (1) or after (-1); one row per slice, so one small task."""
    return per_slice.select("_slice", F.lag("edge", step).over(W.orderBy("_slice")).alias("edge"))


def with_previous(slices: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``prev``: the named columns of the row before, across slice edges."""
    row = F.struct(*columns)
    tails = slices.groupBy("_slice").agg(F.max_by(row, F.struct(*order)).alias("edge"))
    inside = slices.withColumn("prev", F.lag(row).over(W.partitionBy("_slice").orderBy(*order)))
    # One row per shuffle partition: bounded by the partition count.
    return (inside.join(F.broadcast(_edge(tails, 1)), "_slice", "left")
            .withColumn("prev", F.coalesce("prev", "edge")).drop("edge"))


def chain_dedupe(df: DataFrame, by: list[str], tie: str, window: int = 0) -> DataFrame:
    """Drop an event that repeats the source and detail of the one before it.

    ``window`` limits the silence between the two (0 = any). The survivor keeps
    its fields and takes the latest time of its chain: the time of the row just
    before the next survivor.
    """
    order = [*by, "unix", "source", tie]
    # Edges are sent to every task: they carry a digest, not the free text.
    keyed = df.withColumn("_detail", F.sha2("detail", 256))
    seen = with_previous(ordered_slices(keyed, order), order, [*by, "unix", "source", "_detail"])
    same = (F.col("prev.source") == F.col("source")) & F.col("prev._detail").eqNullSafe(F.col("_detail"))
    for column in by:
        same = same & (F.col(f"prev.{column}") == F.col(column))
    if window:
        same = same & (F.col("unix") - F.col("prev.unix") <= window)
    kept = seen.filter(~F.coalesce(same, F.lit(False))).withColumn("_before", F.col("prev.unix")).drop("prev")
    following = F.lead("_before").over(W.partitionBy("_slice").orderBy(*order))
    heads = kept.groupBy("_slice").agg(F.min_by("_before", F.struct(*order)).alias("edge"))
    last = seen.agg(F.max_by("unix", F.struct(*order))).scalar()
    return (kept.withColumn("_next", following).join(F.broadcast(_edge(heads, -1)), "_slice", "left")
            .withColumn("last_unix", F.coalesce("_next", "edge", last))
            .withColumn("utc", utc_text(F.col("last_unix")))
            .drop("_slice", "_before", "_next", "edge", "_detail"))
