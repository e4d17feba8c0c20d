"""Hits and runs: scan budgets, and hits that lie inside others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.session import cut_lineage


def within_budget(runs: DataFrame, by: list[str], budget: int, width: int = 1 << 20) -> DataFrame:
    """Blocks to scan per run in order until the budget is used; the rest is flagged, not hidden.

    The running total is taken inside chunks of the block range and over the chunk
    totals, so a volume with very many runs is split.
    """
    d = runs.withColumn("_chunk", F.floor(F.col("first") / width))
    totals = d.groupBy(*by, "_chunk").agg(F.sum("count").alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*by, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry"))
    own = W.partitionBy(*by, "_chunk").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    used = F.col("_carry") + F.coalesce(F.sum("count").over(own), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("count"), budget - used))
    placed = d.join(carried, [*by, "_chunk"]).withColumn("take", take)
    return placed.withColumn("complete", F.col("take") == F.col("count")).drop("_chunk", "_carry")


#: Hits of one slice: a task holds the offsets and ends of one.
SLICE = 1 << 16
NONE = np.iinfo(np.int64).min


def _successors(offsets: np.ndarray, ends: np.ndarray, complete: np.ndarray) -> np.ndarray:
    """For each hit the next one that is kept if this one is: the first at or past its end, or just the next if it is cut."""
    following = np.arange(1, len(offsets) + 1)
    return np.where(complete, np.maximum(following, np.searchsorted(offsets, ends, "left")), following)


def _exits(offsets: np.ndarray, ends: np.ndarray, complete: np.ndarray) -> np.ndarray:
    """For each hit of a slice the offset from which on a later slice goes on, if this hit is kept."""
    jump = _successors(offsets, ends, complete).tolist()
    leave = np.where(complete, ends, offsets).tolist()
    for i in range(len(leave) - 1, -1, -1):
        if jump[i] < len(leave):
            leave[i] = leave[jump[i]]
    return np.array(leave, np.int64)


def _groups(keys: np.ndarray):
    """(key, first, last) of each stretch of equal keys."""
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    yield from zip(keys[np.concatenate([[0], edge]).astype(int)] if len(keys) else (), [0, *edge], [*edge, len(keys)])


def _ends(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    complete = ~pdf["truncated"].to_numpy(bool)
    offsets = pdf["offset"].to_numpy(np.int64)
    return offsets, offsets + np.where(complete, pdf["length"].fillna(0).to_numpy(np.int64), 0), complete


def _plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strings as plain objects: an Arrow-backed column in pieces can't be sent back."""
    return pdf.astype({c: object for c in pdf.columns if isinstance(pdf[c].dtype, pd.StringDtype)})


def drop_nested(found: DataFrame, by: list[str], rows: int = SLICE) -> DataFrame:
    """Keep a hit unless it lies inside a kept, complete one before it (order: offset, kind, length, truncated).

    Whatever was kept before, a kept hit alone decides which one is kept next: the first at or past its
    end. The hits are dealt into slices of about ``rows`` in that order. A slice finds, for each of its
    hits, where the chain leaves it; these exits link slice to slice, and which of them are taken is
    found by doubling the links, in as many rounds as the number of slices has binary digits. So one
    island of overlapping hits is split like any other rows. ``truncated`` hits cover nothing.
    """
    order = ["_key", "offset", "kind", "length", "truncated"]
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    parts = max(1, -(-found.count() // rows))
    # The caller's columns travel under numbers, so that none can clash with those used here.
    names = [f"_{i}" for i in range(len(found.columns))]
    own = [key.alias("_key"), *[F.col(c).alias(c) for c in order[1:]], *[F.col(f"`{c}`").alias(n) for c, n in zip(found.columns, names)]]
    dealt = found.select(*own).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    d = cut_lineage(dealt.withColumn("_slice", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    narrow = d.select("_key", "_slice", "_row", "offset", "length", "truncated")

    def leaving(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", ignore_index=True)
        offsets, ends, complete = _ends(pdf)
        out = []
        for name, a, b in _groups(pdf["_key"].to_numpy(object)):
            exits = np.unique(_exits(offsets[a:b], ends[a:b], complete[a:b]))
            out.append(pd.DataFrame({"_key": name, "_slice": pdf["_slice"][0], "at": np.append(exits, offsets[b - 1]), "end": [False] * len(exits) + [True]}))
        return _plain(pd.concat(out))

    marks = narrow.groupBy("_slice").applyInPandas(leaving, "_key string, _slice int, at long, end boolean")
    marks = cut_lineage(marks)
    # A chain that leaves a slice goes on in the first later slice of its key that reaches the offset.
    after = W.partitionBy("_key").orderBy("at", "end", "_slice").rowsBetween(0, W.unboundedFollowing)
    later = W.partitionBy("_key").orderBy("_slice")
    reached = F.min(F.when(F.col("end"), F.col("_slice"))).over(after)
    lasts = marks.filter("end").select("_key", "_slice", F.lead("_slice").over(later).alias("next"), F.row_number().over(later).alias("n"))
    landed = (marks.withColumn("land", reached).filter("not end and land is not null").join(lasts, ["_key", "_slice"])
              .filter("next is not null").select("_key", "_slice", "at", F.greatest("land", "next").alias("land")))
    landed = cut_lineage(landed)
    starts = lasts.filter("n = 1").select("_key", "_slice", F.lit(int(NONE)).alias("at"))
    entries = landed.select("_key", F.col("land").alias("_slice"), "at").distinct()

    def crossing(rows_: pd.DataFrame, doors: pd.DataFrame) -> pd.DataFrame:
        rows_ = rows_.sort_values("_row", ignore_index=True)
        offsets, ends, complete = _ends(rows_)
        spans = {name: (a, b) for name, a, b in _groups(rows_["_key"].to_numpy(object))}
        out = []
        for name, mine in doors.groupby("_key"):
            a, b = spans[name]
            exits = _exits(offsets[a:b], ends[a:b], complete[a:b])
            first = np.searchsorted(offsets[a:b], mine["at"].to_numpy(np.int64), "left")
            out.append(pd.DataFrame({"_key": name, "_slice": mine["_slice"], "at": mine["at"], "to": exits[first]}))
        return _plain(pd.concat(out)) if out else pd.DataFrame({"_key": [], "_slice": [], "at": [], "to": []}).astype({"_key": object, "_slice": "int32", "at": "int64", "to": "int64"})

    doors = starts.unionByName(entries)
    crossed = narrow.groupBy("_slice").cogroup(doors.groupBy("_slice")).applyInPandas(crossing, "_key string, _slice int, at long, to long")
    ways = landed.withColumnRenamed("at", "to")
    jump = cut_lineage(crossed.join(ways, ["_key", "_slice", "to"]).select("_key", "_slice", "at", F.col("land").alias("slice2"), F.col("to").alias("at2")))
    taken = starts
    while not jump.isEmpty():
        taken = cut_lineage(taken.unionByName(taken.join(jump, ["_key", "_slice", "at"]).select("_key", F.col("slice2").alias("_slice"), F.col("at2").alias("at"))).distinct())
        second = jump.select("_key", F.col("_slice").alias("slice2"), F.col("at").alias("at2"), F.col("slice2").alias("slice3"), F.col("at2").alias("at3"))
        jump = cut_lineage(jump.join(second, ["_key", "slice2", "at2"]).select("_key", "_slice", "at", F.col("slice3").alias("slice2"), F.col("at3").alias("at2")))
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, found.schema.fields))

    def walk(rows_: pd.DataFrame, doors: pd.DataFrame) -> pd.DataFrame:
        rows_ = rows_.sort_values("_row", ignore_index=True)
        offsets, ends, complete = _ends(rows_)
        keep = np.zeros(len(rows_), bool)
        entry = dict(zip(doors["_key"], doors["at"]))
        for name, a, b in _groups(rows_["_key"].to_numpy(object)):
            if name in entry:
                jump_ = _successors(offsets[a:b], ends[a:b], complete[a:b]).tolist()
                i = int(np.searchsorted(offsets[a:b], entry[name], "left"))
                while i < len(jump_):
                    keep[a + i] = True
                    i = jump_[i]
        return _plain(rows_.loc[keep, names])

    kept = d.groupBy("_slice").cogroup(taken.groupBy("_slice")).applyInPandas(walk, schema)
    return kept.toDF(*found.columns)
