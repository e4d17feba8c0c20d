"""Gap-and-island operators built on time buckets.

Two events in one bucket of the gap's width can never be a gap apart, so only
consecutive non-empty buckets need comparing. Events are first aggregated to
buckets (map-side combine takes a hot key apart); the window then runs over
bucket rows, whose number is bounded by time span / gap and not by the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.times import local_text, utc_text


def bucket_of(time: str, gap: int) -> Column:
    """Start of the bucket; exact for whole numbers of any size and for negative times."""
    return F.col(time) - F.pmod(F.col(time), F.lit(gap))


def bucketed(df: DataFrame, by: list[str], time: str, gap: int, aggregates: list[Column]) -> DataFrame:
    """One row per key and non-empty bucket with its first and last time."""
    return df.groupBy(*by, bucket_of(time, gap).alias("_bucket")).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), *aggregates)


def numbered_runs(buckets: DataFrame, by: list[str], gap: int, name: str = "run") -> DataFrame:
    """Number the runs: a new one starts where the previous bucket ended more than gap ago."""
    order = W.partitionBy(*by).orderBy("_bucket")
    starts = buckets.withColumn(
        "_new", (F.col("_lo") - F.lag("_hi").over(order) > gap).cast("int"))
    return starts.withColumn(name, F.sum(F.coalesce("_new", F.lit(0))).over(order)).drop("_new")


def bursts(df: DataFrame, by: list[str], gap: int, time: str = "unix") -> DataFrame:
    """Runs of events with no silence longer than gap seconds, one row per run."""
    edge = F.struct(time, "source")
    buckets = bucketed(df, by, time, gap, [F.count("*").alias("_n"), F.min(edge).alias("_first"),
                                           F.max(edge).alias("_last")])
    runs = numbered_runs(buckets, by, gap)
    agg = runs.groupBy(*by, "run").agg(
        F.min("_lo").alias("start_unix"), F.max("_hi").alias("end_unix"), F.sum("_n").alias("events"),
        F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    return agg.select(
        *by, "run", "start_unix", "end_unix",
        utc_text(F.col("start_unix")).alias("start_utc"), utc_text(F.col("end_unix")).alias("end_utc"),
        local_text(F.col("start_unix")).alias("start_local"), local_text(F.col("end_unix")).alias("end_local"),
        "events", (F.col("end_unix") - F.col("start_unix")).alias("seconds"),
        F.col("_first.source").alias("first_source"), F.col("_last.source").alias("last_source"))


def burst_members(df: DataFrame, by: list[str], gap: int, member: Column, name: str,
                  time: str = "unix") -> DataFrame:
    """Distinct members (packages, hosts) of each run in long form: run, member, events.

    Members are counted per bucket before the runs are known, and the run number
    joins back on the bucket key, so no list ever grows with a run.
    """
    counted = (df.groupBy(*by, bucket_of(time, gap).alias("_bucket"), member.alias(name))
               .agg(F.count("*").alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi")))
    edges = counted.groupBy(*by, "_bucket").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    runs = numbered_runs(edges, by, gap).select(*by, "_bucket", "run")
    return (counted.join(runs, [*by, "_bucket"])
            .groupBy(*by, "run", name).agg(F.sum("_n").alias("events")))


def with_run(df: DataFrame, by: list[str], gap: int, time: str = "unix", name: str = "run") -> DataFrame:
    """Every event with its run number, joined back through the bucket table."""
    keyed = df.withColumn("_bucket", bucket_of(time, gap))
    edges = keyed.groupBy(*by, "_bucket").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    runs = numbered_runs(edges, by, gap, name).select(*by, "_bucket", name)
    return keyed.join(runs, [*by, "_bucket"]).drop("_bucket")


def hourly(df: DataFrame, by: list[str]) -> DataFrame:
    hour = F.substring(utc_text(F.col("unix")), 1, 13).alias("hour")
    return df.groupBy(*by, hour).agg(F.count("*").alias("events"))


def cluster_verdict(df: DataFrame, by: list[str], marker: Column, crash: Column,
                    hours: int = 10) -> DataFrame:
    """Real session or clock jump: a shutdown marker, or more than ten active hours."""
    per_hour = df.groupBy(*by, F.floor(F.col("unix") / 3600).alias("_h")).agg(
        F.count("*").alias("_n"), F.count_if(marker).alias("_m"), F.count_if(crash).alias("_c"),
        F.min("unix").alias("_lo"), F.max("unix").alias("_hi"))
    agg = per_hour.groupBy(*by).agg(
        F.sum("_n").alias("events"), F.count("*").alias("active_hours"),
        F.sum("_m").alias("shutdown_markers"), F.sum("_c").alias("crash_dumps"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    real = (F.col("shutdown_markers") > 0) | (F.col("active_hours") > hours)
    return agg.select(*by, "events", "active_hours", "shutdown_markers", "crash_dumps",
                      utc_text(F.col("_lo")).alias("first_utc"), utc_text(F.col("_hi")).alias("last_utc"),
                      F.when(real, "real_session").otherwise("clock_jump").alias("verdict"))


def snapshot_deltas(rows: DataFrame, by: list[str], snapshot: str, name: str) -> DataFrame:
    """Names added and removed against the previous snapshot, one row per change.

    A name seen in snapshot i and not in i-1 was added; one seen in i and not in
    i+1 was removed at i+1. Both are decided from the positions of one name, so
    no snapshot is ever collected into a list.
    """
    marks = rows.select(*by, snapshot).distinct()
    order = W.partitionBy(*by).orderBy(snapshot)
    places = marks.select(*by, snapshot, F.row_number().over(order).alias("_p"),
                          F.lead(snapshot).over(order).alias("_next"))
    seen = rows.select(*by, snapshot, name).distinct().join(places, [*by, snapshot])
    own = W.partitionBy(*by, name).orderBy("_p")
    edges = seen.withColumn("_before", F.lag("_p").over(own)).withColumn("_after", F.lead("_p").over(own))
    fresh = (F.col("_p") > 1) & ((F.col("_before").isNull()) | (F.col("_before") < F.col("_p") - 1))
    gone = F.col("_next").isNotNull() & (F.col("_after").isNull() | (F.col("_after") > F.col("_p") + 1))
    added = edges.filter(fresh).select(*by, snapshot, F.lit("added").alias("change"), name)
    removed = edges.filter(gone).select(*by, F.col("_next").alias(snapshot), F.lit("removed").alias("change"), name)
    return added.unionByName(removed)
