"""Event tables: building, ordering, merging and the usual summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.paths import package_of
from tracelake.functions.times import epoch_seconds, local_text, span_human, utc_text

AUTH_KINDS = ("login", "token")


def make_events(df: DataFrame, stamp: Column, source: Column, kind: Column,
                detail: Column | None = None, package: Column | None = None,
                keep: list[str] = ()) -> DataFrame:
    """Event rows from a stamp of unknown unit; rows without a usable time are dropped."""
    parsed = df.select(
        *keep, epoch_seconds(stamp).alias("_s"), source.alias("source"), kind.alias("kind"),
        (detail if detail is not None else F.lit("")).alias("detail"),
        stamp.cast("string").alias("raw"),
        (package if package is not None else F.lit("")).alias("package"))
    return (parsed.filter(F.col("_s.unix") != 0)
            .select(*keep, F.col("_s.unix").alias("unix"), F.col("_s.unit").alias("unit"),
                    "source", "kind", "detail", "raw", "package"))


def owner() -> Column:
    """The event's package: the explicit one, else the one its source path names."""
    return F.coalesce(F.when(F.col("package") != "", F.col("package")),
                      package_of(F.col("source")))


def select_events(df: DataFrame, kind: str = "", source: str = "") -> DataFrame:
    if kind:
        df = df.filter(F.col("kind") == kind)
    if source:
        df = df.filter(F.col("source") == source)
    return df


def counts_by_axis(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts by kind, source, package, day and hour in one pass over the events, per ``by`` (a device, say)."""
    utc = utc_text(F.col("unix"))
    axes = {"kind": F.col("kind"), "source": F.col("source"), "package": owner(),
            "day": F.substring(utc, 1, 10), "hour": F.substring(utc, 1, 13)}
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(name).alias("axis"), value.alias("key")) for name, value in axes.items()
    ])).alias("a")).select(*by, "a.axis", "a.key")
    return (long.filter(~(F.col("axis").isin("day", "hour") & (F.col("key") == "")))
            .groupBy(*by, "axis", "key").agg(F.count("*").alias("events")))


def ranked(df: DataFrame, key: str, count: str, k: int) -> DataFrame:
    """Top k rows by count, ties by key."""
    return df.orderBy(F.desc(count), F.asc(key)).limit(k)


def window_summary(df: DataFrame, by: list[str] = (), unix: str = "unix") -> DataFrame:
    agg = df.groupBy(*by).agg(F.count("*").alias("events"), F.min(unix).alias("first_unix"),
                              F.max(unix).alias("last_unix"))
    span = F.coalesce(F.col("last_unix") - F.col("first_unix"), F.lit(0))
    return agg.select(
        *by, "events",
        utc_text(F.col("first_unix")).alias("first_utc"),
        utc_text(F.col("last_unix")).alias("last_utc"),
        local_text(F.col("first_unix")).alias("first_local"),
        local_text(F.col("last_unix")).alias("last_local"),
        span.alias("span_seconds"), span_human(span).alias("span_human"))


def timeline_tail(df: DataFrame, n: int, tie: str, by: list[str] = ()) -> DataFrame:
    """The last n events in timeline order (per ``by``); a top-n, never a full sort."""
    order = [F.desc("unix"), F.desc("source"), F.desc(tie)]
    return first_k_per(df, by, order, n, "_place").drop("_place") if by else df.orderBy(*order).limit(n)


def last_per_source(df: DataFrame, tie: str, by: list[str] = ()) -> DataFrame:
    """Newest event of each source (per ``by``), ties to the first seen."""
    newest = F.max(F.struct("unix", (-F.col(tie)).alias("t"), "kind", "detail")).alias("m")
    return (df.groupBy(*by, "source").agg(newest)
            .select(*by, "source", F.col("m.unix").alias("unix"), F.col("m.kind").alias("kind"),
                    F.col("m.detail").alias("detail"), utc_text(F.col("m.unix")).alias("utc")))


def latest_event(df: DataFrame, tie: str, kind: str = "", source: str = "", by: list[str] = ()) -> DataFrame:
    """The newest matching event, ties to the last seen: one row, or one per ``by``."""
    chosen = F.max(F.struct("unix", tie, "source", "kind", "detail", "package")).alias("m")
    return (select_events(df, kind, source).groupBy(*by).agg(chosen).filter("m is not null").select(*by, "m.*"))


def per_service(df: DataFrame, tie: str, by: list[str] = ()) -> DataFrame:
    """Per package (and ``by``): last touch kept apart from last authentication."""
    first_seen = (-F.col(tie)).alias("t")
    seen = F.struct("unix", first_seen, "source", "detail", "kind")
    auth = F.col("kind").isin(*AUTH_KINDS)
    agg = (df.withColumn("package", F.when(F.col("package") == "", "other").otherwise(F.col("package")))
           .groupBy(*by, "package")
           .agg(F.count("*").alias("events"), F.min("unix").alias("first_unix"),
                F.max(seen).alias("l"), F.count_if(auth).alias("auth_events"),
                F.max(F.when(auth, seen)).alias("a"),
                F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")))
    return agg.select(
        *by, "package", "events", utc_text(F.col("first_unix")).alias("first_utc"),
        utc_text(F.col("l.unix")).alias("last_utc"), F.col("l.source").alias("last_source"),
        F.col("l.detail").alias("last_detail"), F.col("l.kind").alias("last_kind"),
        "auth_events", utc_text(F.col("a.unix")).alias("last_auth_utc"),
        F.coalesce(F.col("a.kind"), F.lit("")).alias("last_auth_kind"), "kinds")


def merge_timelines(*frames: DataFrame) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def completeness(events: DataFrame, errors: DataFrame, by: str) -> DataFrame:
    """Per case: event count, read errors, and whether every source was read."""
    good = events.groupBy(by).agg(F.count("*").alias("events"))
    bad = errors.groupBy(by).agg(F.count("*").alias("read_errors"))
    joined = good.join(bad, by, "full_outer")
    return joined.select(by, F.coalesce("events", F.lit(0)).alias("events"),
                         F.coalesce("read_errors", F.lit(0)).alias("read_errors"),
                         F.col("read_errors").isNull().alias("complete"))


def final_writes(df: DataFrame, by: list[str], seconds: int = 120) -> DataFrame:
    """Rows within the last seconds of each case; the maxima come back as one row per case."""
    last = df.groupBy(*by).agg(F.max("unix").alias("end_unix"))
    return df.join(last, by).filter(F.col("unix") >= F.col("end_unix") - seconds)


def first_k_per(df: DataFrame, by: list[str], order: list[Column], k: int,
                name: str = "position") -> DataFrame:
    """First k rows per group; Spark limits each map task before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)
