"""Registered queries: time projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import times as T
from tracelake.functions.paths import human_bytes
from tracelake.operators import timeline as TL
from tracelake.plans.standins import (cte, inventory, sql_span, sql_utc, stamps, table, timeline)
from tracelake.registry import query

SQL_PARSED = """SELECT event_id,
  CASE WHEN raw IS NULL OR raw = '' THEN 0
       WHEN regexp_matches(raw, '^\\d{4}[-/: ]') THEN coalesce(CAST(epoch_us(try_cast(replace(raw, 'Z', '') AS TIMESTAMP)) // 1000000 AS BIGINT), 0)
       WHEN try_cast(raw AS DOUBLE) IS NULL THEN 0
       WHEN CAST(raw AS DOUBLE) <= 0 THEN CAST(trunc(CAST(raw AS DOUBLE)) AS BIGINT)
       WHEN CAST(raw AS DOUBLE) < 1e11 THEN CAST(trunc(CAST(raw AS DOUBLE)) AS BIGINT)
       WHEN CAST(raw AS DOUBLE) < 1e14 THEN CAST(trunc(CAST(raw AS DOUBLE) / 1e3) AS BIGINT)
       ELSE CAST(trunc(CAST(raw AS DOUBLE) / 1e6) AS BIGINT) END AS unix,
  CASE WHEN raw IS NULL OR raw = '' THEN ''
       WHEN regexp_matches(raw, '^\\d{4}[-/: ]') THEN 'iso'
       WHEN try_cast(raw AS DOUBLE) IS NULL THEN ''
       WHEN CAST(raw AS DOUBLE) < 1e11 THEN 's' WHEN CAST(raw AS DOUBLE) < 1e14 THEN 'ms' ELSE 'us' END AS unit,
  CASE WHEN raw IS NULL OR raw = '' THEN false
       WHEN regexp_matches(raw, '^\\d{4}[-/: ]') THEN true
       ELSE coalesce(try_cast(raw AS DOUBLE) <> 0, false) END AS ok,
  raw, source, kind, detail, package FROM stamps"""


@query("p1_epoch_seconds", "P1", oracle=cte("stamps") + f"SELECT event_id, unix, unit, ok FROM ({SQL_PARSED})")
def epoch_seconds(spark, sf):
    s = stamps(spark, sf).select("event_id", T.epoch_seconds(F.col("raw")).alias("s"))
    return s.select("event_id", "s.unix", "s.unit", "s.ok")


@query("p2_epoch_auto", "P2", oracle=cte("stamps") + """
  SELECT event_id, CASE WHEN n <= 0 OR n / 1e3 > 253402300799 THEN '' ELSE strftime(make_timestamp(
      CAST(floor(CASE WHEN n < 1e11 THEN n ELSE n / 1e3 END) AS BIGINT) * CAST(1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') END AS utc,
    CASE WHEN n <= 0 THEN '' WHEN n < 1e11 THEN 's' ELSE 'ms' END AS unit
  FROM (SELECT event_id, coalesce(try_cast(raw AS DOUBLE), 0) AS n FROM stamps)""")
def epoch_auto(spark, sf):
    return stamps(spark, sf).select("event_id", T.epoch_auto(F.col("raw")).alias("s")).select("event_id", "s.utc", "s.unit")


@query("p3_webkit_time", "P3", oracle=cte("stamps") + f"""
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE {sql_utc('unix')} END AS utc FROM stamps""")
def webkit_time(spark, sf):
    col = F.when(F.col("event_id") % 7 != 0, F.col("webkit"))
    return stamps(spark, sf).select("event_id", T.webkit_time(col).alias("utc"))


@query("p4_utc_text", "P4", oracle=cte("inventory") + f"""
  SELECT inode, {sql_utc('mtime')} AS utc, {sql_utc('mtime')} AS utc_ms FROM inventory""")
def utc_text(spark, sf):
    return inventory(spark, sf).select(
        "inode", T.utc_text(F.col("mtime")).alias("utc"),
        T.utc_ms_text(F.col("mtime") * 1000 + 999).alias("utc_ms")).withColumn(
        "utc_ms", F.when(F.col("utc") == "", "").otherwise(F.col("utc_ms")))


def sql_local(expr: str) -> str:
    ts = f"make_timestamp(CAST({expr} AS BIGINT) * CAST(1000000 AS BIGINT))"
    sunday = lambda m: (f"(make_date(year({ts}), {m}, 31) - CAST(dayofweek(make_date(year({ts}), {m}, 31)) AS INTEGER))"
                        f" + INTERVAL 1 HOUR")
    return (f"CASE WHEN ({expr}) IS NULL OR ({expr}) = 0 THEN '' ELSE strftime({ts} + CASE WHEN {ts} >= {sunday(3)} "
            f"AND {ts} < {sunday(10)} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') END")


@query("p5_local_text", "P5", oracle=cte("inventory") + f"SELECT inode, {sql_local('mtime')} AS local FROM inventory")
def local_text(spark, sf):
    return inventory(spark, sf).select("inode", T.local_text(F.col("mtime")).alias("local"))


@query("p6_span_human", "P6", oracle=cte("inventory") + f"""
  SELECT inode, {sql_span('(size % 700000 - 1000)')} AS span FROM inventory""")
def span_human(spark, sf):
    return inventory(spark, sf).select("inode", T.span_human(F.col("size") % 700000 - 1000).alias("span"))


@query("p7_human_bytes", "P7", oracle="""
  SELECT doc_id, CASE WHEN b < 1024 THEN replace(format('{:,.2f}', b), ',', ' ') || ' B'
    WHEN b < 1048576 THEN replace(format('{:,.2f}', b / 1024.0), ',', ' ') || ' KiB'
    WHEN b < 1073741824 THEN replace(format('{:,.2f}', b / 1048576.0), ',', ' ') || ' MiB'
    WHEN b < 1099511627776 THEN replace(format('{:,.2f}', b / 1073741824.0), ',', ' ') || ' GiB'
    ELSE replace(format('{:,.2f}', b / 1099511627776.0), ',', ' ') || ' TiB' END AS human
  FROM (SELECT doc_id, CAST(n_chars * (CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 65536
    WHEN 3 THEN 67108864 ELSE 137438953472 END) AS DOUBLE) AS b FROM documents)""")
def human(spark, sf):
    scale = (F.when(F.col("doc_id") % 5 == 0, 1).when(F.col("doc_id") % 5 == 1, 64)
             .when(F.col("doc_id") % 5 == 2, 65536).when(F.col("doc_id") % 5 == 3, 67108864)
             .otherwise(137438953472))
    return table(spark, sf, "documents").select(
        "doc_id", human_bytes(F.col("n_chars") * scale).alias("human"))


@query("p8_zoned_epoch", "P8", oracle=cte("timeline") + """
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN unix WHEN 1 THEN unix - 3600 WHEN 2 THEN unix - 7200 END AS unix
  FROM timeline""")
def zoned_epoch(spark, sf):
    zone = (F.when(F.col("event_id") % 5 == 0, "UTC").when(F.col("event_id") % 5 == 1, "CET")
            .when(F.col("event_id") % 5 == 2, "CEST").when(F.col("event_id") % 5 == 3, "EST").otherwise(""))
    text = F.concat(F.date_format(F.timestamp_seconds("unix"), "yyyy-MM-dd HH:mm:ss"),
                    F.lit(".000000000 ("), zone, F.lit(")"))
    return timeline(spark, sf).select("event_id", T.zoned_epoch(text).alias("unix"))


@query("p9_cutoff", "P9", oracle=cte("inventory") + """
  SELECT inode, CASE inode % 4 WHEN 0 THEN m WHEN 1 THEN m WHEN 2 THEN m // 86400 * 86400 ELSE 0 END AS cut
  FROM (SELECT inode, mtime AS m FROM inventory)""")
def cutoff(spark, sf):
    ts, n = F.timestamp_seconds("mtime"), F.col("inode") % 4
    text = (F.when(n == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(n == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(n == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "dd.MM.yyyy")))
    return inventory(spark, sf).select("inode", T.cutoff(text).alias("cut"))


@query("p10_make_events", "P10", oracle=cte("stamps") + f"""
  SELECT event_id, unix, unit, source, kind, detail, raw, package FROM ({SQL_PARSED}) WHERE unix <> 0""")
def make_events(spark, sf):
    return TL.make_events(stamps(spark, sf), F.col("raw"), F.col("source"), F.col("kind"),
                          F.col("detail"), F.col("package"), keep=["event_id"])


@query("p11_time_class", "P11", oracle=cte("inventory") + """
  SELECT inode, CASE WHEN mtime >= 978307200 THEN 'recent' WHEN mtime < 86400 THEN 'epoch'
    WHEN mtime < 315532800 THEN 'installer' ELSE 'coherent' END AS class FROM inventory""", since=978307200)
def time_class(spark, sf, since):
    return inventory(spark, sf).select("inode", T.time_class(F.col("mtime"), since).alias("class"))


@query("p12_plausible", "P12", oracle=cte("messages") + """
  SELECT thread, turn, CASE WHEN ms IS NULL OR ms = 0 THEN 'zero' WHEN ms < 1420070400000 THEN 'implausible'
    ELSE 'ok' END AS verdict FROM messages""")
def plausible(spark, sf):
    from tracelake.plans.standins import messages
    return messages(spark, sf).select("thread", "turn", T.plausible(F.col("ms")).alias("verdict"))


@query("s17_name_stamps", "S17", oracle=cte("timeline") + """
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN micros // 1000 END AS stamp_ms,
    CASE WHEN event_id % 3 = 1 THEN strftime(make_timestamp(unix * CAST(1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') ELSE '' END AS local_time
  FROM timeline""")
def name_stamps(spark, sf):
    t = timeline(spark, sf)
    n = F.col("event_id") % 3
    name = (F.when(n == 0, F.concat(F.lit("dev."), F.floor(F.col("micros") / 1000).cast("string"), F.lit("-")))
            .when(n == 1, F.concat(F.lit("state-"), F.date_format(F.timestamp_seconds("unix"),
                                                                   "yyyy-MM-dd-HH-mm-ss"), F.lit(".bin")))
            .otherwise("state-none.bin"))
    return t.select("event_id", T.name_stamp_ms(name).alias("stamp_ms"),
                    T.name_local_time(name).alias("local_time"))
