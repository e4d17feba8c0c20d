"""Registered queries: timelines, bursts and activity windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import bursts as BU
from tracelake.operators import timeline as TL
from tracelake.plans.standins import CUT, cte, inventory, sql_package, sql_span, sql_utc, table, timeline
from tracelake.plans.times import sql_local
from tracelake.registry import query

GAP = 21600


def sql_runs(source: str, by: str, time: str, gap: int) -> str:
    """``r``: every row of ``source`` with its run number."""
    part = f"PARTITION BY {by} " if by else ""
    return (f"r AS (SELECT *, CAST(sum(CASE WHEN g > {gap} THEN 1 ELSE 0 END) OVER ({part}ORDER BY {time} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM (SELECT *, {time} - lag({time}) OVER "
            f"({part}ORDER BY {time}) AS g FROM {source}))")


SQL_BURST = f"""count(*) AS events, min(unix) AS start_unix, max(unix) AS end_unix, {sql_utc('min(unix)')} AS start_utc,
  {sql_utc('max(unix)')} AS end_utc, max(unix) - min(unix) AS seconds,
  arg_min(source, {{'u': unix, 's': source}}) AS first_source, arg_max(source, {{'u': unix, 's': source}}) AS last_source"""


@query("w1_activity_bursts", "W1", gap=GAP, oracle=cte("timeline") + f", {sql_runs('timeline', 'package', 'unix', GAP)}"
       + f" SELECT package, run, {SQL_BURST} FROM r GROUP BY package, run")
def activity_bursts(spark, sf, gap):
    return BU.bursts(timeline(spark, sf), ["package"], gap).drop("start_local", "end_local")


@query("w1_device_bursts", "W1", gap=300, oracle=cte("timeline")
       + f", d AS (SELECT *, CAST(package AS BIGINT) % 3 AS device FROM timeline), {sql_runs('d', 'device', 'unix', 300)}"
       + f" SELECT device, run, {SQL_BURST} FROM r GROUP BY device, run")
def device_bursts(spark, sf, gap):
    d = timeline(spark, sf).withColumn("device", F.col("package").cast("long") % 3)
    return BU.bursts(d, ["device"], gap).drop("start_local", "end_local")


@query("w1_burst_packages", "W1", gap=300, oracle=cte("timeline")
       + f", d AS (SELECT *, CAST(package AS BIGINT) % 3 AS device FROM timeline), {sql_runs('d', 'device', 'unix', 300)}"
       + " SELECT device, run, package, count(*) AS events FROM r GROUP BY device, run, package")
def burst_packages(spark, sf, gap):
    d = timeline(spark, sf).withColumn("device", F.col("package").cast("long") % 3)
    return BU.burst_members(d, ["device"], gap, TL.owner(), "package")


@query("o5_largest_bursts", "O5", gap=GAP, k=8, oracle=cte("timeline") + f", {sql_runs('timeline', 'package', 'unix', GAP)}"
       + f" SELECT package, run, {SQL_BURST} FROM r GROUP BY package, run ORDER BY events DESC, package, run LIMIT 8")
def largest_bursts(spark, sf, gap, k):
    b = BU.bursts(timeline(spark, sf), ["package"], gap).drop("start_local", "end_local")
    return b.orderBy(F.desc("events"), "package", "run").limit(k)


@query("w4_last_per_source", "W4", oracle=cte("timeline") + f"""
  SELECT source, unix, kind, detail, {sql_utc('unix')} AS utc FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY unix DESC, event_id) AS r FROM timeline) WHERE r = 1""")
def last_per_source(spark, sf):
    return TL.last_per_source(timeline(spark, sf), "event_id")


@query("w5_latest_event", "W5", kind="crash", oracle=cte("timeline") + """
  SELECT unix, event_id, source, kind, detail, package FROM timeline WHERE kind = 'crash' ORDER BY unix DESC, event_id DESC LIMIT 1""")
def latest_event(spark, sf, kind):
    return TL.latest_event(timeline(spark, sf), "event_id", kind=kind)


@query("w6_per_service", "W6", oracle=cte("timeline") + f"""
  SELECT package, count(*) AS events, {sql_utc('min(unix)')} AS first_utc, {sql_utc('max(unix)')} AS last_utc,
    arg_max(source, unix * 1000000 - event_id) AS last_source, arg_max(detail, unix * 1000000 - event_id) AS last_detail,
    arg_max(kind, unix * 1000000 - event_id) AS last_kind, count(*) FILTER (kind IN ('login', 'token')) AS auth_events,
    {sql_utc("max(unix) FILTER (kind IN ('login', 'token'))")} AS last_auth_utc,
    coalesce(arg_max(kind, unix * 1000000 - event_id) FILTER (kind IN ('login', 'token')), '') AS last_auth_kind,
    array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM timeline GROUP BY package""")
def per_service(spark, sf):
    return TL.per_service(timeline(spark, sf), "event_id")


@query("a1_counts_by_axis", "A1", "A2", oracle=cte("timeline") + f""",
  a AS (SELECT 'kind' AS axis, kind AS key FROM timeline UNION ALL SELECT 'source', source FROM timeline
    UNION ALL SELECT 'package', package FROM timeline UNION ALL SELECT 'day', substr({sql_utc('unix')}, 1, 10) FROM timeline
    UNION ALL SELECT 'hour', substr({sql_utc('unix')}, 1, 13) FROM timeline)
  SELECT axis, key, count(*) AS events FROM a GROUP BY 1, 2""")
def counts_by_axis(spark, sf):
    return TL.counts_by_axis(timeline(spark, sf))


@query("a2_by_package", "A2", k=20, oracle=cte("timeline", "inventory") + f"""
  SELECT package, count(*) AS events FROM (SELECT CASE WHEN CAST(package AS BIGINT) % 5 = 0 THEN package ELSE '' END AS package FROM timeline
    UNION ALL SELECT {sql_package('path')} FROM inventory) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def by_package(spark, sf, k):
    t = timeline(spark, sf).select("source", F.when(F.col("package").cast("long") % 5 == 0, F.col("package")).otherwise("").alias("package"))
    f = inventory(spark, sf).select(F.col("path").alias("source"), F.lit("").alias("package"))
    counted = TL.merge_timelines(t, f).groupBy(TL.owner().alias("package")).agg(F.count("*").alias("events"))
    return TL.ranked(counted, "package", "events", k)


SQL_WINDOW = f"""count(*) AS events, {sql_utc('min({u})')} AS first_utc, {sql_utc('max({u})')} AS last_utc,
  {sql_local('min({u})')} AS first_local, {sql_local('max({u})')} AS last_local,
  coalesce(max({{u}}) - min({{u}}), 0) AS span_seconds, {sql_span('(max({u}) - min({u}))')} AS span_human""".replace("{{u}}", "{u}")


@query("a3_window_summary", "A3", oracle=cte("timeline") + f"SELECT kind, {SQL_WINDOW.replace('{u}', 'unix')} FROM timeline GROUP BY kind")
def window_summary(spark, sf):
    return TL.window_summary(timeline(spark, sf), ["kind"])


@query("o1_timeline_tail", "O1", n=50, oracle=cte("timeline") + """
  SELECT event_id, unix, source, kind, package, detail FROM timeline ORDER BY unix DESC, source DESC, event_id DESC LIMIT 50""")
def timeline_tail(spark, sf, n):
    return TL.timeline_tail(timeline(spark, sf), n, "event_id").select("event_id", "unix", "source", "kind", "package", "detail")


@query("u1_merged_timelines", "U1", oracle=cte("timeline", "inventory") + """
  SELECT source, count(*) AS events, min(unix) AS first_unix, max(unix) AS last_unix FROM (SELECT unix, source FROM timeline
    UNION ALL SELECT mtime, status FROM inventory WHERE mtime <> 0) GROUP BY 1""")
def merged(spark, sf):
    files = TL.make_events(inventory(spark, sf), F.col("mtime"), F.col("status"), F.lit("file_write"))
    both = TL.merge_timelines(timeline(spark, sf), files)
    return both.groupBy("source").agg(F.count("*").alias("events"), F.min("unix").alias("first_unix"), F.max("unix").alias("last_unix"))


@query("w9_final_writes", "W9", oracle=cte("timeline") + f"""
  SELECT t.package, event_id, unix, source, {sql_utc('unix')} AS utc FROM timeline t
  JOIN (SELECT package, max(unix) AS e FROM timeline GROUP BY 1) m ON t.package = m.package AND t.unix >= e - 3600""", seconds=3600)
def final_writes(spark, sf, seconds):
    from tracelake.functions.times import utc_text
    return TL.final_writes(timeline(spark, sf), ["package"], seconds).select(
        "package", "event_id", "unix", "source", utc_text(F.col("unix")).alias("utc"))


@query("w9_shutdown_summary", "W9", seconds=86400, k=30, oracle=cte("timeline") + f""",
  w AS (SELECT CAST(t.package AS BIGINT) % 3 AS device, * FROM timeline t), x AS (SELECT w.* FROM w
    JOIN (SELECT device, max(unix) AS e FROM w GROUP BY 1) m ON w.device = m.device AND w.unix >= e - 86400)
  SELECT device, count(*) AS files, {sql_utc('min(unix)')} AS first_utc, {sql_utc('max(unix)')} AS last_utc,
    count(DISTINCT package) AS services, (SELECT count(*) FROM (SELECT event_id FROM x y WHERE y.device = x.device ORDER BY unix, event_id LIMIT 30)) AS listed
  FROM x GROUP BY device""")
def shutdown_summary(spark, sf, seconds, k):
    d = timeline(spark, sf).withColumn("device", F.col("package").cast("long") % 3)
    tail = TL.final_writes(d, ["device"], seconds)
    from tracelake.functions.times import utc_text
    summary = tail.groupBy("device").agg(
        F.count("*").alias("files"), F.min("unix").alias("lo"), F.max("unix").alias("hi"),
        F.countDistinct("package").alias("services"))
    listed = (TL.first_k_per(tail, ["device"], [F.asc("unix"), F.asc("event_id")], k)
              .groupBy("device").agg(F.count("*").alias("listed")))
    return summary.join(listed, "device").select(
        "device", "files", utc_text(F.col("lo")).alias("first_utc"), utc_text(F.col("hi")).alias("last_utc"), "services", "listed")


@query("w10_cluster_verdict", "W10", oracle=cte("timeline") + f"""
  SELECT package, count(*) AS events, count(DISTINCT unix // 3600) AS active_hours,
    count(*) FILTER (detail LIKE '%"k": 7}}') AS shutdown_markers, count(*) FILTER (kind = 'crash') AS crash_dumps,
    {sql_utc('min(unix)')} AS first_utc, {sql_utc('max(unix)')} AS last_utc,
    CASE WHEN count(*) FILTER (detail LIKE '%"k": 7}}') > 0 OR count(DISTINCT unix // 3600) > 60 THEN 'real_session' ELSE 'clock_jump' END AS verdict
  FROM timeline GROUP BY package""", hours=60)
def cluster_verdict(spark, sf, hours):
    return BU.cluster_verdict(timeline(spark, sf), ["package"], F.col("detail").endswith('"k": 7}'),
                              F.col("kind") == "crash", hours)


@query("w10_busiest_hours", "W10", k=6, oracle=cte("timeline") + f"""
  SELECT package, hour, events FROM (SELECT package, hour, count(*) AS events, row_number() OVER (PARTITION BY package ORDER BY count(*) DESC, hour) AS r
    FROM (SELECT package, substr({sql_utc('unix')}, 1, 13) AS hour FROM timeline) GROUP BY 1, 2) WHERE r <= 6""")
def busiest_hours(spark, sf, k):
    counted = BU.hourly(timeline(spark, sf), ["package"])
    return TL.first_k_per(counted, ["package"], [F.desc("events"), F.asc("hour")], k).drop("position")


@query("w12_snapshot_deltas", "W12", oracle=cte("timeline") + """,
  s AS (SELECT DISTINCT CAST(package AS BIGINT) % 3 AS device, unix // 86400 AS day, package AS name FROM timeline),
  d AS (SELECT device, day, lag(day) OVER (PARTITION BY device ORDER BY day) AS prev FROM (SELECT DISTINCT device, day FROM s))
  SELECT d.device, d.day, 'added' AS change, s.name FROM d JOIN s ON s.device = d.device AND s.day = d.day
    WHERE d.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s p WHERE p.device = d.device AND p.day = d.prev AND p.name = s.name)
  UNION ALL SELECT d.device, d.day, 'removed', p.name FROM d JOIN s p ON p.device = d.device AND p.day = d.prev
    WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.device = d.device AND s.day = d.day AND s.name = p.name)""")
def snapshot_deltas(spark, sf):
    rows = timeline(spark, sf).select(
        (F.col("package").cast("long") % 3).alias("device"), F.floor(F.col("unix") / 86400).alias("day"),
        F.col("package").alias("name"))
    return BU.snapshot_deltas(rows, ["device"], "day", "name")


@query("a27_usage_window", "A27", "S5", oracle=cte("timeline") + f""",
  u AS (SELECT package, max(micros // 1000) AS ms FROM timeline WHERE event_id % 10 <> 9 GROUP BY package)
  SELECT count(*) AS packages, {sql_utc('min(ms // 1000)')} AS first_utc, {sql_utc('max(ms // 1000)')} AS last_utc,
    {sql_span('(max(ms // 1000) - min(ms // 1000))')} AS span_human FROM u WHERE ms // 1000 >= 1704067200""", since=1704067200)
def usage_window(spark, sf, since):
    from tracelake.plans.logs import usage_list
    used = usage_list(spark, sf).groupBy("package").agg((F.floor(F.max("last_used_ms") / 1000)).alias("unix"))
    w = TL.window_summary(used.filter(F.col("unix") >= since))
    return w.select(F.col("events").alias("packages"), "first_utc", "last_utc", "span_human")


@query("a20_network_verdict", "A20", oracle=cte("timeline") + f""",
  m AS (SELECT package, max(unix) FILTER (source = 'signup') AS lease, max(unix) FILTER (source = 'view') AS checkin, max(unix) FILTER (kind = 'login') AS token FROM timeline GROUP BY 1)
  SELECT package, round((1706400000 - lease) / 86400, 1) + 0.0 AS lease_days, round((1706400000 - checkin) / 86400, 1) + 0.0 AS checkin_days,
    round((1706400000 - token) / 86400, 1) + 0.0 AS token_days, coalesce(lease > 1706400000, false) OR coalesce(checkin > 1706400000, false) OR coalesce(token > 1706400000, false) AS online FROM m""",
       floor=1706400000)
def network_verdict(spark, sf, floor):
    from tracelake.operators.verdicts import network_verdict as verdict
    return verdict(timeline(spark, sf), "package", floor, {
        "lease": F.col("source") == "signup", "checkin": F.col("source") == "view", "token": F.col("kind") == "login"})


@query("a22_stability_verdict", "A22", since=1705276800, oracle=cte("timeline") + """
  SELECT package, count(*) FILTER (source = 'signup') AS reboots, count(*) FILTER (kind = 'crash' AND unix >= 1705276800) AS crashes_in_session,
    CASE WHEN count(*) FILTER (source = 'signup') > 1 OR count(*) FILTER (kind = 'crash' AND unix >= 1705276800) > 0 THEN 'unstable_session' ELSE 'stable_session' END AS verdict
  FROM timeline GROUP BY package""")
def stability(spark, sf, since):
    from tracelake.operators.verdicts import stability_verdict
    return stability_verdict(timeline(spark, sf), "package", F.col("source") == "signup", F.col("kind") == "crash", since)
