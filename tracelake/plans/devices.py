"""Registered queries over several devices whose ids collide.

Each given id ``n`` becomes id ``n div k`` on device ``n % k``, so every id stands on all devices and
only the device keeps them apart. Oracles use the given ids, which never collide.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import rules as R
from tracelake.functions.times import WEBKIT_DELTA
from tracelake.operators import browser as B
from tracelake.operators import joins as JO
from tracelake.operators import messages as M
from tracelake.operators import scan as S
from tracelake.operators import timeline as TL
from tracelake.plans.blocks import SQL_INDEX
from tracelake.plans.contents import NEEDLE
from tracelake.plans.contents import SQL_HITS as SQL_NEEDLES
from tracelake.plans.standins import BLOCK, cte, extents, histories, inventory, sql_utc, table, timeline, urls, visits
from tracelake.plans.strings import sql_codes
from tracelake.plans.timelines import sql_runs
from tracelake.registry import query

DEVICES = 3
BY = ["device"]


def device(n: Column) -> Column:
    return (n % DEVICES).alias("device")


def within(n: Column) -> Column:
    return F.call_function("div", n, F.lit(DEVICES))


def fleet(spark, sf):
    n = F.col("event_id")
    return timeline(spark, sf).withColumn("device", n % DEVICES).withColumn("event_id", within(n))


SQL_FLEET = cte("timeline") + f", fleet AS (SELECT * REPLACE (event_id // {DEVICES} AS event_id), event_id % {DEVICES} AS device FROM timeline)"


@query("a1_device_counts", "A1", oracle=SQL_FLEET + f""",
  a AS (SELECT device, unnest(['kind', 'source', 'package', 'day', 'hour']) AS axis, unnest([kind, source, package, substr({sql_utc('unix')}, 1, 10), substr({sql_utc('unix')}, 1, 13)]) AS key FROM fleet)
  SELECT device, axis, key, count(*) AS events FROM a GROUP BY ALL""")
def counts_by_axis(spark, sf):
    return TL.counts_by_axis(fleet(spark, sf), BY)


@query("o1_device_tail", "O1", n=20, oracle=SQL_FLEET + """
  SELECT device, event_id, unix, source, kind FROM fleet QUALIFY row_number() OVER (PARTITION BY device ORDER BY unix DESC, source DESC, event_id DESC) <= 20""")
def timeline_tail(spark, sf, n):
    return TL.timeline_tail(fleet(spark, sf), n, "event_id", BY).select("device", "event_id", "unix", "source", "kind")


@query("w4_device_last", "W4", oracle=SQL_FLEET + f"""
  SELECT device, source, unix, kind, detail, {sql_utc('unix')} AS utc FROM fleet QUALIFY row_number() OVER (PARTITION BY device, source ORDER BY unix DESC, event_id) = 1""")
def last_per_source(spark, sf):
    return TL.last_per_source(fleet(spark, sf), "event_id", BY)


@query("w5_device_latest", "W5", kind="crash", oracle=SQL_FLEET + """
  SELECT device, unix, event_id, source, kind, detail, package FROM fleet WHERE kind = 'crash' QUALIFY row_number() OVER (PARTITION BY device ORDER BY unix DESC, event_id DESC) = 1""")
def latest_event(spark, sf, kind):
    return TL.latest_event(fleet(spark, sf), "event_id", kind=kind, by=BY)


@query("w6_device_services", "W6", oracle=SQL_FLEET + f""",
  s AS (SELECT *, row_number() OVER (PARTITION BY device, package ORDER BY unix DESC, event_id) AS n,
    row_number() OVER (PARTITION BY device, package, kind IN ('login', 'token') ORDER BY unix DESC, event_id) AS a FROM fleet)
  SELECT device, package, count(*) AS events, {sql_utc('min(unix)')} AS first_utc, {sql_utc('max(unix)')} AS last_utc, max(source) FILTER (n = 1) AS last_source,
    max(detail) FILTER (n = 1) AS last_detail, max(kind) FILTER (n = 1) AS last_kind, count(*) FILTER (kind IN ('login', 'token')) AS auth_events,
    {sql_utc("max(unix) FILTER (kind IN ('login', 'token'))")} AS last_auth_utc, coalesce(max(kind) FILTER (a = 1 AND kind IN ('login', 'token')), '') AS last_auth_kind,
    array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM s GROUP BY device, package""")
def per_service(spark, sf):
    return TL.per_service(fleet(spark, sf), "event_id", BY)


def on_device(df, *ids: str):
    """``df`` with the device of its first id column; ids count inside the device."""
    df = df.withColumn("device", F.col(ids[0]) % DEVICES)
    return df.withColumns({c: within(F.col(c)) for c in ids})


@query("j8_device_visits", "J8", oracle=cte("visits", "urls") + f"""
  SELECT url_id % {DEVICES} AS device, visit_id, "user", url AS address FROM visits JOIN urls ON id = url_id""")
def visits_with_urls(spark, sf):
    v, u = on_device(visits(spark, sf), "url_id"), on_device(urls(spark, sf), "id")
    return B.visits_with_urls(v, u, BY).select("device", "visit_id", "user", "address")


@query("w2_device_sessions", "W2", gap=1800, oracle=cte("visits", "urls") + f""",
  v AS (SELECT url_id % {DEVICES} AS device, url_id % {DEVICES} || '-' || "user" AS owner, visit_time, visit_id, url AS address FROM visits JOIN urls ON id = url_id),
  {sql_runs('v', 'owner', 'visit_time', 1800 * 1000000)}
  SELECT device, split_part(owner, '-', 2) AS "user", run AS session, count(*) AS visits, count(DISTINCT regexp_extract(address, '//([^/?#]*)', 1)) AS hosts FROM r GROUP BY ALL""")
def device_sessions(spark, sf, gap):
    v, u = on_device(visits(spark, sf), "url_id"), on_device(urls(spark, sf), "id")
    by = ["device", "user"]
    return B.sessions(B.session_visits(v, u, by, gap, BY), u, by, store=BY).select("device", "user", "session", "visits", "hosts")


@query("j7_device_terms", "J7", oracle=cte("histories") + f"""
  SELECT id % {DEVICES} AS device, term, url, {sql_utc(f'(last_visit // 1000000 - {WEBKIT_DELTA})')} AS last_visit_utc, visit_count
  FROM histories JOIN (SELECT c_name AS term, c_custkey % (SELECT count(*) FROM pages) AS url_id FROM customer) ON id = url_id""")
def search_terms(spark, sf):
    n = table(spark, sf, "pages").agg(F.count("*")).scalar()
    terms = table(spark, sf, "customer").select(F.col("c_name").alias("term"), (F.col("c_custkey") % n).alias("url_id"))
    return B.search_terms(on_device(terms, "url_id"), on_device(histories(spark, sf), "id"), BY).drop("last_visit")


@query("j10_device_threads", "J10", oracle=f"""
  WITH c AS (SELECT DISTINCT conv_id AS n FROM conversations), p AS (SELECT n, n % {DEVICES} AS device, n // {DEVICES} AS id, unnest([0, 1, 2]) AS d FROM c),
  w AS (SELECT device, id, min('name ' || device || '-' || ((id + d) % 40)) FILTER ((id + d) % 4 <> 0) AS who FROM p GROUP BY 1, 2)
  SELECT device, 'GROUP:' || id AS thread_key, CASE WHEN id % 5 = 0 THEN 'topic ' || device ELSE coalesce(who, '') END AS name,
    CASE WHEN id % 5 = 0 THEN 'threads.name' WHEN who IS NOT NULL THEN 'thread_participants' ELSE '' END AS named_by FROM w""")
def name_threads(spark, sf):
    n = F.col("id")
    c = on_device(table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct(), "id")
    threads = c.select("device", "id", F.concat(F.lit("GROUP:"), n.cast("string")).alias("thread_key"), F.when(n % 5 == 0, F.concat(F.lit("topic "), F.col("device").cast("string"))).alias("name"))
    members = threads.select("device", "thread_key", F.explode(F.array(n, n + 1, n + 2)).alias("uid")).withColumn("user_key", F.concat(F.lit("U:"), F.col("uid").cast("string")))
    who = F.concat(F.lit("name "), F.col("device").cast("string"), F.lit("-"), (F.col("uid") % 40).cast("string"))
    users = members.filter("uid % 4 <> 0").select("device", "user_key", who.alias("name")).distinct()
    return M.name_threads(threads, members, users, BY)


@query("j12_device_profile", "J12", oracle=cte("timeline") + f""",
  m AS (SELECT event_id, event_id % {DEVICES} AS device, event_id // {DEVICES} % 5 AS code FROM timeline),
  f AS (SELECT DISTINCT device, code, CASE WHEN event_id % 2 = 0 THEN 'image' ELSE 'audio' END AS family FROM m WHERE event_id % 4 < 2),
  k AS (SELECT device, code, {sql_codes('code', R.NEWER_TYPES)} AS kind, count(*) AS messages FROM m GROUP BY ALL)
  SELECT k.device, k.code, kind, messages, coalesce((SELECT array_to_string(list_sort(list(family)), ',') FROM f WHERE f.device = k.device AND f.code = k.code), '') AS families FROM k""")
def type_profile(spark, sf):
    n = F.col("event_id")
    t = timeline(spark, sf)
    m = t.select(device(n), within(n).alias("message_id"), (within(n) % 5).alias("code"))
    media = t.filter(n % 4 < 2).select(device(n), within(n).alias("message_id"), F.when(n % 2 == 0, "image/png").otherwise("AUDIO/ogg").alias("mime"))
    return M.type_profile(m, media, R.NEWER_TYPES, BY).drop("disputed")


@query("j19_device_owners", "J19", oracle=cte("inventory") + f"""
  SELECT inode % {DEVICES} AS device, coalesce(n_name || ' ' || (inode % {DEVICES}), 'uid:' || uid) AS owner, count(*) AS files FROM inventory
  LEFT JOIN nation ON n_nationkey = uid AND inode % {DEVICES} <> 2 GROUP BY 1, 2""")
def named_owner(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("uid"), F.explode(F.array(*[F.lit(d).cast("long") for d in (0, 1)])).alias("device"), "n_name")
    names = names.select("uid", "device", F.concat_ws(" ", "n_name", F.col("device").cast("string")).alias("package"))
    files = on_device(inventory(spark, sf), "inode")
    return JO.named_owner(files, names, "uid", "package", BY).groupBy("device", "owner").agg(F.count("*").alias("files"))


@query("x3_device_report", "X3", oracle=cte("extents") + f""", {SQL_INDEX}, {SQL_NEEDLES.format(n=4, s=NEEDLE)},
  p AS (SELECT doc_id % {DEVICES} AS device, doc_id // {DEVICES} AS id, doc_id // {DEVICES} * {1000 * BLOCK} + "offset" AS place,
    replace(text[greatest("offset" - 64, 0) + 1 : greatest("offset" - 64, 0) + 132], '{NEEDLE}', '????') AS context FROM h),
  i AS (SELECT inode % {DEVICES} AS device, path, logical, physical // 1000 // {DEVICES} * 1000 + physical % 1000 AS physical, count FROM idx WHERE inode % 50 <> 49)
  SELECT p.device, id AS doc_id, place AS "offset", context, path, (logical + place // {BLOCK} - physical) * {BLOCK} + place % {BLOCK} AS file_offset
  FROM p LEFT JOIN i ON i.device = p.device AND place // {BLOCK} >= physical AND place // {BLOCK} < physical + count""")
def hit_report(spark, sf):
    """A document's text lies in the image where the blocks of the inode with its number do; both are renumbered per device.

    Inodes that share the blocks of another one (every 50th) are left out: their device is another.
    """
    d = on_device(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    # Blocks 1000 n.. of inode n move to 1000 (n div k).. on device n % k.
    e = extents(spark, sf).filter("inode % 50 <> 49").select(
        device(F.col("inode")), F.concat(F.lit("/data/f"), F.col("inode").cast("string")).alias("path"), (F.col("inode") * 100 + F.col("seq")).alias("rank"), "logical",
        (within(F.call_function("div", F.col("physical"), F.lit(1000))) * 1000 + F.col("physical") % 1000).alias("physical"), "count")
    return S.hit_report(d, "text", "doc_id", F.col("doc_id") * (1000 * BLOCK), NEEDLE, e, BLOCK, by=BY)
