"""Registered queries: file inventories, filters and their aggregations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracelake.functions.paths import base_name, is_package_dir, package_of
from tracelake.functions.times import DAY
from tracelake.operators import inventory as I
from tracelake.operators import timeline as TL
from tracelake.plans.standins import CUT, blobs, cte, inventory, sql_package, sql_utc, table, timeline, urls
from tracelake.plans.strings import SQL_CATEGORY
from tracelake.registry import query
from tracelake.session import work_folder

SQL_CLASS = f"""CASE WHEN mtime >= {CUT} THEN 'recent' WHEN mtime < 86400 THEN 'epoch'
    WHEN mtime < 315532800 THEN 'installer' ELSE 'coherent' END"""
SQL_PART = """split_part(ltrim(path, '/'), '/', {n})"""


@query("s1_file_scan", "S1", "A4", since=CUT, oracle=cte("inventory") + f"""
  SELECT uid, count(*) AS files, count(*) FILTER (c = 'epoch') AS epoch, count(*) FILTER (c = 'installer') AS installer,
    count(*) FILTER (c = 'coherent') AS coherent, count(*) FILTER (c = 'recent') AS recent,
    CAST(coalesce(sum(size) FILTER (c = 'recent'), 0) AS BIGINT) AS recent_bytes,
    {sql_utc("min(mtime) FILTER (c = 'coherent')")} AS coherent_first,
    {sql_utc("max(mtime) FILTER (c = 'coherent')")} AS coherent_last
  FROM (SELECT *, {SQL_CLASS} AS c FROM inventory) GROUP BY uid""")
def file_scan(spark, sf, since):
    return I.file_scan(inventory(spark, sf), since, ["uid"])


@query("s1_shared_scan", "S1", "A4", "V5", "V6", since=CUT, oracle=cte("inventory") + f"""
  SELECT count(*) AS files, count(*) FILTER (c = 'epoch') AS epoch, count(*) FILTER (c = 'installer') AS installer, count(*) FILTER (c = 'coherent') AS coherent, count(*) FILTER (c = 'recent') AS recent,
    CAST(coalesce(sum(size) FILTER (c = 'recent'), 0) AS BIGINT) AS recent_bytes, count(*) FILTER (mtime IS NULL) AS skipped, count(*) FILTER (inode % 23 = 0) AS unreadable
  FROM (SELECT *, {SQL_CLASS} AS c FROM (SELECT * REPLACE (CASE WHEN inode % 31 = 0 THEN NULL ELSE mtime END AS mtime) FROM inventory))""")
def shared_scan(spark, sf, since):
    """The recent files are written to the shared folder; the counts come from that pass."""
    files = inventory(spark, sf).withColumn("mtime", F.when(F.col("inode") % 31 != 0, F.col("mtime")))
    return I.write_recent(files, since, f"{work_folder(spark)}/recent-{uuid.uuid4().hex}", F.col("inode") % 23 == 0)


@query("f1_recent_files", "F1", since=CUT, oracle=cte("inventory") + f"""
  SELECT path, mtime, size, {sql_utc('mtime')} AS mtime_utc, {sql_package('path')} AS package FROM inventory WHERE mtime >= {CUT}""")
def recent(spark, sf, since):
    return I.recent_files(inventory(spark, sf), since).select("path", "mtime", "size", "mtime_utc", "package")


@query("a4_class_breakdown", "A4", since=CUT, oracle=cte("inventory") + f""",
  c AS (SELECT *, {SQL_CLASS} AS class FROM inventory),
  f AS (SELECT 'coherent_year' AS facet, strftime(make_timestamp(mtime * CAST(1000000 AS BIGINT)), '%Y') AS key FROM c WHERE class = 'coherent'
    UNION ALL SELECT 'installer_value', {sql_utc('mtime')} FROM c WHERE class = 'installer'
    UNION ALL SELECT 'epoch_location', {SQL_PART.format(n=1)} FROM c WHERE class = 'epoch'
    UNION ALL SELECT 'installer_location', {SQL_PART.format(n=2)} FROM c WHERE class = 'installer'),
  r AS (SELECT facet, key, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, key) AS rank FROM f GROUP BY 1, 2)
  SELECT facet, key, n FROM r WHERE rank <= 8 OR facet = 'coherent_year'
  UNION ALL SELECT class || '_sample', path, n FROM (SELECT class, path, row_number() OVER (PARTITION BY class ORDER BY path) AS n
    FROM c WHERE class IN ('epoch', 'installer')) WHERE n <= 12""")
def breakdown(spark, sf, since):
    return I.class_breakdown(inventory(spark, sf), since)


@query("f2_kind_source", "F2", kind="login", source="purchase", oracle=cte("timeline") + """
  SELECT event_id, unix, source, kind FROM timeline WHERE kind = 'login' AND source = 'purchase'""")
def kind_source(spark, sf, kind, source):
    return TL.select_events(timeline(spark, sf), kind, source).select("event_id", "unix", "source", "kind")


@query("f3_prefix_markers", "F3", oracle=cte("inventory") + """
  SELECT inode, path FROM inventory WHERE starts_with(path, '/system/') OR contains(path, 'bluedroid') OR contains(path, 'procstats')""")
def prefix_markers(spark, sf):
    p = F.col("path")
    return inventory(spark, sf).filter(p.startswith("/system/") | p.contains("bluedroid") | p.contains("procstats")).select("inode", "path")


@query("f4_encrypted_writes", "F4", since=CUT, oracle=cte("inventory") + f"""
  SELECT {sql_package('path')} AS package, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM inventory
  WHERE mtime >= {CUT} AND size >= 4096 AND starts_with(path, '/data/') GROUP BY 1""")
def encrypted_writes(spark, sf, since):
    return I.encrypted_writes(inventory(spark, sf), since)


@query("f4_largest_encrypted", "F4", "O2", since=CUT, k=40, oracle=cte("inventory") + f"""
  SELECT path, size, {sql_utc('mtime')} AS mtime_utc FROM inventory WHERE mtime >= {CUT} AND size >= 4096
    AND starts_with(path, '/data/') ORDER BY size DESC, path LIMIT 40""")
def largest_encrypted(spark, sf, since, k):
    picked = I.largest(I.in_encrypted_area(inventory(spark, sf).filter(F.col("mtime") >= since)), k)
    from tracelake.functions.times import utc_text
    return picked.select("path", "size", utc_text(F.col("mtime")).alias("mtime_utc"))


@query("f7_package_dirs", "F7", oracle=cte("inventory", "urls") + """
  SELECT DISTINCT name FROM (SELECT split_part(ltrim(path, '/'), '/', 2) AS name FROM inventory
    UNION ALL SELECT regexp_extract(url, '//([^/?#]*)', 1) FROM urls
    UNION ALL SELECT CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN '.' || source WHEN 2 THEN 'com.' || source || ' x' ELSE 'com.' || lang END FROM documents)
  WHERE NOT starts_with(name, '.') AND name NOT IN ('media', 'misc', 'system', 'app', 'cache', 'data', 'sdcard')
    AND contains(name, '.') AND regexp_matches(name, '^[A-Za-z0-9._]+$') AND regexp_matches(name, '[A-Za-z0-9]')""")
def package_dirs(spark, sf):
    n = F.col("doc_id") % 4
    odd = table(spark, sf, "documents").select(
        F.when(n == 0, F.col("source")).when(n == 1, F.concat(F.lit("."), "source"))
        .when(n == 2, F.concat(F.lit("com."), "source", F.lit(" x"))).otherwise(F.concat(F.lit("com."), "lang")).alias("name"))
    names = (inventory(spark, sf).select(F.split_part(F.ltrim(F.col("path"), F.lit("/")), F.lit("/"), F.lit(2)).alias("name"))
             .unionAll(urls(spark, sf).select(F.regexp_extract("url", "//([^/?#]*)", 1))).unionAll(odd))
    return names.filter(is_package_dir(F.col("name"))).distinct()


@query("f12_system_files", "F12", since=CUT, oracle=cte("inventory") + f"""
  SELECT regexp_extract(path, '[^/]*$') AS name, {SQL_CATEGORY} AS category, {sql_utc('mtime')} AS utc, size
  FROM inventory WHERE mtime >= {CUT} AND NOT starts_with(path, '/data/')""")
def system_files(spark, sf, since):
    return I.system_files(inventory(spark, sf), since).select("name", "category", "utc", "size")


@query("f12_system_by_category", "F12", since=CUT, oracle=cte("inventory") + f"""
  SELECT {SQL_CATEGORY} AS category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(mtime) AS first_unix, max(mtime) AS last_unix
  FROM inventory WHERE mtime >= {CUT} AND NOT starts_with(path, '/data/') GROUP BY 1""")
def system_by_category(spark, sf, since):
    return I.system_files(inventory(spark, sf), since).groupBy("category").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("mtime").alias("first_unix"),
        F.max("mtime").alias("last_unix"))


@query("a10_deleted_summary", "A10", oracle=cte("inventory") + """,
  d AS (SELECT *, mtime + 864000 AS dtime FROM inventory WHERE status = 'F'),
  f AS (SELECT 'kind' AS facet, priority AS key, 1 AS w FROM d UNION ALL SELECT 'year', strftime(make_timestamp(dtime * CAST(1000000 AS BIGINT)), '%Y'), 1 FROM d
    UNION ALL SELECT 'owner', CAST(uid AS VARCHAR), 1 FROM d UNION ALL SELECT 'total', 'bytes', size FROM d
    UNION ALL SELECT 'total', 'entries', 1 FROM d)
  SELECT facet, key, n FROM (SELECT facet, key, CAST(sum(w) AS BIGINT) AS n,
    row_number() OVER (PARTITION BY facet ORDER BY sum(w) DESC, key) AS rank FROM f GROUP BY 1, 2) WHERE facet <> 'owner' OR rank <= 10""")
def deleted_summary(spark, sf):
    d = inventory(spark, sf).filter("status = 'F'").select(
        F.col("priority").alias("kind"), (F.col("mtime") + 10 * DAY).alias("dtime"), "uid", "size")
    return I.deleted_summary(d)


@query("a10_never_used_estimate", "A10", oracle=cte("inventory") + """
  SELECT count(*) FILTER (status <> 'O') AS free_total, count(*) FILTER (status = 'F') AS deleted_total,
    count(*) FILTER (status <> 'O') - count(*) FILTER (status = 'F') AS never_used_estimate FROM inventory""")
def never_used(spark, sf):
    agg = inventory(spark, sf).agg(F.count_if(F.col("status") != "O").alias("free_total"),
                                   F.count_if(F.col("status") == "F").alias("deleted_total"))
    return agg.withColumn("never_used_estimate", F.col("free_total") - F.col("deleted_total"))


@query("a12_zero_share", "A12", oracle=cte("blobs") + """
  SELECT z AS zero_blocks, n AS nonzero_blocks, t AS total, CASE WHEN z + n > 0 THEN round(z / (z + n), 6) ELSE 0 END AS zero_share,
    CAST(round_even(n * t / (z + n), 0) AS BIGINT) AS nonzero_estimate FROM (
    SELECT count(*) FILTER (zero) AS z, count(*) FILTER (NOT zero) AS n, (SELECT sum(n_chars) FROM documents)::BIGINT AS t FROM (
      SELECT regexp_matches(c, '^0+$') AS zero FROM (SELECT unnest(regexp_extract_all(hex(content), '.{64}')) AS c FROM blobs)))""")
def zero_share(spark, sf):
    cells = blobs(spark, sf).select(F.explode(F.regexp_extract_all(
        F.hex("content"), F.lit(".{64}"), F.lit(0))).alias("c")).select(F.col("c").rlike("^0+$").alias("zero"))
    total = table(spark, sf, "documents").agg(F.sum("n_chars"))
    return I.zero_share(cells, total)


@query("a13_counters", "A13", oracle="""
  SELECT f AS from_bitmaps, s AS from_superblock, g AS from_groups, f - s AS bitmaps_minus_superblock, f - g AS bitmaps_minus_groups,
    'from_bitmaps' AS authoritative FROM (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f,
      (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_linestatus = 'F') AS s,
      (SELECT CAST(sum(c_custkey % 9) AS BIGINT) FROM customer) AS g)""")
def counters(spark, sf):
    free = table(spark, sf, "orders").filter("o_orderstatus = 'F'").agg(F.count("*").alias("from_bitmaps"))
    declared = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").agg(F.countDistinct("l_orderkey"))
    grouped = table(spark, sf, "customer").agg(F.sum(F.col("c_custkey") % 9))
    return I.counters(free, declared, grouped)


@query("a14_attribute_census", "A14", oracle="""
  SELECT name, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT value) AS distinct_values FROM (
    SELECT unnest(['k', 'user', 'type']) AS name, unnest([json_extract_string(props, '$.k'), CAST(user_id AS VARCHAR), event_type]) AS value FROM events) GROUP BY 1""")
def attribute_census(spark, sf):
    props = F.from_json("props", "map<string,string>")
    own = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    return I.attribute_census(table(spark, sf, "events").select(F.map_concat(props, own).alias("attrs")), "attrs")


@query("a15_app_inventory", "A15", oracle=cte("inventory") + f"""
  SELECT {sql_package('path')} AS app, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
    count(*) FILTER (contains(path, '/databases/')) AS databases FROM inventory GROUP BY 1""")
def app_inventory(spark, sf):
    return I.app_inventory(inventory(spark, sf).withColumn("app", package_of(F.col("path"))), "app")


@query("a15_app_largest", "A15", k=12, oracle=cte("inventory") + f"""
  SELECT app, path, size, rank FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY size DESC, path) AS rank
    FROM (SELECT path, size, {sql_package('path')} AS app FROM inventory)) WHERE rank <= 12""")
def app_largest(spark, sf, k):
    files = inventory(spark, sf).select("path", "size", package_of(F.col("path")).alias("app"))
    return I.top_per(files, "app", k).withColumn("rank", F.col("rank").cast("long"))


@query("a16_major_types", "A16", oracle="""
  SELECT CASE WHEN coalesce(split_part(m, '/', 1), '') = '' THEN '?' ELSE split_part(m, '/', 1) END AS major, count(*) AS n FROM (
    SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN '' ELSE lower(p_type) || '/' || p_name END AS m FROM part) GROUP BY 1""")
def major_types(spark, sf):
    n = F.col("p_partkey") % 10
    mime = F.when(n == 1, "").when(n > 1, F.concat(F.lower("p_type"), F.lit("/"), "p_name"))
    return I.major_types(table(spark, sf, "part").select(mime.alias("mime")), "mime")


@query("a17_install_years", "A17", oracle="""
  SELECT strftime(first_seen, '%Y') AS year, count(*) AS apps, count(DISTINCT account) AS accounts FROM (
    SELECT o_custkey, min(o_orderdate) AS first_seen, o_custkey % 7 AS account FROM orders GROUP BY o_custkey) GROUP BY 1""")
def install_years(spark, sf):
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen"))
    return first.groupBy(F.date_format("first_seen", "yyyy").alias("year")).agg(
        F.count("*").alias("apps"), F.countDistinct(F.col("o_custkey") % 7).alias("accounts"))


@query("a17_install_accounts", "A17", oracle="""
  SELECT DISTINCT o_custkey % 7 AS account FROM orders WHERE o_custkey % 7 <> 0""")
def install_accounts(spark, sf):
    account = F.col("o_custkey") % 7
    return table(spark, sf, "orders").filter(account != 0).select(account.alias("account")).distinct()


@query("j6_crash_files", "J6", since=CUT, oracle=cte("inventory") + f"""
  SELECT name, path, {sql_utc('i.mtime')} AS utc, i.size AS size, 'com.p' || t.part AS process, CAST(t.part + 7 AS VARCHAR) AS pid, (t.part % 12) || ' (SIG' || (t.part % 3) || ')' AS signal, 'brand/' || p_brand AS build
  FROM (SELECT regexp_extract(path, '[^/]*$') AS name, path, mtime, size FROM inventory WHERE mtime >= {CUT}) i
  JOIN (SELECT 'f' || (p_partkey * 3) || CASE (p_partkey * 3) % 5 WHEN 0 THEN '.db' WHEN 1 THEN '.XML' WHEN 2 THEN '.json' ELSE '' END AS dump, p_partkey AS part, p_brand FROM part) t ON i.name = t.dump""")
def crash_files(spark, sf, since):
    from tracelake.operators.joins import crashes_in_window
    from tracelake.sources.textlogs import tombstone_fields
    n = F.col("p_partkey")
    ext = F.when(n * 3 % 5 == 0, ".db").when(n * 3 % 5 == 1, ".XML").when(n * 3 % 5 == 2, ".json").otherwise("")
    said = F.concat(F.lit("Build fingerprint: brand/"), "p_brand", F.lit("\npid: "), (n + 7).cast("string"), F.lit(", tid: 7, name: com.p"), n.cast("string"),
                    F.lit("  >>> x <<<\nsignal "), (n % 12).cast("string"), F.lit(" (SIG"), (n % 3).cast("string"), F.lit("), code 1"))
    dumps = table(spark, sf, "part").select(F.concat(F.lit("f"), (n * 3).cast("string"), ext).alias("name"), tombstone_fields(said).alias("t")).select("name", "t.*")
    files = inventory(spark, sf).filter(F.col("mtime") >= since).withColumn("name", base_name(F.col("path")))
    return crashes_in_window(files, dumps)
