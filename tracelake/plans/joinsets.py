"""Registered queries: joins, set operations and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import compare as C
from tracelake.operators import joins as JO
from tracelake.operators import timeline as TL
from tracelake.operators.ordered import chain_dedupe
from tracelake.plans.standins import cte, inventory, sql_utc, table, timeline
from tracelake.registry import query

DAY_UNIX = "CAST(epoch_us({}) // 1000000 AS BIGINT)"


def unix_of(column):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def installs(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.min(unix_of("l_shipdate")).alias("install_unix"), F.max(unix_of("l_shipdate")).alias("update_unix"))


SQL_INSTALLS = f"""installs AS (SELECT l_partkey AS part, min({DAY_UNIX.format('l_shipdate')}) AS install_unix,
  max({DAY_UNIX.format('l_shipdate')}) AS update_unix FROM lineitem GROUP BY 1)"""


@query("j1_install_state", "J1", oracle=f"""WITH {SQL_INSTALLS}
  SELECT part, install_unix, d.k IS NOT NULL AS data_dir_present, u.ms IS NOT NULL AS usage_list_entry, u.ms AS last_used_ms,
    CASE WHEN d.k IS NOT NULL THEN 'data_dir_present' WHEN u.ms IS NOT NULL THEN 'gone_but_listed' ELSE 'no_data_dir' END AS state
  FROM installs LEFT JOIN (SELECT p_partkey AS k FROM part WHERE p_size % 3 <> 0) d ON d.k = part
  LEFT JOIN (SELECT l_suppkey * 7 AS k, max(l_orderkey) * 1000 AS ms FROM lineitem GROUP BY 1) u ON u.k = part""")
def install_state(spark, sf):
    inst = installs(spark, sf).drop("update_unix")
    dirs = table(spark, sf, "part").filter("p_size % 3 <> 0").select(F.col("p_partkey").alias("part"))
    used = table(spark, sf, "lineitem").select((F.col("l_suppkey") * 7).alias("part"), (F.col("l_orderkey") * 1000).alias("last_used_ms"))
    return JO.install_state(inst, dirs, used, "part")


@query("j2_gone", "J2", oracle="""
  SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def gone(spark, sf):
    present = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return JO.gone(table(spark, sf, "customer").select("c_custkey", "c_name"), present, "c_custkey")


SQL_CLOCK = f"""{SQL_INSTALLS}, d AS (SELECT p_partkey AS part, install_unix + p_partkey % 1800 AS mtime FROM part JOIN installs ON part = p_partkey),
  x AS (SELECT d.part, mtime, install_unix, update_unix, install_unix <> 0 AND abs(mtime - install_unix) <= 900 AS mi,
    update_unix <> 0 AND abs(mtime - update_unix) <= 900 AS mu FROM d JOIN installs ON d.part = installs.part)"""


def clock_rows(spark, sf):
    inst = installs(spark, sf)
    dirs = table(spark, sf, "part").select(F.col("p_partkey").alias("part")).join(inst, "part").select(
        "part", (F.col("install_unix") + F.col("part") % 1800).alias("mtime"))
    return JO.clock_check(dirs, inst, "part")


@query("j3_clock_check", "J3", oracle=f"""WITH {SQL_CLOCK}
  SELECT part, mtime, install_unix, update_unix, mi AS matched_install, mu AS matched_update, mi OR mu AS matched,
    CASE WHEN mi THEN mtime - install_unix WHEN mu THEN mtime - update_unix END AS delta_seconds FROM x""")
def clock_check(spark, sf):
    return clock_rows(spark, sf)


@query("j3_clock_summary", "J3", oracle=f"""WITH {SQL_CLOCK}
  SELECT count(*) AS compared, count(*) FILTER (mi) AS matched_install, count(*) FILTER (mu) AS matched_update,
    count(*) FILTER (mi OR mu) AS matched_either, coalesce(max(CASE WHEN mi THEN abs(mtime - install_unix) WHEN mu THEN abs(mtime - update_unix) END), 0) AS max_delta_seconds,
    round(count(*) FILTER (mi OR mu) / count(*), 3) AS agreement FROM x""")
def clock_summary(spark, sf):
    return JO.clock_summary(clock_rows(spark, sf))


@query("j3_clock_best", "J3", k=3, oracle=f"""WITH {SQL_CLOCK}
  SELECT part, CASE WHEN mi THEN mtime - install_unix ELSE mtime - update_unix END AS delta_seconds FROM x WHERE mi OR mu ORDER BY abs(delta_seconds), part LIMIT 3""")
def clock_best(spark, sf, k):
    return clock_rows(spark, sf).filter("matched").orderBy(F.abs("delta_seconds"), "part").limit(k).select("part", "delta_seconds")


SQL_STORES = """stores AS (SELECT 'wifi_settings' AS store, 0 AS store_rank, c_custkey AS row_id, CASE WHEN c_custkey % 37 = 0 THEN '' ELSE 'net' || (c_custkey % 400) END AS ssid,
   CASE WHEN c_custkey % 3 = 0 THEN 'pw' || c_custkey END AS psk, CASE WHEN c_custkey % 5 = 0 THEN 'restore' ELSE 'b' || (c_custkey % 90) END AS bssid, c_mktsegment AS account FROM customer
  UNION ALL SELECT 'supplicant', 1, s_suppkey, 'net' || (s_suppkey * 3), CASE WHEN s_suppkey % 2 = 0 THEN 'sp' || s_suppkey ELSE '' END, NULL, NULL FROM supplier)"""


def stores(spark, sf):
    n = F.col("c_custkey")
    db = table(spark, sf, "customer").select(
        F.lit("wifi_settings").alias("store"), F.lit(0).alias("store_rank"), n.alias("row_id"),
        F.when(n % 37 == 0, "").otherwise(F.concat(F.lit("net"), (n % 400).cast("string"))).alias("ssid"),
        F.when(n % 3 == 0, F.concat(F.lit("pw"), n.cast("string"))).alias("psk"),
        F.when(n % 5 == 0, "restore").otherwise(F.concat(F.lit("b"), (n % 90).cast("string"))).alias("bssid"),
        F.col("c_mktsegment").alias("account"))
    m = F.col("s_suppkey")
    conf = table(spark, sf, "supplier").select(
        F.lit("supplicant").alias("store"), F.lit(1).alias("store_rank"), m.alias("row_id"),
        F.concat(F.lit("net"), (m * 3).cast("string")).alias("ssid"),
        F.when(m % 2 == 0, F.concat(F.lit("sp"), m.cast("string"))).otherwise("").alias("psk"),
        F.lit(None).cast("string").alias("bssid"), F.lit(None).cast("string").alias("account"))
    return db.unionByName(conf)


@query("j11_merged_credentials", "J11", oracle=f"""WITH {SQL_STORES},
  m AS (SELECT ssid, coalesce(arg_min(psk, store_rank * 100000000 + row_id) FILTER (coalesce(psk, '') <> ''), '') AS psk,
    array_to_string(list_sort(list_distinct(list(store))), ',') AS sources, count(DISTINCT store) AS n,
    count(DISTINCT bssid) FILTER (bssid <> 'restore') AS access_points, coalesce(arg_max(account, row_id) FILTER (account IS NOT NULL), '') AS account
   FROM stores WHERE ssid <> '' GROUP BY ssid)
  SELECT ssid, psk, CAST(length(psk) AS BIGINT) AS length, sources, access_points, account, n > 1 AND psk <> '' AS has_both FROM m""")
def merged_credentials(spark, sf):
    return JO.merge_credentials(stores(spark, sf))


@query("a23_distinct_secrets", "A23", oracle=f"""WITH {SQL_STORES}
  SELECT store, count(DISTINCT psk) FILTER (psk <> '') AS secrets, count(*) FILTER (psk <> '') AS with_secret, count(DISTINCT account) AS accounts FROM stores GROUP BY 1""")
def distinct_secrets(spark, sf):
    from tracelake.operators.accounts import distinct_secrets as distinct
    return distinct(stores(spark, sf), ["store"], "psk", "account")


def second_reader(spark, sf):
    n = F.col("o_orderkey")
    return table(spark, sf, "orders").filter(n % 101 != 0).select(
        n, F.when(n % 103 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderstatus",
        F.when(n % 7 != 0, unix_of("o_orderdate")).alias("mtime"))


def first_reader(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey % 107 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus", unix_of("o_orderdate").alias("mtime"))


SQL_READERS = f"""a AS (SELECT o_orderkey, o_custkey, o_orderstatus, {DAY_UNIX.format('o_orderdate')} AS mtime FROM orders WHERE o_orderkey % 107 <> 0),
  b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 103 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 7 <> 0 THEN {DAY_UNIX.format('o_orderdate')} END AS mtime FROM orders WHERE o_orderkey % 101 <> 0)"""
FIELDS = ["o_custkey", "o_orderstatus", "mtime"]


@query("j13_compare_summary", "J13", oracle=f"""WITH {SQL_READERS}, c AS (
  SELECT unnest(['o_custkey', 'o_orderstatus', 'mtime']) AS field, a.o_orderkey IS NULL AS no_a, b.o_orderkey IS NULL AS no_b,
    unnest([a.o_custkey IS NOT DISTINCT FROM b.o_custkey, a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus, a.mtime IS NOT DISTINCT FROM b.mtime]) AS same,
    unnest([false, false, a.mtime IS NULL OR b.mtime IS NULL]) AS unavailable FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey)
  SELECT field, CASE WHEN no_b THEN 'only_ours' WHEN no_a THEN 'only_theirs' WHEN unavailable THEN 'unavailable' WHEN same THEN 'agree' ELSE 'differ' END AS relation,
    count(*) AS n FROM c GROUP BY 1, 2""")
def compare_summary(spark, sf):
    return C.compare_summary(first_reader(spark, sf), second_reader(spark, sf), ["o_orderkey"], FIELDS, ["mtime"])


@query("j13_compare_differences", "J13", oracle=f"""WITH {SQL_READERS}
  SELECT o_orderkey, 'o_custkey' AS field, CAST(a.o_custkey AS VARCHAR) AS ours, CAST(b.o_custkey AS VARCHAR) AS theirs FROM a JOIN b USING (o_orderkey) WHERE a.o_custkey <> b.o_custkey""")
def compare_differences(spark, sf):
    return C.compare_differences(first_reader(spark, sf), second_reader(spark, sf), ["o_orderkey"], FIELDS, ["mtime"])


@query("j14_row_relation", "J14", oracle="""
  SELECT o_orderkey, CASE WHEN o_orderkey % 103 = 0 THEN 'mismatch' WHEN o_orderkey % 5 = 0 THEN 'schema_evolved' ELSE 'agree' END AS status,
    CASE WHEN o_orderkey % 103 = 0 AND o_orderkey % 5 <> 0 THEN CAST(1 AS BIGINT) END AS "column" FROM orders""")
def row_relation(spark, sf):
    n = F.col("o_orderkey")
    a = F.array(n.cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"))
    b = F.array(n.cast("string"), F.when(n % 103 == 0, "x").otherwise(F.col("o_custkey").cast("string")), F.col("o_orderstatus"), F.lit("added"))
    theirs = F.when(n % 5 == 0, b).otherwise(F.slice(b, 1, 3))
    r = table(spark, sf, "orders").select("o_orderkey", C.row_relation(a, theirs).alias("r"))
    return r.select("o_orderkey", "r.status", F.col("r.column").cast("long").alias("column"))


@query("j15_coverage_gap", "J15", oracle=f"""WITH {SQL_READERS}
  SELECT o_orderkey, 'theirs' AS side FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
  UNION ALL SELECT o_orderkey, 'ours' FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)""")
def coverage_gap(spark, sf):
    return C.coverage_gap(first_reader(spark, sf), second_reader(spark, sf), ["o_orderkey"])


@query("j19_named_owner", "J19", oracle=cte("inventory") + """
  SELECT coalesce(n_name, 'uid:' || uid) AS owner, count(*) AS files FROM inventory LEFT JOIN nation ON n_nationkey = uid GROUP BY 1""")
def named_owner(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("uid"), F.col("n_name").alias("package"))
    return JO.named_owner(inventory(spark, sf), names, "uid", "package").groupBy("owner").agg(F.count("*").alias("files"))


@query("j20_first_divergence", "J20", oracle=f"""WITH {SQL_READERS},
  x AS (SELECT o_orderstatus, o_orderkey AS our_key, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS position FROM a),
  y AS (SELECT o_orderstatus, o_orderkey AS their_key, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS position FROM b)
  SELECT o_orderstatus, position, our_key, their_key FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY position) AS r FROM x JOIN y USING (o_orderstatus, position)
    WHERE our_key <> their_key) WHERE r = 1""")
def first_divergence(spark, sf):
    return C.first_divergence(first_reader(spark, sf), second_reader(spark, sf), "o_orderstatus", "o_orderkey")


@query("x10_content_identity", "X10", oracle="""
  SELECT count(*) AS objects, count(*) FILTER (doc_id % 13 <> 0 AND doc_id % 7 <> 0) AS identical, count(*) FILTER (doc_id % 13 = 0 AND doc_id % 7 <> 0) AS differing,
    count(*) FILTER (doc_id % 7 = 0) AS unread, CAST(sum(octet_length(encode(text))) FILTER (doc_id % 7 <> 0) AS BIGINT) AS bytes_compared FROM documents""")
def content_identity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    n = F.col("doc_id")
    other = d.filter(n % 7 != 0).withColumn("content", F.when(n % 13 == 0, F.concat("content", F.unhex(F.lit("00")))).otherwise(F.col("content")))
    return C.content_identity(d, other, "doc_id", "content")


@query("x10_content_copies", "X10", oracle="""
  SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def content_copies(spark, sf):
    return C.content_copies(table(spark, sf, "documents"), "text")


@query("v5_source_status", "V5", oracle="""
  SELECT doc_id AS artifact, CASE WHEN doc_id % 11 = 0 THEN 'UNREADABLE' WHEN doc_id % 5 = 0 THEN 'ABSENT' ELSE 'PRESENT' END AS status FROM documents""")
def source_status(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("artifact"))
    n = F.col("artifact")
    log = d.filter(n % 5 == 0).withColumn("status", F.lit("ABSENT")).unionByName(d.filter(n % 11 == 0).withColumn("status", F.lit("UNREADABLE")))
    return C.status_of_reads(d, log)


@query("v5_read_log", "V5", keep=50, oracle="""
  SELECT source, count(*) AS total, least(count(*), 50) AS shown, count(*) > 50 AS truncated FROM documents WHERE lang <> 'en' GROUP BY source""")
def read_log(spark, sf, keep):
    from tracelake.verify.checks import capped_log
    d = table(spark, sf, "documents").filter("lang <> 'en'").select("source", F.col("doc_id").alias("artifact"))
    shown = capped_log(d, ["source"], "artifact", keep)
    return shown.groupBy("source").agg(F.first("total").alias("total"), F.count("*").alias("shown"), F.first("truncated").alias("truncated"))


@query("u1_completeness", "U1", "V5", oracle=cte("timeline") + """
  SELECT package, count(*) FILTER (kind <> 'crash') AS events, count(*) FILTER (kind = 'crash' AND event_id % 9 = 0) AS read_errors,
    count(*) FILTER (kind = 'crash' AND event_id % 9 = 0) = 0 AS complete FROM timeline GROUP BY package""")
def completeness(spark, sf):
    t = timeline(spark, sf)
    return TL.completeness(t.filter("kind <> 'crash'"), t.filter("kind = 'crash' and event_id % 9 = 0"), "package")


@query("w3_chain_dedupe", "W3", window=7200, oracle=cte("timeline") + f""",
  d AS (SELECT event_id, CAST(package AS BIGINT) % 3 AS device, unix, source, CAST(event_id % 4 // 2 AS VARCHAR) AS detail FROM timeline),
  p AS (SELECT *, lag(source) OVER w AS ps, lag(detail) OVER w AS pd, lag(unix) OVER w AS pu FROM d WINDOW w AS (PARTITION BY device ORDER BY unix, source, event_id)),
  i AS (SELECT *, sum(CASE WHEN ps = source AND pd = detail AND unix - pu <= 7200 THEN 0 ELSE 1 END) OVER (PARTITION BY device ORDER BY unix, source, event_id) AS island FROM p)
  SELECT device, arg_min(event_id, unix * 1000000 + event_id) AS event_id, min(unix) AS unix, max(unix) AS last_unix, source, detail, {sql_utc('max(unix)')} AS utc FROM i GROUP BY device, island, source, detail""")
def dedupe(spark, sf, window):
    d = timeline(spark, sf).select("event_id", (F.col("package").cast("long") % 3).alias("device"), "unix", "source",
                                   F.floor(F.col("event_id") % 4 / 2).cast("string").alias("detail"))
    return chain_dedupe(d, ["device"], "event_id", window)


@query("u2_ordered_dedupe", "U2", oracle=cte("timeline") + """
  SELECT package, source, detail, min(event_id) AS first_seen FROM timeline GROUP BY 1, 2, 3""")
def ordered_dedupe(spark, sf):
    return timeline(spark, sf).groupBy("package", "source", "detail").agg(F.min("event_id").alias("first_seen"))


@query("u4_set_difference", "U4", oracle=f"""WITH {SQL_READERS}
  SELECT o_custkey, o_orderstatus FROM a EXCEPT ALL SELECT o_custkey, o_orderstatus FROM b""")
def set_difference(spark, sf):
    pick = ["o_custkey", "o_orderstatus"]
    return first_reader(spark, sf).select(*pick).exceptAll(second_reader(spark, sf).select(*pick))


@query("u5_chain_and_window", "U5", oracle="""
  SELECT doc_id, pos, 'c' || lang AS name, 'chain' AS source, 'high' AS trust FROM (SELECT doc_id, doc_id % 50 AS pos, lang FROM documents WHERE doc_id % 2 = 0)
  UNION ALL SELECT doc_id, pos, 'w' || lang, 'window', 'low' FROM (SELECT doc_id, doc_id % 50 AS pos, lang FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0)""")
def chain_and_window(spark, sf):
    d = table(spark, sf, "documents")
    pick = lambda mark, mod: d.filter(F.col("doc_id") % mod == 0).select(
        "doc_id", (F.col("doc_id") % 50).alias("pos"), F.concat(F.lit(mark), "lang").alias("name"))
    return JO.chain_and_window(pick("c", 2), pick("w", 3), ["doc_id", "pos"])


@query("u6_record_events", "U6", oracle=f"""WITH {SQL_INSTALLS}
  SELECT part, {sql_utc('install_unix')} AS utc, 'download' AS event FROM installs WHERE install_unix <> 0 UNION ALL
  SELECT part, {sql_utc('update_unix')}, 'last update' FROM installs UNION ALL SELECT p_partkey, '2001-01-01T00:00:00Z', 'media directory' FROM part WHERE p_size > 25""")
def record_events(spark, sf):
    rows = JO.record_events(installs(spark, sf), ["part"], {"install_unix": "download", "update_unix": "last update"})
    side = table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("part"), F.lit("2001-01-01T00:00:00Z").alias("utc"), F.lit("media directory").alias("event"))
    return rows.unionByName(side)


@query("o6_best_candidate", "O6", oracle="""
  SELECT p_brand, p_name AS name, non_empty, size FROM (SELECT p_brand, p_name, p_size % 7 AS non_empty, CAST(p_retailprice AS BIGINT) % 50 AS size,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 7 DESC, CAST(p_retailprice AS BIGINT) % 50 DESC, length(p_name), p_name) AS r
    FROM (SELECT p_brand, p_name, CAST(p_size AS BIGINT) AS p_size, trunc(p_retailprice) AS p_retailprice FROM part)) WHERE r = 1""")
def best_candidate(spark, sf):
    s = table(spark, sf, "part").select("p_brand", F.col("p_name").alias("name"), (F.col("p_size").cast("long") % 7).alias("non_empty"),
                                        (F.col("p_retailprice").cast("long") % 50).alias("size"))
    return JO.best_candidate(s, ["p_brand"])


@query("w8_newest_logs", "W8", oracle=f"""
  SELECT o_custkey AS account, count(*) AS logs, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS bytes,
    'log' || arg_max(o_orderkey, {DAY_UNIX.format('o_orderdate')} * 10000000 - o_orderkey) || '.log' AS newest_log, {sql_utc(f"max({DAY_UNIX.format('o_orderdate')})")} AS newest_utc
  FROM orders GROUP BY 1""")
def newest_logs(spark, sf):
    from tracelake.operators.accounts import newest_logs as newest
    logs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("account"), F.concat(F.lit("log"), F.col("o_orderkey").cast("string"), F.lit(".log")).alias("name"),
        unix_of("o_orderdate").alias("mtime"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), F.col("o_orderkey").alias("inode"))
    return newest(logs, "account", "inode")
