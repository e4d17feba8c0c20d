"""Registered queries: body files, database files, manifests and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.plans.standins import blobs, cte, inventory, table, timeline
from tracelake.plans.strings import SQL_CLASS, SQL_MASK, _sql_bits
from tracelake.registry import query
from tracelake.sinks import exports as K
from tracelake.sources import binaries as B
from tracelake.sources import bodyfile as BF


def body_inventory(spark, sf):
    """Inventory with modes; every 13th name holds a bar, every 29th a line break."""
    n = F.col("inode")
    odd = F.when(n % 29 == 0, F.concat("path", F.lit("\nx"))).when(n % 13 == 0, F.concat("path", F.lit("|0|y"))).otherwise(F.col("path"))
    return inventory(spark, sf).select(
        n, odd.alias("path"), (F.lit(32768) + n % 512).alias("mode"), "uid", (F.col("uid") + 1).alias("gid"), "size",
        F.col("mtime").alias("atime"), "mtime", F.col("mtime").alias("ctime"), (F.col("mtime") - 5).alias("crtime"))


SQL_BODY = f"""body AS (SELECT inode, path, 'r/r' || {_sql_bits(6, 2048, 's', 'S')} || {_sql_bits(3, 1024, 's', 'S')} || {_sql_bits(0, 512, 't', 'T')} AS mode, uid, size, mtime
  FROM (SELECT inode, CASE WHEN inode % 29 = 0 THEN path || chr(10) || 'x' WHEN inode % 13 = 0 THEN path || '|0|y' ELSE path END AS path, 32768 + inode % 512 AS m, uid, size, mtime FROM inventory))"""


@query("k1_body_lines", "K1", oracle=cte("inventory") + f""", {SQL_BODY}
  SELECT inode, concat_ws('|', '0', path, inode, mode, uid, uid + 1, size, mtime, mtime, mtime, mtime - 5) AS value FROM body WHERE inode % 29 <> 0""")
def body_lines(spark, sf):
    return K.to_body(body_inventory(spark, sf))[0]


@query("k1_refused_names", "K1", oracle=cte("inventory") + f""", {SQL_BODY}
  SELECT package, count(*) AS names FROM (SELECT CASE WHEN len(p) > 2 AND p[2] = 'data' THEN p[3] ELSE array_to_string(p[2:3], '/') END AS package FROM (SELECT string_split(path, '/') AS p FROM body WHERE inode % 29 = 0)) GROUP BY 1""")
def refused_names(spark, sf):
    return K.refused_packages(K.to_body(body_inventory(spark, sf))[1])


@query("s2_read_body", "S2", oracle=cte("inventory") + f""", {SQL_BODY}
  SELECT '0' AS md5, path AS name, CAST(inode AS VARCHAR) AS inode, mode, uid, uid + 1 AS gid, size, mtime AS atime, mtime, mtime AS ctime, mtime - 5 AS crtime FROM body WHERE inode % 29 <> 0""")
def read_body(spark, sf):
    lines = K.to_body(body_inventory(spark, sf))[0]
    return BF.parse_body(lines)


@query("s2_body_counts", "S2", oracle="""
  SELECT count(*) FILTER (n = 0 OR n > 3) AS live, count(*) FILTER (n = 1) AS unlinked, count(*) FILTER (n = 2) AS malformed, count(*) FILTER (n = 3) AS virtual FROM (SELECT o_orderkey % 7 AS n FROM orders)""")
def body_counts(spark, sf):
    n = F.col("o_orderkey") % 7
    name = F.when(n == 1, "/a (deleted)").when(n == 3, "/$OrphanFiles").otherwise("/b|c")
    line = F.when(n == 2, "0|short|1").otherwise(F.concat(F.lit("0|"), name, F.lit("|5|r/rrwxr-xr-x|0|0|9|1|1|1|1")))
    lines = table(spark, sf, "orders").select(F.explode(F.array(line, F.lit("# comment"))).alias("value"))
    return BF.body_counts(lines)


@query("s14_manifest", "S14", oracle=cte("blobs") + """,
  w AS (SELECT DISTINCT path, false AS companion FROM (SELECT path FROM blobs WHERE doc_id % 3 = 0 UNION ALL SELECT '/missing' || doc_id FROM blobs WHERE doc_id % 50 = 0)),
  a AS (SELECT * FROM w UNION ALL SELECT path || s, true FROM w, (SELECT unnest(['-wal', '-shm', '-journal']) AS s))
  SELECT a.path, companion, CASE WHEN b.path IS NULL THEN 'ABSENT' WHEN doc_id % 7 = 0 THEN 'TRUNCATED' ELSE 'PRESENT' END AS status, CAST(octet_length(content) AS BIGINT) AS bytes,
    CASE WHEN doc_id % 7 <> 0 THEN sha256(content) END AS sha256, octet_length(content) > 2000 AS over_limit FROM a LEFT JOIN blobs b ON a.path = b.path""")
def manifest(spark, sf):
    b = blobs(spark, sf)
    missing = b.filter("doc_id % 50 = 0").select(F.concat(F.lit("/missing"), F.col("doc_id").cast("string")).alias("path"))
    wanted = B.with_companions(b.filter("doc_id % 3 = 0").select("path").unionAll(missing))
    size = F.octet_length("content") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    return B.manifest(wanted, b.select("path", size.alias("declared_size"), "content"), 2000)


def credential_rows(spark, sf):
    n = F.col("c_custkey")
    kind = F.when(n % 3 == 0, "token").when(n % 3 == 1, "phone").otherwise("password")
    return table(spark, sf, "customer").select(n, F.col("c_name").alias("value"), kind.alias("kind"), F.col("c_mktsegment"),
                                               F.encode(F.substring("c_name", 1, 3), "UTF-8").alias("raw"),
                                               F.array(F.col("c_mktsegment"), F.lit("A")).alias("tags_set"))


@query("k4_masked_columns", "K4", oracle="""
  SELECT c_custkey, CASE WHEN length(v) <= 4 THEN v || ' (' || length(v) || ')' ELSE '…' || right(v, 4) || ' (' || length(v) || ')' END AS secret,
    '…' || right(v, 2) || ' (' || length(v) || ')' AS listed, left(v, 8) || '… (' || length(v) || ')' AS mapped FROM (SELECT c_custkey, c_name AS v FROM customer)""")
def masked_columns(spark, sf):
    from tracelake.functions.secrets import mask_df
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("secret"), F.array("c_name").alias("listed"),
                                               F.create_map(F.lit("k"), F.col("c_name")).alias("mapped"))
    masked = mask_df(rows, {"secret": "secret", "listed": "password", "mapped": "token"})
    return masked.select("c_custkey", "secret", F.get("listed", 0).alias("listed"), F.col("mapped")["k"].alias("mapped"))


@query("k2_csv_lines", "K2", oracle="""
  SELECT c_custkey || ',' || left(c_name, 8) || '… (' || length(c_name) || '),' || c_mktsegment AS value FROM customer""")
def csv_lines(spark, sf):
    return K.csv_lines(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "token"})


@query("k3_json_lines", "K3", oracle="""
  SELECT '{"c_custkey":' || c_custkey || ',"value":"…' || right(c_name, 2) || ' (' || length(c_name) || ')","raw":"' || lower(hex(encode(left(c_name, 3)))) || '","tags_set":["A","' || c_mktsegment || '"]}' AS value FROM customer""")
def json_lines(spark, sf):
    rows = credential_rows(spark, sf).select("c_custkey", "value", "raw", "tags_set")
    return K.json_lines(rows, {"value": "password"})


@query("k5_merged_runs", "K5", oracle=cte("timeline") + """
  SELECT run_id, event_id, version FROM (SELECT event_id % 5 AS run_id, event_id, 'old' AS version FROM timeline) WHERE run_id <> 3
  UNION ALL SELECT 3, event_id, 'new' FROM timeline WHERE event_id % 10 = 3""")
def merged_runs(spark, sf):
    t = timeline(spark, sf)
    old = t.select((F.col("event_id") % 5).alias("run_id"), "event_id", F.lit("old").alias("version"))
    new = t.filter("event_id % 10 = 3").select((F.col("event_id") % 10).alias("run_id"), "event_id", F.lit("new").alias("version"))
    return K.merge_runs(old, new)


@query("k6_hashes_manifest", "K6", oracle=cte("blobs") + """
  SELECT CASE WHEN doc_id % 4 = 0 THEN '"a,""' || doc_id || '"' ELSE path END || ',reader,' || sha256(content) || ',' || octet_length(content) || ',2024-01-01T00:00:00Z' AS value FROM blobs WHERE doc_id % 6 <> 0""")
def hashes_manifest(spark, sf):
    n = F.col("doc_id")
    entries = blobs(spark, sf).select(
        F.when(n % 4 == 0, F.concat(F.lit('a,"'), n.cast("string"))).otherwise(F.col("path")).alias("name"), F.lit("reader").alias("source"),
        F.when(n % 6 != 0, F.sha2("content", 256)).alias("sha256"), F.octet_length("content").alias("bytes"), F.lit("2024-01-01T00:00:00Z").alias("recorded_utc"))
    return K.hashes_manifest(entries)
