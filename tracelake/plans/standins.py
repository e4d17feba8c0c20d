"""Evidence tables derived from the given tables, with the same rules as SQL text.

Each Spark builder has a CTE of the same name; oracles start with ``cte(...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.times import WEBKIT_DELTA, utc_text

KIND_OF_EVENT = {"purchase": "login", "signup": "token", "error": "crash",
                 "view": "file_write", "click": "other"}
CUT = 978307200  # 2001-01-01: about a tenth of the stand-in inventory is recent
BLOCK = 16       # block size of the stand-in extents
STORES = ("wifi_settings", "supplicant")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def literal_map(pairs: dict):
    return F.create_map(*[F.lit(item) for pair in pairs.items() for item in pair])


def event_micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def timeline(spark, sf) -> DataFrame:
    micros = event_micros()
    return table(spark, sf, "events").select(
        "event_id", F.floor(micros / 1_000_000).cast("long").alias("unix"), micros.alias("micros"),
        F.col("event_type").alias("source"),
        literal_map(KIND_OF_EVENT)[F.col("event_type")].alias("kind"),
        F.col("props").alias("detail"), F.col("user_id").cast("string").alias("package"))


def stamps(spark, sf) -> DataFrame:
    """Events with a raw stamp whose unit changes from row to row."""
    t = timeline(spark, sf)
    unix, micros, n = F.col("unix"), F.col("micros"), F.col("event_id")
    odd = (F.when(n % 25 == 4, F.lit(None).cast("string")).when(n % 25 == 9, "")
           .when(n % 25 == 14, "garbage").when(n % 25 == 19, F.concat(F.lit("-"), n.cast("string")))
           .otherwise("0"))
    raw = (F.when(n % 5 == 0, unix.cast("string"))
           .when(n % 5 == 1, F.floor(micros / 1000).cast("string"))
           .when(n % 5 == 2, micros.cast("string"))
           .when(n % 5 == 3, F.when(n % 2 == 1, utc_text(unix))
                 .otherwise(F.substring(utc_text(unix), 1, 10)))
           .otherwise(odd))
    return t.withColumn("raw", raw).withColumn("webkit", micros + WEBKIT_DELTA * 1_000_000)


def inventory(spark, sf) -> DataFrame:
    """File rows from orders: epoch and installer stamps every so often."""
    key = F.col("o_orderkey")
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    mtime = (F.when(key % 97 == 0, key % 86400)
             .when(key % 89 == 0, F.lit(315532799) - key % 172800).otherwise(day))
    root = (F.when(key % 11 == 0, F.concat(F.lit("/system/app/com.s"), (key % 7).cast("string"), F.lit("-1/")))
            .when(key % 13 == 0, F.concat(F.lit("/app/com.a"), (key % 9).cast("string"), F.lit("-2/")))
            .when(key % 17 == 0, F.lit("/system/procstats/"))
            .when(key % 19 == 0, F.lit("/misc/bluedroid/"))
            .otherwise(F.concat(F.lit("/data/com.c"), (F.col("o_custkey") % 50).cast("string"),
                                F.when(key % 3 == 0, "/databases/").otherwise("/files/"))))
    ext = (F.when(key % 5 == 0, ".db").when(key % 5 == 1, ".XML").when(key % 5 == 2, ".json")
           .otherwise(""))
    return table(spark, sf, "orders").select(
        key.alias("inode"), F.concat(root, F.lit("f"), key.cast("string"), ext).alias("path"),
        mtime.alias("mtime"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
        (F.col("o_custkey") % 50).alias("uid"), F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def extents(spark, sf) -> DataFrame:
    """Extents per order: logical is the running quantity, some repeat the previous blocks.

    An order has few lines by the definition of the table, so its window is small.
    """
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    count = F.col("l_quantity").cast("long")
    base = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("inode"), F.row_number().over(order).cast("long").alias("seq"),
        (F.sum(count).over(order.rowsBetween(W.unboundedPreceding, -1))).alias("before"),
        count.alias("count"))
    logical = F.coalesce("before", F.lit(0).cast("long"))
    shared = (F.col("inode") % 50 == 49) & (F.col("inode") > 0)
    owner = F.when(shared, F.col("inode") - 1).otherwise(F.col("inode"))
    return base.select("inode", "seq", logical.alias("logical"),
                       (owner * 1000 + logical).alias("physical"), "count")


def messages(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    stamp = (F.when((conv * 7 + turn) % 11 == 0, 0)
             .when((conv * 7 + turn) % 13 == 0, 1000 * (turn + 1))
             .otherwise(F.lit(1704067200000) + 60000 * (turn + conv * 50))).cast("long")
    return c.select(conv.alias("thread"), turn.alias("turn"), F.col("role").alias("sender"),
                    F.when(F.length("text") > 60, F.col("text")).otherwise(F.lit("")).alias("body"),
                    F.length("text").cast("long").alias("chars"), stamp.alias("ms"),
                    F.when(turn % 3 == 0, F.lit("[1]")).alias("attachments"),
                    (F.col("role") == "user").alias("outgoing"))


def urls(spark, sf) -> DataFrame:
    """URL rows from pages; some carry identity parameters."""
    key = F.col("page_id")
    tail = (F.when(key % 6 == 0, F.concat(F.lit("&av="), (1000 + key % 40).cast("string")))
            .when(key % 6 == 1, F.concat(F.lit("&lst="), (2000 + key % 9).cast("string"),
                                          F.lit(":77:"), key.cast("string")))
            .when(key % 6 == 2, F.concat(F.lit("&story_fbid="), (key % 30).cast("string"),
                                          F.lit("&id="), (key % 8).cast("string")))
            .when(key % 6 == 3, F.concat(F.lit("/posts/"), key.cast("string")))
            .otherwise(""))
    joined = F.when(tail == "", F.col("url")).when(
        tail.startswith("&"),
        F.concat(F.substring_index("url", "#", 1),
                 F.when(F.col("url").contains("?"), "&").otherwise("?"), F.substr(tail, F.lit(2)))
    ).otherwise(F.concat(F.substring_index(F.substring_index("url", "#", 1), "?", 1), tail))
    return table(spark, sf, "pages").select(key.alias("id"), joined.alias("url"))


def visits(spark, sf) -> DataFrame:
    """One visit per event; the page count is a scalar subquery."""
    n = table(spark, sf, "pages").agg(F.count("*")).scalar()
    return timeline(spark, sf).select(
        F.col("event_id").alias("visit_id"), F.col("package").alias("user"),
        (F.col("event_id") % n).alias("url_id"),
        (F.col("micros") + WEBKIT_DELTA * 1_000_000).alias("visit_time"))


def histories(spark, sf) -> DataFrame:
    """URL table with visit counts and last visit, as a browser keeps it."""
    seen = visits(spark, sf).groupBy("url_id").agg(
        F.count("*").alias("visit_count"), F.max("visit_time").alias("last_visit"))
    return (urls(spark, sf).join(seen, F.col("id") == F.col("url_id"))
            .select("id", "url", "visit_count", "last_visit"))


CTES = {
    "timeline": """timeline AS (SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS unix,
      CAST(epoch_us(ts) AS BIGINT) AS micros, event_type AS source,
      CASE event_type WHEN 'purchase' THEN 'login' WHEN 'signup' THEN 'token' WHEN 'error' THEN 'crash'
           WHEN 'view' THEN 'file_write' ELSE 'other' END AS kind,
      props AS detail, CAST(user_id AS VARCHAR) AS package FROM events)""",
    "stamps": """stamps AS (SELECT *, micros + 11644473600000000 AS webkit,
      CASE event_id % 5 WHEN 0 THEN CAST(unix AS VARCHAR)
        WHEN 1 THEN CAST(micros // 1000 AS VARCHAR) WHEN 2 THEN CAST(micros AS VARCHAR)
        WHEN 3 THEN CASE WHEN event_id % 2 = 1
             THEN strftime(make_timestamp(unix * CAST(1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ')
             ELSE strftime(make_timestamp(unix * CAST(1000000 AS BIGINT)), '%Y-%m-%d') END
        ELSE CASE event_id % 25 WHEN 4 THEN NULL WHEN 9 THEN '' WHEN 14 THEN 'garbage'
             WHEN 19 THEN '-' || CAST(event_id AS VARCHAR) ELSE '0' END END AS raw FROM timeline)""",
    "inventory": """inventory AS (SELECT o_orderkey AS inode,
      CASE WHEN o_orderkey % 11 = 0 THEN '/system/app/com.s' || (o_orderkey % 7) || '-1/'
           WHEN o_orderkey % 13 = 0 THEN '/app/com.a' || (o_orderkey % 9) || '-2/'
           WHEN o_orderkey % 17 = 0 THEN '/system/procstats/'
           WHEN o_orderkey % 19 = 0 THEN '/misc/bluedroid/'
           ELSE '/data/com.c' || (o_custkey % 50) ||
                CASE WHEN o_orderkey % 3 = 0 THEN '/databases/' ELSE '/files/' END END
      || 'f' || o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN '.db' WHEN 1 THEN '.XML'
           WHEN 2 THEN '.json' ELSE '' END AS path,
      CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey % 86400
           WHEN o_orderkey % 89 = 0 THEN 315532799 - o_orderkey % 172800
           ELSE CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) END AS mtime,
      CAST(round(o_totalprice * 100) AS BIGINT) AS size, o_custkey % 50 AS uid,
      o_custkey AS custkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders)""",
    "extents": """extents AS (SELECT inode, seq, logical,
      (CASE WHEN inode % 50 = 49 AND inode > 0 THEN inode - 1 ELSE inode END) * 1000 + logical AS physical,
      count FROM (SELECT l_orderkey AS inode, row_number() OVER w AS seq,
        CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical,
        CAST(l_quantity AS BIGINT) AS count FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                     l_extendedprice, l_shipdate)))""",
    "messages": """messages AS (SELECT conv_id AS thread, turn, role AS sender,
      CASE WHEN length(text) > 60 THEN text ELSE '' END AS body, CAST(length(text) AS BIGINT) AS chars,
      CAST(CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN 0
                WHEN (conv_id * 7 + turn) % 13 = 0 THEN 1000 * (turn + 1)
                ELSE 1704067200000 + 60000 * (turn + conv_id * 50) END AS BIGINT) AS ms,
      CASE WHEN turn % 3 = 0 THEN '[1]' END AS attachments, role = 'user' AS outgoing FROM conversations)""",
    "urls": """urls AS (SELECT page_id AS id, CASE WHEN tail = '' THEN url
      WHEN tail LIKE '&%' THEN split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || substr(tail, 2)
      ELSE split_part(split_part(url, '#', 1), '?', 1) || tail END AS url
      FROM (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN '&av=' || (1000 + page_id % 40)
        WHEN 1 THEN '&lst=' || (2000 + page_id % 9) || ':77:' || page_id
        WHEN 2 THEN '&story_fbid=' || (page_id % 30) || '&id=' || (page_id % 8)
        WHEN 3 THEN '/posts/' || page_id ELSE '' END AS tail FROM pages))""",
    "visits": """visits AS (SELECT event_id AS visit_id, package AS "user",
      event_id % (SELECT count(*) FROM pages) AS url_id, micros + 11644473600000000 AS visit_time FROM timeline)""",
    "histories": """histories AS (SELECT id, url, count(*) AS visit_count, max(visit_time) AS last_visit
      FROM urls JOIN visits ON id = url_id GROUP BY id, url)""",
}
NEEDS = {"stamps": ["timeline"], "visits": ["timeline"], "histories": ["timeline", "visits", "urls"]}

# SQL text for the renderings used all over the oracles.
def sql_utc(expr: str) -> str:
    return (f"CASE WHEN ({expr}) IS NULL OR ({expr}) = 0 THEN '' ELSE "
            f"strftime(make_timestamp(CAST({expr} AS BIGINT) * CAST(1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') END")


def sql_span(expr: str) -> str:
    return (f"CASE WHEN ({expr}) <= 0 THEN '0 s' ELSE concat_ws(' ', "
            f"CASE WHEN ({expr}) // 86400 > 0 THEN (({expr}) // 86400) || ' d' END, "
            f"CASE WHEN (({expr}) % 86400) // 3600 > 0 THEN ((({expr}) % 86400) // 3600) || ' h' END, "
            f"CASE WHEN (({expr}) % 3600) // 60 > 0 THEN ((({expr}) % 3600) // 60) || ' min' END, "
            f"CASE WHEN ({expr}) % 60 > 0 AND ({expr}) < 86400 THEN (({expr}) % 60) || ' s' END) END")


def sql_package(path: str) -> str:
    p = f"list_filter(string_split({path}, '/'), lambda x: x <> '')"
    return (f"CASE WHEN NOT starts_with({path}, '/') OR len({p}) = 0 THEN '' "
            f"WHEN {p}[1] = 'data' AND len({p}) > 1 THEN {p}[2] "
            f"WHEN {p}[1] = 'system' AND len({p}) > 1 AND {p}[2] = 'app' "
            f"THEN coalesce(regexp_replace({p}[3], '-[^-]*$', ''), '') "
            f"WHEN {p}[1] = 'app' AND len({p}) > 1 THEN regexp_replace({p}[2], '-[^-]*$', '') "
            f"ELSE {p}[1] END")


def cte(*names: str) -> str:
    wanted: list[str] = []
    for name in names:
        for item in [*NEEDS.get(name, []), name]:
            if item not in wanted:
                wanted.append(item)
    return "WITH " + ",\n".join(CTES[name] for name in wanted) + "\n"


def blobs(spark, sf) -> DataFrame:
    """Binary contents from documents: magic bytes in front of some, hashes for others."""
    text, n = F.encode("text", "UTF-8"), F.col("doc_id") % 10

    def led(hexed):
        return F.concat(F.unhex(F.lit(hexed)), text)

    content = (F.when(n == 0, led("53514C69746520666F726D6174203300")).when(n == 1, led("ACED0005"))
               .when(n == 2, led("20093C3F786D6C20")).when(n == 3, led("0A7B")).when(n == 4, led("0002"))
               .when(n == 5, led("3C6D61703E")).when(n == 6, led("5B"))
               .when(n == 7, F.unhex(F.repeat(F.sha2("text", 256), 20)))
               .when(n == 8, F.concat(F.unhex(F.repeat(F.sha2("text", 256), 4)), F.unhex(F.repeat(F.lit("00"), 500))))
               .otherwise(text))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("/data/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string")).alias("path"),
        "text", content.alias("content"))


CTES["blobs"] = """blobs AS (SELECT doc_id, '/data/' || source || '/d' || doc_id AS path, text,
  CASE doc_id % 10 WHEN 0 THEN unhex('53514C69746520666F726D6174203300') || encode(text)
   WHEN 1 THEN unhex('ACED0005') || encode(text) WHEN 2 THEN unhex('20093C3F786D6C20') || encode(text)
   WHEN 3 THEN unhex('0A7B') || encode(text) WHEN 4 THEN unhex('0002') || encode(text)
   WHEN 5 THEN unhex('3C6D61703E') || encode(text) WHEN 6 THEN unhex('5B') || encode(text)
   WHEN 7 THEN unhex(repeat(sha256(text), 20))
   WHEN 8 THEN unhex(repeat(sha256(text), 4)) || unhex(repeat('00', 500)) ELSE encode(text) END AS content
  FROM documents)"""


def token_docs(spark, sf) -> DataFrame:
    """JSON account documents from events; one token per user shows up in many sources."""
    n, user = F.col("event_id"), F.col("package")
    field = (F.when(n % 4 == 0, "access_token").when(n % 4 == 1, "auth_token")
             .when(n % 4 == 2, "token").otherwise("payload"))
    token = F.concat(F.lit("EAA"), F.when(n % 7 == 0, "AAAAAQ").otherwise(""), F.md5(user),
                     F.md5(F.concat(user, F.lit("x"))))
    who = F.when(n % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "profile": {"uid": "'), user, F.lit('", "name": "user '), user, F.lit('"}')))
    doc = F.concat(F.lit('{"'), field, F.lit('": "'), token, F.lit('"'), who, F.lit("}"))
    return timeline(spark, sf).select(n.alias("doc_id"), F.col("source"), F.col("unix"), doc.alias("doc"),
                                      field.alias("field"), token.alias("token"), user.alias("user"))


CTES["token_docs"] = """token_docs AS (SELECT event_id AS doc_id, source, unix, field, token, package AS "user",
  '{"' || field || '": "' || token || '"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE
   ', "profile": {"uid": "' || package || '", "name": "user ' || package || '"}' END || '}' AS doc
  FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'access_token' WHEN 1 THEN 'auth_token' WHEN 2 THEN 'token'
    ELSE 'payload' END AS field, 'EAA' || CASE WHEN event_id % 7 = 0 THEN 'AAAAAQ' ELSE '' END ||
    md5(package) || md5(package || 'x') AS token FROM timeline))"""
NEEDS["token_docs"] = ["timeline"]
