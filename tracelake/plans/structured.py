"""Registered queries: XML, JSON, key/value documents and schema drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.plans.standins import cte, table, timeline
from tracelake.registry import query
from tracelake.sources import documents as D


def pref_files(spark, sf):
    n = F.col("o_orderkey").cast("string")
    xml = F.concat(F.lit("<?xml version='1.0' encoding='utf-8' standalone='yes' ?><map><string name=\"app.state\">"), "o_orderstatus",
                   F.lit('</string><int name="count" value="'), n, F.lit('" /><long name="big" value="'),
                   (F.col("o_orderkey") + F.lit(9007199254740993)).cast("string"),
                   F.lit('" /><boolean name="on" value="'), F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false"),
                   F.lit('" /><float name="rate" value="1.5" /><set name="tags"><string>'), "o_orderpriority",
                   F.lit("</string><string>x</string></set><string>no name</string>"),
                   F.when(F.col("o_orderkey") % 50 == 0, "<map>").otherwise("</map>"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), xml.alias("xml"))


@query("s4_prefs_rows", "S4", oracle="""
  SELECT o_orderkey AS file, '' AS key, 'error' AS type, 'not well formed' AS value FROM orders WHERE o_orderkey % 50 = 0
  UNION ALL SELECT o_orderkey, k, t, v FROM (SELECT o_orderkey, unnest(['app.state', 'count', 'big', 'on', 'rate', 'tags']) AS k,
    unnest(['string', 'int', 'long', 'boolean', 'float', 'set']) AS t, unnest([o_orderstatus, CAST(o_orderkey AS VARCHAR),
      CAST(o_orderkey + 9007199254740993 AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, '1.5',
      '["' || o_orderpriority || '","x"]']) AS v FROM orders WHERE o_orderkey % 50 <> 0)""")
def prefs_rows(spark, sf):
    return D.prefs_rows(pref_files(spark, sf), "xml", ["file"])


@query("f11_wanted_preferences", "F11", oracle="""
  SELECT e.file, e.file % 2 = 0 AND e.file IN (SELECT o_orderkey FROM orders) AS present,
    CASE WHEN e.file % 50 <> 0 AND e.file % 2 = 0 THEN 'state' END AS name, CASE WHEN e.file % 50 <> 0 AND e.file % 2 = 0 THEN o_orderstatus END AS value
  FROM (SELECT c_custkey AS file FROM customer) e LEFT JOIN orders ON o_orderkey = e.file""")
def wanted_preferences(spark, sf):
    rows = D.prefs_rows(pref_files(spark, sf).filter("file % 2 = 0"), "xml", ["file"])
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("file"))
    return D.wanted_preferences(rows, expected, ["state", "verification_state"], "file")


@query("s6_project_optional", "S6", oracle="""
  SELECT p_partkey, p_name, 0 AS date_created, 'n/a' AS realm FROM part UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'n/a' FROM supplier""")
def project_optional(spark, sf):
    wanted = {"p_partkey": None, "p_name": None, "date_created": F.lit(0), "realm": F.lit("n/a")}
    drifted = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("p_name"),
                                                  F.col("s_nationkey").alias("date_created"))
    return D.merge_drifted(D.project_optional(table(spark, sf, "part"), wanted), D.project_optional(drifted, wanted))


@query("s12_json_docs", "S12", oracle="""
  SELECT event_id, CASE event_id % 4 WHEN 1 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events WHERE event_id % 4 < 2""")
def json_docs(spark, sf):
    n = F.col("event_id") % 4
    text = (F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("["), "props", F.lit("]")))
            .when(n == 2, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.concat(F.lit("{bad "), "props")))
    docs = D.json_docs(table(spark, sf, "events").select("event_id", text.alias("value")), "value")
    return docs.select("event_id", F.try_variant_get("document", "$.k", "bigint").alias("k"))


@query("s13_json_objects", "S13", oracle=cte("timeline") + """
  SELECT event_id, CAST(0 AS BIGINT) AS position, detail AS object FROM timeline
  UNION ALL SELECT event_id, 1, '{"user": {"id": ' || package || ', "t": "a}b\\"{"}}' FROM timeline WHERE event_id % 3 = 0""")
def json_objects(spark, sf):
    more = F.concat(F.lit('{"user": {"id": '), "package", F.lit(', "t": "a}b\\"{"}}'))
    text = F.concat(F.lit("x {css: none} "), "detail", F.lit(" noise "), "detail", F.when(F.col("event_id") % 3 == 0, more).otherwise(""),
                    F.lit(' tail { "never closed'))
    out = D.extract_json_objects(timeline(spark, sf).select("event_id", text.alias("t")), "t", ["event_id"])
    return out.withColumn("position", F.col("position").cast("long"))


@query("s15_backup_records", "S15", oracle="""
  SELECT o_orderkey, package, field, value FROM (SELECT o_orderkey, 'com.c' || (o_custkey % 50) AS package, unnest(['version', 'state']) AS field,
    unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus]) AS value FROM orders) UNION ALL SELECT o_orderkey, 'com.x', 'size', '7' FROM orders""")
def backup_records(spark, sf):
    xml = F.concat(F.lit('<backup><package name="com.c'), (F.col("o_custkey") % 50).cast("string"), F.lit('"><version> '), F.col("o_orderkey").cast("string"),
                   F.lit(" </version><state>"), "o_orderstatus", F.lit('</state></package><package name="com.x"><size>7</size></package></backup>'))
    return D.backup_records(table(spark, sf, "orders").select("o_orderkey", xml.alias("xml")), "xml", ["o_orderkey"])


@query("s15_component_history", "S15", oracle=cte("timeline") + """
  SELECT event_id, 'com.' || source AS package, 'Main' AS component, micros // 1000 AS recent_ms, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 7 + 2 END AS launches FROM timeline
  UNION ALL SELECT event_id, 'com.b', '', NULL, 0 FROM timeline WHERE event_id % 2 = 0""")
def component_history(spark, sf):
    n = F.col("event_id")
    hist = F.when(n % 5 == 0, '"none"').otherwise(F.concat(F.lit('{"d1": '), (n % 7).cast("string"), F.lit(', "d2": 2}')))
    doc = F.concat(F.lit('[{"package": "com.'), "source", F.lit('", "component": "Main", "recent": '), F.floor(F.col("micros") / 1000).cast("string"),
                   F.lit(', "history": '), hist, F.lit("}"), F.when(n % 2 == 0, ', {"package": "com.b"}').otherwise(""), F.lit("]"))
    return D.component_history(timeline(spark, sf).select("event_id", doc.alias("doc")), "doc", ["event_id"])


def extras(spark, sf):
    """Key/value rows as an account store keeps them."""
    n, u = F.col("event_id"), F.col("unix").cast("string")
    key = (F.when(n % 6 == 0, F.concat(F.lit("EXP:com.google."), "source", F.lit(":sig"), (n % 5).cast("string"), F.lit(":oauth2:https://mail.google.com/ scope"), (n % 3).cast("string")))
           .when(n % 6 == 1, F.concat(F.lit("EXP:com.other"))).when(n % 6 == 2, F.lit("EXP:com.bad:sig:oauth2:x"))
           .when(n % 6 == 3, F.concat(F.lit("GOOGLEUSERID."), n.cast("string"))).otherwise(F.concat(F.lit("misc"), n.cast("string"))))
    value = F.when(n % 6 == 2, "soon").otherwise(u)
    return timeline(spark, sf).select(n.alias("row_id"), key.alias("key"), value.alias("value"), "package")


SQL_EXTRAS = """extras AS (SELECT event_id AS row_id, CASE event_id % 6 WHEN 0 THEN 'EXP:com.google.' || source || ':sig' || (event_id % 5) || ':oauth2:https://mail.google.com/ scope' || (event_id % 3)
   WHEN 1 THEN 'EXP:com.other' WHEN 2 THEN 'EXP:com.bad:sig:oauth2:x' WHEN 3 THEN 'GOOGLEUSERID.' || event_id ELSE 'misc' || event_id END AS key,
   CASE WHEN event_id % 6 = 2 THEN 'soon' ELSE CAST(unix AS VARCHAR) END AS value, package FROM timeline)"""


@query("s16_token_expiries", "S16", oracle=cte("timeline") + f""", {SQL_EXTRAS}
  SELECT row_id, split_part(key, ':', 2) AS authenticator, CASE WHEN contains(key, ':oauth2:') THEN split_part(key, ':oauth2:', 2) ELSE '' END AS scope,
    CAST(value AS BIGINT) AS expires_unix FROM extras WHERE starts_with(key, 'EXP:') AND try_cast(value AS BIGINT) IS NOT NULL""")
def token_expiries(spark, sf):
    return D.token_expiries(extras(spark, sf), F.col("key"), F.col("value"), ["row_id"])


@query("w7_newest_grants", "W7", oracle=cte("timeline") + f""", {SQL_EXTRAS},
  t AS (SELECT row_id, split_part(key, ':', 2) AS authenticator, split_part(key, ':oauth2:', 2) AS scope, CAST(value AS BIGINT) AS e FROM extras
    WHERE starts_with(key, 'EXP:') AND try_cast(value AS BIGINT) IS NOT NULL)
  SELECT authenticator, max(e) AS last_grant_unix, split_part(arg_max(scope, e * 1000000 - row_id), ' ', 1) AS scope_head,
    max(e) FILTER (contains(scope, 'mail.google.com')) AS last_mail_unix, count(*) FILTER (contains(scope, 'mail.google.com')) AS mail_grants FROM t GROUP BY 1""")
def newest_grants(spark, sf):
    from tracelake.operators.accounts import newest_grants as newest
    grants = D.token_expiries(extras(spark, sf), F.col("key"), F.col("value"), ["row_id"])
    return newest(grants, "row_id", "mail.google.com")


@query("f10_interesting_keys", "F10", k=12, oracle=cte("timeline") + f""", {SQL_EXTRAS}
  SELECT row_id, key, value FROM extras WHERE regexp_matches(lower(key), 'googleuserid|firstname|lastname|credentialsstate|services|last_unseen|authenticator|account_type|recovery')
  ORDER BY row_id LIMIT 12""")
def interesting_keys(spark, sf, k):
    from tracelake.operators.accounts import interesting_keys as interesting
    return interesting(extras(spark, sf), "row_id", k)
