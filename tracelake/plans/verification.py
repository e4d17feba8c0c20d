"""Registered queries: expectations, run summaries and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import timeline as TL
from tracelake.plans.joinsets import SQL_CLOCK, SQL_INSTALLS, source_status
from tracelake.plans.standins import CUT, cte, inventory, sql_utc, table, timeline
from tracelake.registry import query
from tracelake.verify import checks as V
from tracelake.verify import report as R
from tracelake.verify import topics as P


def findings(spark, sf):
    """One finding per event kind (in name order) and a payload row, values as VARIANT."""
    t = timeline(spark, sf)
    kinds = t.groupBy("kind").agg(F.count("*").alias("n"), F.min("unix").alias("first"), F.countDistinct("source").alias("sources"))
    names = F.array(*[F.lit(k) for k in ("crash", "file_write", "login", "other", "token")])
    body = F.to_json(F.struct("kind", "n", F.struct("first", F.array("kind", F.lit("x")).alias("list")).alias("nested"),
                              F.create_map(F.lit("com.google"), F.col("sources")).alias("by_type")))
    rows = kinds.select(F.lit("timeline").alias("module"), (F.array_position(names, F.col("kind")) - 1).cast("int").alias("position"), body.alias("j"))
    payload = t.agg(F.to_json(F.struct(F.count("*").alias("events"), F.countDistinct("package").alias("packages"))).alias("j")).select(
        F.lit("timeline").alias("module"), F.lit(V.PAYLOAD).alias("position"), "j")
    return rows.unionByName(payload).select("module", "position", F.parse_json("j").alias("values"))


CASE = {"name": "events", "checks": [
    {"id": "timeline.shape", "module": "timeline", "scopes": ["all", "time"], "expect": [
        {"path": "data.packages", "gte": 5}, {"path": "data.packages", "lte": 10}, {"path": "#0.kind", "equals": "crash"},
        {"path": "#1.nested.list.0", "matches": "^file"}, {"path": "kind", "contains": "login"}, {"path": "#2.nested.list", "contains": "x"}]},
    {"id": "timeline.types", "module": "timeline", "scopes": ["types"], "expect": [
        {"path": "#3.by_type.'com.google'", "equals": 1.4, "tolerance": 0.5}, {"path": "#3.by_type.com.google", "equals": 1},
        {"path": "#4.kind", "in": ["login", "token"]}, {"path": "#4.kind", "not_contains": "zz"}]},
    {"id": "timeline.odd", "module": "timeline", "expect": [
        {"path": "#9.kind", "equals": "x"}, {"path": "#0.kind", "not_equals": "login"}, {"path": "#x.kind", "equals": "crash"}]},
    {"id": "absent.module", "module": "nobody", "expect": [{"path": "a", "equals": 1}]}]}
SQL_ASSERTED = """asserted AS (SELECT * FROM (VALUES ('timeline.shape', 0, (SELECT count(DISTINCT user_id) >= 5 FROM events)), ('timeline.shape', 1, (SELECT count(DISTINCT user_id) <= 10 FROM events)),
  ('timeline.shape', 2, true), ('timeline.shape', 3, true), ('timeline.shape', 4, true), ('timeline.shape', 5, true), ('timeline.types', 0, true), ('timeline.types', 1, false),
  ('timeline.types', 2, true), ('timeline.types', 3, true), ('timeline.odd', 0, false), ('timeline.odd', 1, false), ('timeline.odd', 2, false), ('absent.module', 0, false)) AS v(check_id, position, passed))"""


def asserted(spark, sf, scope="all", only=""):
    return V.run_assertions(V.in_scope(V.assertions(spark, CASE), scope, only), findings(spark, sf))


@query("v1_path_lookup", "V1", "F5", oracle=f"WITH {SQL_ASSERTED} SELECT check_id, position, passed FROM asserted")
def path_lookup(spark, sf):
    return asserted(spark, sf).select("check_id", "position", "passed")


@query("v2_check_results", "V2", oracle=f"""WITH {SQL_ASSERTED}
  SELECT check_id, count(*) AS assertions, count(*) FILTER (NOT passed) AS failures, bool_and(passed) AS passed FROM asserted GROUP BY 1""")
def check_results(spark, sf):
    return V.check_results(asserted(spark, sf))


@query("f6_scoped_checks", "F6", oracle=f"WITH {SQL_ASSERTED} SELECT check_id, position, passed FROM asserted WHERE check_id = 'timeline.types'", scope="types", only="types")
def scoped(spark, sf, scope, only):
    return asserted(spark, sf, scope, only).select("check_id", "position", "passed")


@query("v3_run_summary", "V3", oracle=f"""WITH {SQL_ASSERTED}, c AS (SELECT check_id, bool_and(passed) AS passed FROM asserted GROUP BY 1)
  SELECT count(*) AS checks, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, 'PASS' AS integrity, CASE WHEN count(*) FILTER (NOT passed) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM c""")
def run_summary(spark, sf):
    return V.run_summary(V.check_results(asserted(spark, sf)), "PASS")


@query("f5_predicates", "F5", oracle="""
  SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN abs(o_custkey - 700) <= 100 WHEN 1 THEN contains(o_orderpriority, 'HIGH') WHEN 2 THEN NOT contains(o_orderpriority, 'HIGH')
    WHEN 3 THEN regexp_matches(o_orderpriority, '^[12]') WHEN 4 THEN o_custkey >= 700 WHEN 5 THEN o_custkey <= 700 WHEN 6 THEN o_orderstatus IN ('F', 'P') ELSE false END AS holds FROM orders""")
def predicates(spark, sf):
    n = F.col("o_orderkey") % 8
    cases = [("equals", "o_custkey", "700"), ("contains", "o_orderpriority", '"HIGH"'), ("not_contains", "o_orderpriority", '"HIGH"'), ("matches", "o_orderpriority", '"^[12]"'),
             ("gte", "o_custkey", "700"), ("lte", "o_custkey", "700"), ("in", "o_orderstatus", '["F","P"]'), ("not_equals", "o_orderstatus", '"Z"')]
    pick = lambda i: F.get(F.array(*[F.lit(c[i]) for c in cases]), n.cast("int"))
    text = lambda c: F.to_json(F.array(c))
    actual = F.get(F.array(*[F.regexp_replace(text(F.col(c[1])), r"^\[|\]$", "") for c in cases]), n.cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", V.holds(actual, pick(0), pick(2), F.when(n == 0, 100.0).otherwise(0.0)).alias("holds"))


@query("v4_case_template", "V4", oracle="""
  SELECT '{"id":"orders.status.' || s || '","module":"orders","scopes":["all"],"expect":[{"path":"data.status.''' || s || '''","equals":"TODO"}]}' AS value FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)""")
def case_template(spark, sf):
    profile = table(spark, sf, "orders").select(F.lit("status").alias("facet"), F.col("o_orderstatus").alias("key")).distinct()
    return V.case_template(profile, "orders")


@query("a18_severity_counts", "A18", oracle="""
  SELECT o_orderstatus AS module, count(*) FILTER (s = 'info') AS info, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'warn') AS warn, count(*) FILTER (s = 'finding') AS finding,
    count(*) FILTER (s = 'critical') AS critical, CASE WHEN o_orderstatus = 'F' THEN 'critical' ELSE 'finding' END AS worst
  FROM (SELECT o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'critical' ELSE 'ok' END WHEN '2-HIGH' THEN 'finding' WHEN '3-MEDIUM' THEN 'warn' ELSE 'info' END AS s FROM orders) GROUP BY 1""")
def severity_counts(spark, sf):
    p = F.col("o_orderpriority")
    severity = (F.when(p == "1-URGENT", F.when(F.col("o_orderstatus") == "F", "critical").otherwise("ok")).when(p == "2-HIGH", "finding").when(p == "3-MEDIUM", "warn").otherwise("info"))
    return V.severity_counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("module"), severity.alias("severity")), ["module"])


@query("v6_skipped_rollup", "V6", oracle=cte("inventory") + """
  SELECT 'fs_timeline' AS module, 'walk_errors' AS kind, count(*) AS count FROM inventory WHERE mtime < 86400 HAVING count(*) > 0
  UNION ALL SELECT 'blockmap', 'skipped', count(*) FROM lineitem WHERE l_quantity = 1 HAVING count(*) > 0 UNION ALL SELECT 'carve', 'unreadable', count(*) FROM documents WHERE n_chars < 0 HAVING count(*) > 0""")
def skipped_rollup(spark, sf):
    count = lambda df, kind: df.agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return V.skipped_rollup({
        "fs_timeline": count(inventory(spark, sf).filter("mtime < 86400"), "walk_errors"),
        "blockmap": count(table(spark, sf, "lineitem").filter("l_quantity = 1"), "skipped"),
        "carve": count(table(spark, sf, "documents").filter("n_chars < 0"), "unreadable")})


FLOOR, SINCE = 1706400000, 1705276800
SIGNALS = {"lease": "source = 'signup'", "checkin": "source = 'view'", "token": "kind = 'login'"}


def verdict_rows(spark, sf):
    from tracelake.plans.joinsets import clock_summary, install_state
    t, files = timeline(spark, sf), inventory(spark, sf)
    return R.stack(
        P.unlock(files, CUT), P.network(t, FLOOR, {k: F.expr(v) for k, v in SIGNALS.items()}), P.accounts(TL.per_service(t, "event_id")), P.session(t), P.last_login(t, "event_id"),
        P.clock(clock_summary(spark, sf)), P.applications(install_state(spark, sf)), P.system_session(t, F.col("source") == "signup", F.col("kind") == "crash", SINCE),
        P.acquisition(source_status(spark, sf)), P.files(files))


SQL_VERDICTS = f"""
  SELECT 'unlock' AS topic, CASE WHEN count(*) > 0 THEN 'unlocked' ELSE 'cannot be confirmed' END AS answer, count(*) || ' files, ' || CAST(coalesce(sum(size), 0) AS BIGINT) || ' bytes since ' || {sql_utc(str(CUT))} AS evidence,
    'inventory' AS source FROM inventory WHERE mtime >= {CUT} AND size >= 4096 AND (starts_with(path, '/data/') OR starts_with(path, '/data/user/0/'))
  UNION ALL SELECT 'network', CASE WHEN e = '' THEN 'no sign of a connection' ELSE 'connected' END, e, 'timeline' FROM (SELECT concat_ws(', ', """ + ", ".join(
    f"CASE WHEN max(unix) FILTER ({v}) > {FLOOR} THEN '{k}' END" for k, v in SIGNALS.items()) + f""") AS e FROM timeline)
  UNION ALL SELECT 'accounts', count(*) FILTER (a > 0) || ' of ' || count(*), 'last authentication ' || coalesce(max(l), '—'), 'timeline'
    FROM (SELECT count(*) FILTER (kind IN ('login', 'token')) AS a, {sql_utc("max(unix) FILTER (kind IN ('login', 'token'))")} AS l FROM timeline GROUP BY package)
  UNION ALL SELECT 'session', CAST(count(*) AS VARCHAR), {sql_utc('min(unix)')} || ' / ' || {sql_utc('max(unix)')}, 'timeline' FROM timeline
  UNION ALL (SELECT 'last login', {sql_utc('unix')}, package, 'timeline' FROM timeline WHERE kind = 'login' ORDER BY unix DESC, event_id DESC LIMIT 1)
  UNION ALL SELECT 'clock', CAST(round(1000.0 * count(*) FILTER (mi OR mu) / count(*)) AS BIGINT) || ' per mille agree', count(*) FILTER (mi OR mu) || ' of ' || count(*) || ', at most '
    || coalesce(max(CASE WHEN mi THEN abs(mtime - install_unix) WHEN mu THEN abs(mtime - update_unix) END), 0) || ' s apart', 'packages' FROM x
  UNION ALL SELECT 'applications', CAST(count(*) AS VARCHAR), 'data_dir_present ' || count(*) FILTER (d) || ', gone_but_listed ' || count(*) FILTER (NOT d AND u) || ', no_data_dir ' || count(*) FILTER (NOT d AND NOT u), 'packages'
    FROM (SELECT part IN (SELECT p_partkey FROM part WHERE p_size % 3 <> 0) AS d, part IN (SELECT l_suppkey * 7 FROM lineitem) AS u FROM installs)
  UNION ALL SELECT 'system session', CASE WHEN r > 1 OR c > 0 THEN 'unstable_session' ELSE 'stable_session' END, r || ' reboots, ' || c || ' crashes since ' || {sql_utc(str(SINCE))}, 'timeline'
    FROM (SELECT count(*) FILTER (source = 'signup') AS r, count(*) FILTER (kind = 'crash' AND unix >= {SINCE}) AS c FROM timeline)
  UNION ALL SELECT 'acquisition', CASE WHEN u > 0 THEN 'incomplete' WHEN a > 0 THEN 'sources absent' ELSE 'complete' END, p || ' read, ' || a || ' absent, ' || u || ' unreadable', 'reads'
    FROM (SELECT count(*) FILTER (doc_id % 11 = 0) AS u, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 5 = 0) AS a, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 5 <> 0) AS p FROM documents)
  UNION ALL SELECT 'files', CAST(count(*) AS VARCHAR), CAST(CAST(sum(size) AS BIGINT) AS VARCHAR), 'inventory' FROM inventory"""
SQL_REPORT = cte("timeline", "inventory") + f", {SQL_INSTALLS}, " + SQL_CLOCK.split(f"{SQL_INSTALLS},", 1)[-1]


@query("v7_report_verdicts", "V7", oracle=SQL_REPORT + SQL_VERDICTS)
def report_verdicts(spark, sf):
    return verdict_rows(spark, sf)


SQL_TIMES = f"""SELECT n_name AS source, coalesce({sql_utc('w')}, '—') AS written_utc, coalesce(n, 0) AS rows FROM nation
    LEFT JOIN (SELECT custkey % 40 AS k, max(mtime) AS w, count(*) AS n FROM inventory GROUP BY 1) ON k = n_nationkey + 20"""


def written(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("source"))
    seen = inventory(spark, sf).select((F.col("custkey") % 40 - 20).alias("k"), F.col("mtime").alias("unix")).join(names, "k").select("source", "unix")
    return P.source_times(names.select("source"), seen)


@query("v7_source_times", "V7", oracle=cte("inventory") + SQL_TIMES.replace(f"coalesce({sql_utc('w')}, '—')", f"CASE WHEN w IS NULL THEN '—' ELSE {sql_utc('w')} END"))
def source_times(spark, sf):
    return written(spark, sf)


@query("v8_markdown", "V8", oracle=SQL_REPORT + f""", v AS ({SQL_VERDICTS}),
  w AS ({SQL_TIMES.replace(f"coalesce({sql_utc('w')}, '—')", f"CASE WHEN w IS NULL THEN '—' ELSE {sql_utc('w')} END")}),
  l AS (SELECT * FROM (VALUES (0, 0, '# Report | all'), (0, 1, ''), (1, 0, '## Verdicts'), (1, 1, ''), (1, 2, '| topic | answer | evidence | source |'), (1, 3, '|---|---|---|---|'), (1, 5, ''),
      (2, 0, '## Sources'), (2, 1, ''), (2, 2, '| source | written_utc | rows |'), (2, 3, '|---|---|---|'), (2, 5, '')) AS t(section, part, line)
    UNION ALL SELECT 1, 4, '| ' || topic || ' | ' || answer || ' | ' || evidence || ' | ' || source || ' |' FROM v
    UNION ALL SELECT 2, 4, '| ' || source || ' | ' || written_utc || ' | ' || rows || ' |' FROM w)
  SELECT row_number() OVER (ORDER BY section, part, line) AS line_no, line FROM l""")
def markdown(spark, sf):
    return R.markdown_lines("Report | all", {"Verdicts": verdict_rows(spark, sf), "Sources": written(spark, sf)})


@query("v7_account_table", "V7", oracle=cte("timeline") + f"""
  SELECT package AS service, coalesce({sql_utc("max(unix) FILTER (kind IN ('login', 'token') AND CAST(package AS BIGINT) % 3 <> 0)").replace("THEN ''", "THEN NULL")}, '—') AS last_auth_utc,
    {sql_utc('max(unix)')} AS last_activity_utc, arg_max(source, unix * 1000000 - event_id) AS source FROM timeline GROUP BY package""")
def account_table(spark, sf):
    t = timeline(spark, sf).withColumn("kind", F.when((F.col("package").cast("long") % 3 == 0) & F.col("kind").isin("login", "token"), "other").otherwise(F.col("kind")))
    return R.account_table(TL.per_service(t, "event_id"))


@query("v7_missing_sources", "V7", oracle="""
  SELECT n_name AS module FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)""")
def missing_sources(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation")
    return R.missing_sources(n.select(F.col("n_name").alias("module")), n.join(s, "n_nationkey").select(F.col("n_name").alias("module")))


@query("v7_credentials", "V7", oracle="""
  SELECT kind, place, CASE kind WHEN 'token' THEN left(v, 8) || '… (' || length(v) || ')' ELSE '…' || right(v, 2) || ' (' || length(v) || ')' END AS shown
  FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'token' ELSE 'password' END AS kind, c_mktsegment AS place, c_name AS v FROM customer)""")
def credentials(spark, sf):
    rows = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "token").otherwise("password").alias("kind"),
                                               F.col("c_mktsegment").alias("place"), F.col("c_name").alias("value"))
    return R.credential_table(rows)
