"""Registered queries: messages, browser history, tokens and credentials."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import rules as R
from tracelake.functions import secrets as S
from tracelake.functions.times import WEBKIT_DELTA
from tracelake.operators import accounts as A
from tracelake.operators import browser as B
from tracelake.operators import leaks as LK
from tracelake.operators import messages as M
from tracelake.operators import tokens as T
from tracelake.plans.standins import (cte, histories, messages, sql_utc, table, timeline, token_docs, urls, visits)
from tracelake.plans.strings import SQL_MASK, sql_codes
from tracelake.plans.timelines import sql_runs
from tracelake.registry import query


def sql_ms(expr):
    return sql_utc(f"({expr}) // 1000")


@query("a5_store_statistics", "A5", oracle=cte("messages") + f"""
  SELECT thread, count(*) AS messages, {sql_ms('min(ms) FILTER (ms > 0)')} AS first_utc, {sql_ms('max(ms) FILTER (ms > 0)')} AS last_utc,
    count(*) FILTER (ms = 0) AS zero_stamps, count(*) FILTER (body <> '') AS with_text, count(*) FILTER (attachments <> '') AS with_attachments,
    count(*) FILTER (outgoing) AS outgoing, count(*) FILTER (ms > 0 AND ms < 1420070400000) AS implausible,
    {sql_ms('min(ms) FILTER (ms >= 1420070400000)')} AS plausible_first_utc, {sql_ms('max(ms) FILTER (ms >= 1420070400000)')} AS plausible_last_utc
  FROM messages GROUP BY thread""")
def store_statistics(spark, sf):
    return M.store_statistics(messages(spark, sf), ["thread"])


SQL_TYPED = """typed AS (SELECT event_id AS message_id, CASE WHEN event_id % 31 <> 0 THEN event_id % 60 END AS code FROM timeline),
  media AS (SELECT event_id AS message_id, CASE event_id % 7 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'Image/jpeg' WHEN 2 THEN '' WHEN 3 THEN 'text/plain' ELSE 'application/pdf' END AS mime FROM timeline WHERE event_id % 4 = 1)"""


def typed(spark, sf):
    n = F.col("event_id")
    return timeline(spark, sf).select(n.alias("message_id"), F.when(n % 31 != 0, n % 60).alias("code"),
                                      (n % 50 == 0).cast("int").alias("starred"), (n % 9).alias("forwarded"))


def media(spark, sf):
    n = F.col("event_id")
    mime = (F.when(n % 7 == 0, "video/mp4").when(n % 7 == 1, "Image/jpeg").when(n % 7 == 2, "").when(n % 7 == 3, "text/plain").otherwise("application/pdf"))
    return timeline(spark, sf).filter(n % 4 == 1).select(n.alias("message_id"), mime.alias("mime"))


def sql_allowed():
    return "CASE kind " + " ".join(
        f"WHEN '{k}' THEN " + (f"family IN ({', '.join(repr(x) for x in v)})" if v else "false") for k, v in R.KIND_FAMILIES.items()) + " END"


@query("j12_type_profile", "J12", "A6", oracle=cte("timeline") + f""", {SQL_TYPED},
  k AS (SELECT code, {sql_codes('code', R.NEWER_TYPES)} AS kind, count(*) AS messages FROM typed GROUP BY 1, 2),
  s AS (SELECT DISTINCT code, lower(split_part(mime, '/', 1)) AS family FROM media JOIN typed USING (message_id) WHERE mime <> ''),
  o AS (SELECT k.code, array_to_string(list_sort(list(family)), ',') AS families, bool_or({sql_allowed()}) AS ok FROM k JOIN s ON k.code = s.code GROUP BY 1)
  SELECT k.code, kind, messages, coalesce(families, '') AS families, coalesce(NOT ok, false) AS disputed FROM k LEFT JOIN o ON k.code = o.code""")
def type_profile(spark, sf):
    return M.type_profile(typed(spark, sf), media(spark, sf), R.NEWER_TYPES)


@query("a6_kind_counts", "A6", oracle=cte("timeline") + f""", {SQL_TYPED}
  SELECT {sql_codes('code', R.OLDER_TYPES)} AS kind, count(*) AS messages, count(DISTINCT code) AS codes FROM typed GROUP BY 1""")
def kind_counts(spark, sf):
    kind = R.code_label(F.col("code").cast("string"), R.OLDER_TYPES).alias("kind")
    return typed(spark, sf).groupBy(kind).agg(F.count("*").alias("messages"), F.countDistinct("code").alias("codes"))


@query("a6_flag_counts", "A6", oracle="""
  SELECT 'starred' AS flag, 'PRESENT' AS status, count(*) FILTER (event_id % 50 = 0) AS n FROM events
  UNION ALL SELECT 'forwarded', 'UNREADABLE', NULL UNION ALL SELECT 'pinned', 'ABSENT', NULL""")
def flag_counts(spark, sf):
    return M.flag_counts(typed(spark, sf), ["starred", "forwarded", "pinned"], unreadable=["forwarded"])


@query("a7_table_counts", "A7", oracle="""
  WITH e AS (SELECT DISTINCT o_custkey % 50 AS file, t AS "table" FROM orders, (SELECT unnest(['F', 'O', 'P', 'receipts']) AS t))
  SELECT file, "table", CASE WHEN file % 7 = 0 AND "table" = 'P' THEN NULL ELSE coalesce(n, -1) END AS rows,
    CASE WHEN file % 7 = 0 AND "table" = 'P' THEN 'UNREADABLE' WHEN n IS NULL THEN 'ABSENT' ELSE 'PRESENT' END AS status
  FROM e LEFT JOIN (SELECT o_custkey % 50 AS file, o_orderstatus AS "table", count(*) AS n FROM orders GROUP BY 1, 2) USING (file, "table")""")
def table_counts(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("file"), F.col("o_orderstatus").alias("table"))
    expected = rows.select("file").distinct().select("file", F.explode(F.array(*[F.lit(t) for t in ("F", "O", "P", "receipts")])).alias("table"))
    return M.table_counts(rows, expected, expected.filter("file % 7 = 0 and table = 'P'"), ["file", "table"])


@query("j9_top_senders", "J9", oracle=cte("timeline") + """,
  m AS (SELECT CAST(package AS BIGINT) % 4 AS device, 'U:' || package AS user_key, source FROM timeline),
  r AS (SELECT device, 'user ' || substr(user_key, 3) AS name, count(*) AS messages, 'thread_users' AS named_by FROM m WHERE device <> 3 AND CAST(substr(user_key, 3) AS BIGINT) % 10 <> 0 GROUP BY 1, 2)
  SELECT * FROM r UNION ALL SELECT device, 'snip ' || source, count(DISTINCT user_key), 'snippet' FROM m WHERE device NOT IN (SELECT device FROM r) AND source <> 'error' GROUP BY 1, 2""")
def top_senders(spark, sf):
    t = timeline(spark, sf).withColumn("device", F.col("package").cast("long") % 4)
    key = F.concat(F.lit("U:"), "package")
    m = t.select("device", F.concat(F.lit('{"user_key": "'), key, F.lit('"}')).alias("sender"))
    users = t.filter("device <> 3").select("device", key.alias("user_key"), F.when(F.col("package").cast("long") % 10 != 0, F.concat(F.lit("user "), "package")).alias("name")).distinct()
    threads = t.select("device", "package", F.when(F.col("source") != "error", F.concat(F.lit("snip "), "source")).alias("snippet_sender")).distinct()
    return M.top_senders(m, users, threads, "device")


@query("j10_name_threads", "J10", oracle="""
  WITH c AS (SELECT DISTINCT conv_id AS n FROM conversations),
  t AS (SELECT n, CASE WHEN n % 3 = 0 THEN 'ONE_TO_ONE:' || n || ':' || (n + 1) ELSE 'GROUP:' || n END AS thread_key, CASE WHEN n % 5 = 0 THEN 'topic ' || n END AS own FROM c),
  p AS (SELECT thread_key, n + d AS uid, n, d FROM t, (SELECT unnest([0, 1, 2]) AS d) WHERE n % 3 <> 0 OR d < 2),
  w AS (SELECT thread_key, n, d, 'name ' || (uid % 40) AS who FROM p WHERE uid % 4 <> 0)
  SELECT t.thread_key, coalesce(own, CASE WHEN t.n % 3 = 0 THEN min(who) FILTER (d = 0) END, min(who), '') AS name,
    CASE WHEN own IS NOT NULL THEN 'threads.name' WHEN min(who) IS NOT NULL THEN 'thread_participants' ELSE '' END AS named_by
  FROM t LEFT JOIN w ON t.thread_key = w.thread_key GROUP BY t.thread_key, t.n, own""")
def name_threads(spark, sf):
    n = F.col("n")
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("n")).distinct()
    key = F.when(n % 3 == 0, F.concat_ws(":", F.lit("ONE_TO_ONE"), n.cast("string"), (n + 1).cast("string"))).otherwise(F.concat(F.lit("GROUP:"), n.cast("string")))
    threads = c.select("n", key.alias("thread_key"), F.when(n % 5 == 0, F.concat(F.lit("topic "), n.cast("string"))).alias("name"))
    uid = F.explode(F.when(n % 3 == 0, F.array(n, n + 1)).otherwise(F.array(n, n + 1, n + 2)))
    members = threads.select("thread_key", uid.alias("uid")).withColumn("user_key", F.concat(F.lit("FACEBOOK:"), F.col("uid").cast("string")))
    users = members.select("uid", "user_key").distinct().filter("uid % 4 <> 0").select("user_key", F.concat(F.lit("name "), (F.col("uid") % 40).cast("string")).alias("name"))
    return M.name_threads(threads, members, users)


@query("j7_search_terms", "J7", oracle=cte("histories") + f"""
  SELECT term, url, {sql_utc(f'(last_visit // 1000000 - {WEBKIT_DELTA})')} AS last_visit_utc, visit_count
  FROM histories JOIN (SELECT c_name AS term, c_custkey % (SELECT count(*) FROM pages) AS url_id FROM customer) ON id = url_id""")
def search_terms(spark, sf):
    n = table(spark, sf, "pages").agg(F.count("*")).scalar()
    terms = table(spark, sf, "customer").select(F.col("c_name").alias("term"), (F.col("c_custkey") % n).alias("url_id"))
    return B.search_terms(terms, histories(spark, sf)).drop("last_visit")


@query("j8_visits_with_urls", "J8", oracle=cte("visits", "urls") + """
  SELECT visit_id, "user", url AS address FROM visits JOIN urls ON id = url_id""")
def visits_with_urls(spark, sf):
    return B.visits_with_urls(visits(spark, sf), urls(spark, sf)).select("visit_id", "user", "address")


@query("o3_recent_urls", "O3", k=20, oracle=cte("histories") + f"""
  SELECT id, url, visit_count, {sql_utc(f'(last_visit // 1000000 - {WEBKIT_DELTA})')} AS last_visit_utc FROM histories ORDER BY last_visit DESC, id LIMIT 20""")
def recent_urls(spark, sf, k):
    return B.recent_urls(histories(spark, sf), k)


@query("a19_top_domains", "A19", k=15, oracle=cte("histories") + """
  SELECT coalesce(nullif(regexp_extract(url, '//([^/?#]*)', 1), ''), '(none)') AS host, CAST(sum(visit_count) AS BIGINT) AS visits FROM histories GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def top_domains(spark, sf, k):
    return B.top_domains(histories(spark, sf), k)


@query("u3_identity_hints", "U3", oracle=cte("histories") + """,
  h AS (SELECT *, CASE WHEN av <> '' THEN '{"viewer_av":"' || av || '"}' WHEN lst <> '' THEN '{"author_uid":"77","story_ts":"' || split_part(lst, ':', 3) || '","viewer_lst":"' || lst || '","viewer_uid":"' || split_part(lst, ':', 1) || '"}'
      ELSE '{"profile_id":"' || pid || '","story_fbid":"' || sf || '"}' END AS hints FROM (SELECT *, regexp_extract(url, '[?&]av=(\\d+)', 1) AS av, regexp_extract(url, '[?&]lst=([^&]+)', 1) AS lst,
      regexp_extract(url, '[?&]id=(\\d+)', 1) AS pid, regexp_extract(url, 'story_fbid=(\\d+)', 1) AS sf FROM histories) WHERE av <> '' OR lst <> '' OR sf <> '')
  SELECT hints, url, id FROM (SELECT *, row_number() OVER (PARTITION BY hints, url ORDER BY last_visit DESC, id) AS r FROM h) WHERE r = 1""")
def identity_hints(spark, sf):
    return B.identity_hints(histories(spark, sf))


SQL_SESSIONS = cte("visits", "urls") + f", v AS (SELECT visits.*, url AS address FROM visits JOIN urls ON id = url_id), {sql_runs('v', chr(34) + 'user' + chr(34), 'visit_time', 1800 * 1000000)}"


@query("w2_browsing_sessions", "W2", gap=1800, oracle=SQL_SESSIONS + f""",
  f AS (SELECT * FROM r),
  g AS (SELECT "user", run, unnest([regexp_extract(address, '[?&]av=(\\d+)', 1), CASE WHEN regexp_matches(address, '[?&]lst=\\d+:') THEN regexp_extract(address, '[?&]lst=(\\d+):', 1) ELSE '' END]) AS viewer FROM r)
  SELECT f."user", f.run AS session, count(*) AS visits, {sql_utc(f'(min(visit_time) // 1000000 - {WEBKIT_DELTA})')} AS start_utc, {sql_utc(f'(max(visit_time) // 1000000 - {WEBKIT_DELTA})')} AS end_utc,
    count(DISTINCT url_id) AS urls, count(DISTINCT regexp_extract(address, '//([^/?#]*)', 1)) AS hosts, count(DISTINCT regexp_extract(address, '//([^/?#]*)', 1)) > 10 AS more_domains,
    array_to_string(list_sort(list_distinct(list(regexp_extract(address, '//([^/?#]*)', 1))))[1:10], ',') AS domains,
    (SELECT count(DISTINCT viewer) FROM g WHERE g."user" = f."user" AND g.run = f.run AND viewer <> '') AS viewers FROM f GROUP BY f."user", f.run""")
def browsing_sessions(spark, sf, gap):
    u = urls(spark, sf)
    return B.sessions(B.session_visits(visits(spark, sf), u, ["user"], gap), u, ["user"])


@query("w2_session_hosts", "W2", gap=1800, oracle=SQL_SESSIONS + """
  SELECT DISTINCT "user", run AS session, regexp_extract(address, '//([^/?#]*)', 1) AS host FROM r""")
def session_hosts(spark, sf, gap):
    u = urls(spark, sf)
    return B.session_hosts(B.session_visits(visits(spark, sf), u, ["user"], gap), u, ["user"])


@query("w2_session_viewers", "W2", gap=1800, oracle=SQL_SESSIONS + """
  SELECT DISTINCT "user", run AS session, viewer FROM (SELECT "user", run, unnest([regexp_extract(address, '[?&]av=(\\d+)', 1), regexp_extract(address, '[?&]lst=(\\d+):', 1)]) AS viewer FROM r) WHERE viewer <> ''""")
def session_viewers(spark, sf, gap):
    u = urls(spark, sf)
    return B.session_viewers(B.session_visits(visits(spark, sf), u, ["user"], gap), u, ["user"])


@query("a25_visits_per_day", "A25", oracle=cte("visits") + f"""
  SELECT "user", left({sql_utc(f'(visit_time // 1000000 - {WEBKIT_DELTA})')}, 10) AS day, count(*) AS visits FROM visits GROUP BY 1, 2""")
def visits_per_day(spark, sf):
    return B.visits_per_day(visits(spark, sf), ["user"])


@query("a25_history_summary", "A25", oracle=cte("visits") + f""",
  t AS (SELECT "user", visit_time, 'term' || (visit_id % 200) AS term FROM visits WHERE visit_id % 6 = 0)
  SELECT "user", count(DISTINCT url_id) AS urls, count(*) AS visits, {sql_utc(f'(min(visit_time) // 1000000 - {WEBKIT_DELTA})')} AS first_visit, {sql_utc(f'(max(visit_time) // 1000000 - {WEBKIT_DELTA})')} AS last_visit,
    (SELECT count(*) FROM t WHERE t."user" = v."user") AS terms, (SELECT count(DISTINCT term) FROM t WHERE t."user" = v."user") AS unique_terms,
    (SELECT arg_max(term, visit_time) FROM t WHERE t."user" = v."user") AS newest_term, (SELECT arg_min(term, visit_time) FROM t WHERE t."user" = v."user") AS oldest_term
  FROM visits v GROUP BY "user\"""")
def history_summary(spark, sf):
    v = visits(spark, sf)
    terms = v.filter("visit_id % 6 = 0").select("user", "visit_time", F.concat(F.lit("term"), (F.col("visit_id") % 200).cast("string")).alias("term"))
    return B.history_summary(urls(spark, sf), v, terms, "user")


@query("a25_longest_session", "A25", gap=1800, oracle=SQL_SESSIONS + """
  SELECT "user", run AS session, visits FROM (SELECT "user", run, count(*) AS visits, row_number() OVER (PARTITION BY "user" ORDER BY count(*) DESC, run) AS n FROM r GROUP BY 1, 2) WHERE n = 1""")
def longest_session(spark, sf, gap):
    return B.longest_sessions(visits(spark, sf), urls(spark, sf), ["user"], gap)


SQL_HITS = """hits AS (SELECT doc_id, source, field, token, CASE WHEN doc_id % 3 = 0 THEN '' ELSE "user" END AS uid,
   CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'user ' || "user" END AS name, starts_with(token, 'EAAAAAAQ') OR field = 'payload' AS noise FROM token_docs)"""


def token_hits(spark, sf):
    return T.access_tokens(token_docs(spark, sf), "doc", ["doc_id", "source"])


@query("f8_token_noise", "F8", oracle=cte("token_docs") + f", {SQL_HITS} SELECT doc_id, source, field, token, uid, name, noise FROM hits")
def token_noise(spark, sf):
    return token_hits(spark, sf)


@query("f8_unread_documents", "F8", oracle=cte("token_docs") + """
  SELECT source, count(*) AS documents, count(*) FILTER (doc_id % 10 = 3) AS broken, count(*) FILTER (doc_id % 10 = 4) AS empty FROM token_docs GROUP BY source""")
def unread_documents(spark, sf):
    n = F.col("doc_id") % 10
    docs = token_docs(spark, sf).withColumn("doc", F.when(n == 3, F.concat("doc", F.lit("}"))).when(n != 4, F.col("doc")))
    return T.unread_documents(docs, "doc", ["source"])


@query("j17_merged_tokens", "J17", oracle=cte("token_docs") + f""", {SQL_HITS}
  SELECT token, coalesce(arg_min(uid, doc_id) FILTER (uid <> ''), '') AS uid, coalesce(arg_min(name, doc_id) FILTER (uid <> ''), '') AS name, arg_min(field, doc_id) AS field,
    CAST(length(token) AS BIGINT) AS length, count(*) AS occurrences, count(DISTINCT source) AS sources FROM hits WHERE NOT noise GROUP BY token""")
def merged_tokens(spark, sf):
    return T.merge_tokens(token_hits(spark, sf).filter("not noise"), "doc_id")


@query("a8_token_statistics", "A8", oracle=cte("token_docs") + f""", {SQL_HITS}
  SELECT source, count(*) AS raw_hits, count(DISTINCT token) FILTER (NOT noise) AS tokens, count(*) FILTER (NOT noise) AS occurrences,
    greatest(count(*) - count(DISTINCT token) FILTER (NOT noise), 0) AS noise_hits FROM hits GROUP BY source""")
def token_statistics(spark, sf):
    raw = T.pattern_runs(token_docs(spark, sf), F.col("doc"), ["source"], marker="EAA")
    return T.token_statistics(token_hits(spark, sf), raw, "source")


@query("a9_by_authenticator", "A9", oracle=cte("timeline") + """,
  j AS (SELECT event_id AS row_id, 'ya29.' || package || (event_id % 40) AS token, CASE CAST(package AS BIGINT) % 4 WHEN 0 THEN 'com.google.android.gm:sig:oauth2:https://mail.google.com/'
    WHEN 1 THEN 'com.google:sig:oauth2:cclog' WHEN 2 THEN 'com.whatsapp:^^key' END AS kind FROM timeline),
  d AS (SELECT token, arg_min(coalesce(kind, '-'), row_id) AS kind FROM j GROUP BY token)
  SELECT CASE WHEN kind = '-' THEN '(orphan)' ELSE split_part(kind, ':', 1) END AS authenticator, count(*) AS tokens, count(*) FILTER (contains(kind, ':oauth2:')) AS oauth2,
    count(*) FILTER (contains(kind, ':^^')) AS other_provider, count(*) FILTER (contains(kind, 'mail.google.com')) AS mail_scope FROM d GROUP BY 1""")
def by_authenticator(spark, sf):
    p = F.col("package").cast("long") % 4
    kind = (F.when(p == 0, "com.google.android.gm:sig:oauth2:https://mail.google.com/").when(p == 1, "com.google:sig:oauth2:cclog").when(p == 2, "com.whatsapp:^^key"))
    rows = timeline(spark, sf).select(F.col("event_id").alias("row_id"), F.concat(F.lit("ya29."), "package", (F.col("event_id") % 40).cast("string")).alias("token"), kind.alias("kind"))
    return T.by_authenticator(rows)


@query("a21_marker_counts", "A21", oracle="""
  SELECT doc_id, marker, n FROM (SELECT doc_id, unnest(['token', 'on', 'the']) AS marker, unnest([(length(text) - length(replace(text, 'token', ''))) // 5,
    (length(text) - length(replace(text, 'on', ''))) // 2, (length(text) - length(replace(text, 'the', ''))) // 3]) AS n FROM documents) WHERE n > 0""")
def marker_counts(spark, sf):
    return T.marker_counts(table(spark, sf, "documents"), "text", "doc_id", ("token", "on", "the"))


@query("x7_token_runs", "X7", oracle="""
  SELECT doc_id, token, min(position) AS position FROM (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS position FROM (
    SELECT doc_id, regexp_extract_all(text, '[0-9a-f]{40}') AS t FROM documents)) GROUP BY 1, 2""")
def token_runs(spark, sf):
    d = table(spark, sf, "documents")
    runs = T.first_occurrences(T.pattern_runs(d, F.col("text"), ["doc_id"], "[0-9a-f]{40}", "token"), ["doc_id"])
    return runs.withColumn("position", F.col("position").cast("long"))


@query("x8_shape_scan", "X8", oracle="""
  SELECT doc_id, shape, left(value, 8) || '… (' || length(value) || ')' AS shown, count(*) AS hits FROM (
    SELECT doc_id, 'hex40' AS shape, unnest(regexp_extract_all(text, '\\b[0-9a-f]{40}\\b')) AS value FROM documents
    UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) FROM documents) GROUP BY 1, 2, 3""")
def shape_scan(spark, sf):
    return T.shape_scan(table(spark, sf, "documents"), "text", ["doc_id"])


#: Planted secrets: short ones, with signs, with white space and in other letters; texts hold them in turn.
PLANTED = ("4821", "hunter22", "p@ss-w0rd!", "two words 7", "zażółć ✓", "never used 9")
#: What stands behind a text, by doc_id % 9: secrets between spaces, touched by signs and letters, at an edge, next to each other.
ENDS = {0: " the password is hunter22.", 1: " pin 4821 and p@ss-w0rd! too", 2: ' note "two words 7"', 3: " p@ss-w0rd!, he said", 4: "(p@ss-w0rd!)?pw=p@ss-w0rd!&x=1",
        5: "xhunter22y4821hunter22", 6: "\ntwo words 7two words 7", 7: " zażółć ✓ and zażółć ✗"}
SQL_TEXTS = "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 2 AND doc_id % 11 = 3 THEN NULL ELSE text || CASE doc_id % 9 " + " ".join(
    f"WHEN {k} THEN '" + v.replace("\n", "' || chr(10) || '") + "'" for k, v in ENDS.items()) + """ ELSE '' END END AS text,
    CASE doc_id % 3 WHEN 0 THEN 'derived' WHEN 1 THEN 'evidence' ELSE 'working' END AS artefact FROM documents),
  plain AS (SELECT unnest([""" + ", ".join(f"'{s}'" for s in PLANTED) + """]) AS s),
  hexes AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9a-f]{40}')) AS s FROM documents)"""
#: A secret leaks where a text contains it.
SQL_AUDIT = """, hit AS (SELECT artefact, doc_id, s FROM t JOIN reg ON contains(text, s)),
  c AS (SELECT artefact, count(*) AS texts, count(*) - count(text) AS skipped, (SELECT count(*) FROM reg) AS known_secrets, 0::BIGINT AS unchecked,
    (SELECT count(*) FROM hit WHERE hit.artefact = t.artefact) AS leaks, (SELECT count(DISTINCT s) FROM hit WHERE hit.artefact = t.artefact) AS secrets FROM t GROUP BY artefact)
  SELECT *, CASE WHEN known_secrets = 0 THEN 'FAIL: empty registry' WHEN artefact = 'evidence' THEN 'excluded' WHEN leaks = 0 AND skipped > 0 THEN 'NOT CHECKED' WHEN leaks = 0 THEN 'clean'
    WHEN artefact = 'working' THEN 'private mode required' ELSE 'FAIL: leak' END AS verdict FROM c"""


def audit(spark, sf, known):
    d = table(spark, sf, "documents")
    n, end = F.col("doc_id") % 3, F.col("doc_id") % 9
    planted = F.lit("")
    for k, v in ENDS.items():
        planted = F.when(end == k, v).otherwise(planted)
    text = F.when(~((n == 2) & (F.col("doc_id") % 11 == 3)), F.concat("text", planted))
    texts = d.select(text.alias("text"), F.when(n == 0, "derived").when(n == 1, "evidence").otherwise("working").alias("artefact"))
    hexes = d.select(F.explode(F.regexp_extract_all("text", F.lit("[0-9a-f]{40}"), F.lit(0))).alias("s"))
    plain = d.select(F.explode(F.array(*map(F.lit, PLANTED))).alias("s")).distinct()
    return LK.leak_audit(texts, LK.secret_registry(hexes.union(plain).filter(known), "s"), "text", "artefact")


@query("j18_leak_audit", "J18", oracle=SQL_TEXTS + ", reg AS (SELECT s FROM plain UNION SELECT s FROM hexes)" + SQL_AUDIT)
def leak_audit(spark, sf):
    return audit(spark, sf, F.lit(True))


@query("j18_not_checked", "J18", oracle=SQL_TEXTS + ", reg AS (SELECT s FROM plain WHERE s = 'never used 9')" + SQL_AUDIT)
def unchecked_registry(spark, sf):
    return audit(spark, sf, F.col("s") == "never used 9")


@query("j18_empty_registry", "J18", oracle=SQL_TEXTS + ", reg AS (SELECT s FROM plain WHERE s = 'none')" + SQL_AUDIT)
def empty_registry(spark, sf):
    return audit(spark, sf, F.col("s") == "none")


SQL_LOGINS = """logins AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'browser' ELSE 'webview' END AS store, 'https://s' || (c_custkey % 60) AS site, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS "user",
   CASE c_custkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'encrypted (v10)' WHEN 3 THEN 'binary (19 B)' ELSE 'plain text' END AS verdict FROM customer)"""


@query("a24_store_summary", "A24", oracle=f"""WITH {SQL_LOGINS}
  SELECT store, count(*) AS entries, count(*) FILTER (verdict = 'plain text') AS plain, count(*) FILTER (starts_with(verdict, 'encrypted')) AS encrypted,
    count(*) FILTER (verdict IN ('empty', 'missing')) AS empty, count(DISTINCT site) FILTER (verdict = 'plain text') AS plain_sites,
    count(DISTINCT "user") FILTER (verdict = 'plain text' AND "user" <> '') AS plain_users FROM logins GROUP BY store""")
def store_summary(spark, sf):
    n = F.col("c_custkey")
    blob = (F.when(n % 6 == 1, F.encode(F.lit(""), "UTF-8")).when(n % 6 == 2, F.encode(F.concat(F.lit("v10"), "c_name"), "UTF-8"))
            .when(n % 6 == 3, F.concat(F.unhex(F.lit("00")), F.encode("c_name", "UTF-8"))).when(n % 6 > 3, F.encode("c_name", "UTF-8")))
    rows = table(spark, sf, "customer").select(
        F.when(n % 2 == 0, "browser").otherwise("webview").alias("store"), F.concat(F.lit("https://s"), (n % 60).cast("string")).alias("site"),
        F.when(n % 9 == 0, "").otherwise(F.col("c_name")).alias("user"), S.secret_verdict(blob).alias("verdict"))
    return A.store_summary(rows, ["store"])


@query("f9_session_cookies", "F9", "A24", oracle=cte("timeline") + """
  SELECT event_id, name, CASE WHEN length(v) <= 8 THEN v || ' (' || length(v) || ')' ELSE left(v, 8) || '… (' || length(v) || ')' END AS value FROM (
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'xs' WHEN 1 THEN 'c_user' WHEN 2 THEN 'lang' WHEN 3 THEN 'fr' ELSE 'wd' END AS name,
      CASE WHEN event_id % 4 = 3 THEN '' ELSE CAST(unix AS VARCHAR) || package END AS v FROM timeline) WHERE name <> 'lang' AND v <> ''""")
def session_cookies(spark, sf):
    n = F.col("event_id")
    name = F.when(n % 5 == 0, "xs").when(n % 5 == 1, "c_user").when(n % 5 == 2, "lang").when(n % 5 == 3, "fr").otherwise("wd")
    cookies = timeline(spark, sf).select("event_id", name.alias("name"), F.when(n % 4 != 3, F.concat(F.col("unix").cast("string"), "package")).otherwise("").alias("value"))
    return A.session_cookies(cookies)


@query("a24_accounts_by_type", "A24", oracle="""
  SELECT c_mktsegment AS type, count(*) AS accounts, count(DISTINCT c_custkey % 700) AS names, count(*) FILTER (c_custkey % 4 < 2) AS with_secret FROM customer GROUP BY 1""")
def accounts_by_type(spark, sf):
    n = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("type"), F.concat(F.lit("user "), (n % 700).cast("string")).alias("name"),
                                               F.when(n % 4 < 2, F.col("c_name")).when(n % 4 == 2, "").alias("secret"))
    return A.accounts_by_type(rows)


SQL_COOKIES = cte("timeline") + """, cookies AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'browser' ELSE 'webview' END AS store, '.h' || (event_id % 90) || '.com' AS host,
    CASE event_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'encrypted (v10)' ELSE 'plain text' END AS verdict FROM timeline)"""


def cookies(spark, sf):
    n = F.col("event_id")
    blob = F.when(n % 4 == 0, F.encode(F.lit(""), "UTF-8")).when(n % 4 == 1, F.encode(F.concat(F.lit("v10"), "package"), "UTF-8")).otherwise(F.encode("package", "UTF-8"))
    return timeline(spark, sf).select(F.when(n % 2 == 0, "browser").otherwise("webview").alias("store"), F.concat(F.lit(".h"), (n % 90).cast("string"), F.lit(".com")).alias("host"),
                                      S.secret_verdict(blob).alias("verdict"))


@query("a24_cookie_stores", "A24", oracle=SQL_COOKIES + """
  SELECT store, count(*) AS cookies, count(*) FILTER (verdict <> 'encrypted (v10)') AS readable, count(DISTINCT host) AS hosts FROM cookies GROUP BY store""")
def cookie_stores(spark, sf):
    return A.cookie_stores(cookies(spark, sf), ["store"])


@query("a24_cookie_hosts", "A24", oracle=SQL_COOKIES + " SELECT store, host, count(*) AS cookies FROM cookies GROUP BY ALL")
def cookie_hosts(spark, sf):
    return A.cookie_hosts(cookies(spark, sf), ["store"])
