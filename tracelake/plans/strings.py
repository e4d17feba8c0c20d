"""Registered queries: paths, URLs, blobs, secrets, labels and text folding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import blobs as B
from tracelake.functions import jsons as J
from tracelake.functions import paths as P
from tracelake.functions import rules as R
from tracelake.functions import secrets as S
from tracelake.functions import textfold as X
from tracelake.functions import urls as U
from tracelake.operators import scan as S_
from tracelake.plans.standins import (blobs, cte, inventory, messages, sql_package, table, timeline,
                                      token_docs, urls)
from tracelake.registry import query


@query("p20_package_of", "P20", oracle=cte("inventory", "urls") + f"""
  SELECT path, {sql_package('path')} AS package FROM (SELECT path FROM inventory UNION ALL
    SELECT regexp_replace(url, '^https?://[^/]*', '') FROM urls UNION ALL SELECT url FROM urls)""")
def package_of(spark, sf):
    u = urls(spark, sf)
    paths = (inventory(spark, sf).select("path")
             .unionAll(u.select(F.regexp_replace("url", "^https?://[^/]*", "")))
             .unionAll(u.select("url")))
    return paths.select("path", P.package_of(F.col("path")).alias("package"))


@query("p21_top_second", "P21", oracle=cte("inventory", "urls") + """
  SELECT path, coalesce(p[1], '/') AS top, coalesce(p[2], p[1], '/') AS second FROM (
    SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM (SELECT path FROM inventory
    UNION ALL SELECT regexp_replace(url, '^https?://[^/]*', '') FROM urls))""")
def top_second(spark, sf):
    paths = inventory(spark, sf).select("path").unionAll(
        urls(spark, sf).select(F.regexp_replace("url", "^https?://[^/]*", "")))
    return paths.select("path", P.top(F.col("path")).alias("top"), P.second(F.col("path")).alias("second"))


def _sql_bits(shift: int, special: int, low: str, high: str) -> str:
    return (f"CASE WHEN m & {4 << shift} <> 0 THEN 'r' ELSE '-' END || CASE WHEN m & {2 << shift} <> 0 THEN 'w' ELSE '-' END || "
            f"CASE WHEN m & {special} <> 0 THEN CASE WHEN m & {1 << shift} <> 0 THEN '{low}' ELSE '{high}' END "
            f"WHEN m & {1 << shift} <> 0 THEN 'x' ELSE '-' END")


@query("p22_mode_text", "P22", oracle=f"""
  SELECT l_orderkey, l_linenumber, m AS mode, CASE m // 4096 WHEN 8 THEN 'r/r' WHEN 4 THEN 'd/d' WHEN 10 THEN 'l/l'
    WHEN 12 THEN 's/h' WHEN 1 THEN 'p/p' WHEN 6 THEN 'b/b' WHEN 2 THEN 'c/c' ELSE '-/-' END ||
    {_sql_bits(6, 2048, 's', 'S')} || {_sql_bits(3, 1024, 's', 'S')} || {_sql_bits(0, 512, 't', 'T')} AS mode_text
  FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 131 + l_suppkey * 4099 + l_linenumber) % 65536 AS m FROM lineitem)""")
def mode_text(spark, sf):
    m = (F.col("l_partkey") * 131 + F.col("l_suppkey") * 4099 + F.col("l_linenumber")) % 65536
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", m.alias("mode"), P.mode_text(m).alias("mode_text"))


@query("p23_extension_inventory", "P23", oracle=cte("inventory") + """
  SELECT extension, count(*) AS files FROM (SELECT CASE WHEN contains(regexp_extract(path, '[^/]*$'), '.')
    THEN '.' || lower(regexp_extract(path, '[^.]*$')) ELSE '(none)' END AS extension FROM inventory) GROUP BY 1""")
def extensions(spark, sf):
    return inventory(spark, sf).groupBy(P.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"))


@query("p24_unique_names", "P24", oracle=cte("inventory") + """
  SELECT DISTINCT path, CASE WHEN f IN ('', '.', '..') THEN 'root' ELSE f END || '--' || substr(sha256(path), 1, 12) AS name
  FROM (SELECT path, regexp_replace(regexp_replace(path, '^/+|/+$', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g') AS f FROM (
    SELECT path FROM inventory UNION ALL SELECT CASE doc_id % 3 WHEN 0 THEN '/a b/' || source WHEN 1 THEN '/a_b/' || source
      ELSE '//..//' END FROM documents))""")
def unique_names(spark, sf):
    n = F.col("doc_id") % 3
    odd = table(spark, sf, "documents").select(
        F.when(n == 0, F.concat(F.lit("/a b/"), "source")).when(n == 1, F.concat(F.lit("/a_b/"), "source"))
        .otherwise("//..//").alias("path"))
    return P.unique_names(inventory(spark, sf).select("path").unionAll(odd))


@query("p25_mask", "P25", oracle="""
  SELECT c_custkey, CASE WHEN v = '' THEN '' WHEN length(v) <= 4 THEN v || ' (' || length(v) || ')'
    ELSE '…' || right(v, 4) || ' (' || length(v) || ')' END AS masked,
    CASE WHEN v = '' THEN '' WHEN length(v) <= 5 THEN v || ' (' || length(v) || ')'
    ELSE left(v, 3) || '…' || right(v, 2) || ' (' || length(v) || ')' END AS head_and_tail
  FROM (SELECT c_custkey, substr(c_name, 1, CAST(c_custkey % 19 AS BIGINT)) AS v FROM customer)""")
def mask(spark, sf):
    v = F.substr(F.col("c_name"), F.lit(1), (F.col("c_custkey") % 19).cast("int"))
    return table(spark, sf, "customer").select(
        "c_custkey", S.mask(v).alias("masked"), S.mask(v, 3, 2).alias("head_and_tail"))


SQL_MASK = """CASE k WHEN 'token' THEN CASE WHEN v = '' THEN '' WHEN length(v) <= 8 THEN v || ' (' || length(v) || ')'
    ELSE left(v, 8) || '… (' || length(v) || ')' END
  WHEN 'password' THEN CASE WHEN v = '' THEN '' WHEN length(v) <= 2 THEN v || ' (' || length(v) || ')'
    ELSE '…' || right(v, 2) || ' (' || length(v) || ')' END
  WHEN 'phone' THEN CASE WHEN length(d) < 6 THEN CASE WHEN v = '' THEN '' WHEN length(v) <= 4 THEN v || ' (' || length(v) || ')'
      ELSE left(v, 2) || '…' || right(v, 2) || ' (' || length(v) || ')' END
    ELSE CASE WHEN ends_with(v, right(d, 4)) THEN left(v, length(v) - 4) ELSE '' END || '…' || right(d, 4) END
  ELSE CASE WHEN v = '' THEN '' WHEN length(v) <= 4 THEN v || ' (' || length(v) || ')'
    ELSE '…' || right(v, 4) || ' (' || length(v) || ')' END END"""


@query("p26_mask_kind", "P26", oracle=f"""
  SELECT o_orderkey, k AS kind, {SQL_MASK} AS masked FROM (SELECT o_orderkey, v,
      CASE o_orderkey % 4 WHEN 0 THEN 'token' WHEN 1 THEN 'phone' WHEN 2 THEN 'password' ELSE 'other' END AS k,
      regexp_replace(v, '[^0-9]', '', 'g') AS d
    FROM (SELECT o_orderkey, '+48 ' || CAST(o_custkey * 7919 + o_orderkey AS VARCHAR)
      || CASE WHEN o_orderkey % 5 = 0 THEN ' x' ELSE '' END AS v FROM orders))""")
def mask_kind(spark, sf):
    n = F.col("o_orderkey")
    kind = (F.when(n % 4 == 0, "token").when(n % 4 == 1, "phone").when(n % 4 == 2, "password").otherwise("other"))
    value = F.concat(F.lit("+48 "), (F.col("o_custkey") * 7919 + n).cast("string"), F.when(n % 5 == 0, " x").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), S.mask_kind(value, kind).alias("masked"))


SQL_CLASS = """CASE WHEN starts_with(h, '53514C69746520666F726D6174203300') THEN 'sqlite'
  WHEN starts_with(h, 'ACED') THEN 'java-serialized'
  WHEN regexp_matches(h, '^(20|09|0A|0D|0B|0C)*(3C3F786D6C|3C6D61703E)') THEN 'shared-prefs-xml'
  WHEN regexp_matches(h, '^(20|09|0A|0D|0B|0C)*(7B|5B)') THEN 'json'
  WHEN starts_with(h, '0002') AND octet_length(content) > 8 THEN 'ber-properties-store' ELSE 'opaque' END"""


@query("p27_blob_class", "P27", oracle=cte("blobs") + f"""
  SELECT doc_id, {SQL_CLASS} AS class FROM (SELECT *, hex(content) AS h FROM blobs)""")
def blob_class(spark, sf):
    return blobs(spark, sf).select("doc_id", B.blob_class(F.col("content")).alias("class"))


@query("p28_class_checked", "P28", oracle=cte("blobs") + f"""
  SELECT doc_id, CASE WHEN ours = 'opaque' AND theirs <> '' THEN theirs ELSE ours END AS report,
    CASE WHEN raw = '' THEN 'no answer' WHEN theirs = '' THEN 'no label' WHEN ours = theirs THEN 'agree'
         WHEN ours = 'opaque' THEN 'theirs reported' ELSE 'disagree' END AS relation
  FROM (SELECT doc_id, {SQL_CLASS} AS ours, raw, CASE raw WHEN 'SQLite 3.x database' THEN 'sqlite'
      WHEN 'Java serialization data, version 5' THEN 'java-serialized' WHEN 'XML 1.0 document' THEN 'shared-prefs-xml'
      WHEN 'JSON text data' THEN 'json' WHEN 'UTF-8 text, with long lines' THEN 'text' ELSE '' END AS theirs
    FROM (SELECT *, hex(content) AS h, CASE (doc_id // 3) % 7 WHEN 0 THEN 'SQLite 3.x database'
      WHEN 1 THEN 'Java serialization data, version 5' WHEN 2 THEN 'XML 1.0 document' WHEN 3 THEN 'JSON text data'
      WHEN 4 THEN 'UTF-8 text, with long lines' WHEN 5 THEN 'data' ELSE '' END AS raw FROM blobs))""")
def class_checked(spark, sf):
    wording = ["SQLite 3.x database", "Java serialization data, version 5", "XML 1.0 document",
               "JSON text data", "UTF-8 text, with long lines", "data", ""]
    pick = F.floor(F.col("doc_id") / 3) % 7
    raw = F.get(F.array(*[F.lit(w) for w in wording]), pick.cast("int"))
    ours = B.blob_class(F.col("content"))
    return (blobs(spark, sf).select("doc_id", B.class_checked(ours, B.second_label(raw), raw).alias("c"))
            .select("doc_id", "c.report", "c.relation"))


@query("p29_looks_encrypted", "P29", oracle=cte("blobs") + """
  SELECT doc_id, octet_length(content) >= 512 AND NOT starts_with(h, '53514C69746520666F726D6174203300')
    AND NOT starts_with(h, 'ACED')
    AND NOT regexp_matches(left(h, 8192), '^(..)*((2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E])){4}')
    AND len(list_filter(regexp_extract_all(left(h, 16384), '..'), lambda x: x = '00')) < least(octet_length(content), 8192) // 64 AS encrypted
  FROM (SELECT doc_id, content, hex(content) AS h FROM blobs)""")
def looks_encrypted(spark, sf):
    return blobs(spark, sf).select("doc_id", B.looks_encrypted(F.col("content")).alias("encrypted"))


@query("p30_secret_verdict", "P30", oracle="""
  SELECT doc_id, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'empty' WHEN n = 2 THEN 'encrypted (v10)'
    WHEN n = 3 THEN 'encrypted (v11)' WHEN n = 4 THEN 'encrypted (v20)'
    WHEN regexp_matches(text, '^[ -~]+$') AND NOT regexp_matches(text, '[\\n\\r]') THEN 'plain text'
    ELSE 'binary (' || octet_length(encode(text)) || ' B)' END AS verdict
  FROM (SELECT doc_id, doc_id % 7 AS n, text FROM documents)""")
def secret_verdict(spark, sf):
    n, text = F.col("doc_id") % 7, F.col("text")
    blob = F.encode(F.when(n == 1, "").when(n == 2, F.concat(F.lit("v10"), text)).when(n == 3, F.concat(F.lit("v11"), text))
                    .when(n == 4, F.concat(F.lit("v20"), text)).when(n > 4, text), "UTF-8")
    return table(spark, sf, "documents").select("doc_id", S.secret_verdict(blob).alias("verdict"))


@query("p31_text_strings", "P31", oracle="""
  SELECT doc_id, CAST(len(s) AS BIGINT) AS runs, coalesce(s[1], '') AS longest, md5(array_to_string(s, chr(1))) AS digest
  FROM (SELECT doc_id, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(text, '[ -~]{4,}')),
    lambda v: {'n': -length(v), 'v': v})), lambda x: x.v) AS s FROM documents)""")
def text_strings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", B.text_strings(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("runs"), F.coalesce(F.get("s", 0), F.lit("")).alias("longest"),
                    F.md5(F.array_join("s", "\x01")).alias("digest"))


@query("p32_digit_fields", "P32", oracle="""
  SELECT doc_id, array_to_string(d, ',') AS digits, e164, number,
    CASE WHEN e164 = '' THEN '' ELSE e164 || '@s.whatsapp.net' END AS address, stated = '' AND e164 <> '' AS derived
  FROM (SELECT doc_id, d, stated, CASE WHEN stated <> '' THEN stated ELSE
      coalesce(list_filter(d, lambda v: starts_with(v, '48') AND length(v) >= 10)[1], '') END AS e164,
      coalesce(list_filter(d, lambda v: length(v) BETWEEN 8 AND 10)[1], '') AS number
    FROM (SELECT doc_id, regexp_extract(t, '(\\d{6,15})@s\\.whatsapp\\.net', 1) AS stated,
        list_transform(list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(t, '[0-9]+'),
          lambda v: length(v) BETWEEN 6 AND 15)), lambda v: {'n': -length(v), 'v': v})), lambda x: x.v) AS d
      FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' 48' || (500000000 + doc_id * 7)
        WHEN 1 THEN ' ' || (48600000000 + doc_id) || '@s.whatsapp.net' WHEN 2 THEN ' 0' || (1234567 + doc_id) ELSE '' END AS t FROM documents)))""")
def digit_fields(spark, sf):
    n = F.col("doc_id")
    tail = (F.when(n % 4 == 0, F.concat(F.lit(" 48"), (500000000 + n * 7).cast("string")))
            .when(n % 4 == 1, F.concat(F.lit(" "), (F.lit(48600000000) + n).cast("string"), F.lit("@s.whatsapp.net")))
            .when(n % 4 == 2, F.concat(F.lit(" 0"), (1234567 + n).cast("string"))).otherwise(""))
    d = table(spark, sf, "documents").select("doc_id", B.digit_fields(F.concat("text", tail)).alias("f"))
    return d.select("doc_id", F.array_join("f.digits", ",").alias("digits"), "f.e164", "f.number", "f.address", "f.derived")


SQL_HINTS = """SELECT id, url, coalesce(regexp_extract(url, 'story_fbid=(\\d+)', 1), '') AS story_fbid,
   regexp_extract(url, '[?&]id=(\\d+)', 1) AS profile_id, regexp_extract(url, '/posts/(\\d+)', 1) AS post_id,
   regexp_extract(url, '[?&]av=(\\d+)', 1) AS viewer_av, regexp_extract(url, '[?&]lst=([^&]+)', 1) AS viewer_lst FROM urls"""


@query("p33_url_hints", "P33", oracle=cte("urls") + f"""
  SELECT id, nullif(story_fbid, '') AS story_fbid, nullif(profile_id, '') AS profile_id, nullif(post_id, '') AS post_id,
    nullif(viewer_av, '') AS viewer_av, nullif(split_part(viewer_lst, ':', 1), '') AS viewer_uid,
    nullif(split_part(viewer_lst, ':', 2), '') AS author_uid, nullif(split_part(viewer_lst, ':', 3), '') AS story_ts
  FROM ({SQL_HINTS})""")
def url_hints(spark, sf):
    h = urls(spark, sf).select("id", U.url_hints(F.col("url")).alias("h"))
    names = ("story_fbid", "profile_id", "post_id", "viewer_av", "viewer_uid", "author_uid", "story_ts")
    return h.select("id", *[F.try_element_at("h", F.lit(n)).alias(n) for n in names])


@query("p34_host_query", "P34", oracle=cte("urls") + """
  SELECT id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS host,
    coalesce(url_decode(list_filter(p, lambda x: starts_with(x, 'page='))[1][6:]), '') AS page,
    coalesce(list_filter(p, lambda x: starts_with(x, 'ref='))[1][5:], '') AS ref,
    CAST(len(list_distinct(list_transform(p, lambda x: split_part(x, '=', 1)))) AS BIGINT) AS n_params
  FROM (SELECT id, url, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '=.')) AS p
    FROM (SELECT id, CASE WHEN id % 3 = 0 AND contains(url, '?') THEN url || '&page=second&ref=&k=a%20b' ELSE url END AS url FROM urls))""")
def host_query(spark, sf):
    url = F.when((F.col("id") % 3 == 0) & F.col("url").contains("?"),
                 F.concat("url", F.lit("&page=second&ref=&k=a%20b"))).otherwise(F.col("url"))
    u = urls(spark, sf).select("id", U.host(url).alias("host"), U.query_map(url).alias("q"))
    return u.select("id", "host", F.coalesce(F.try_element_at("q", F.lit("page")), F.lit("")).alias("page"),
                    F.coalesce(F.try_element_at("q", F.lit("ref")), F.lit("")).alias("ref"),
                    F.size("q").cast("long").alias("n_params"))


@query("p35_session_cookie", "P35", oracle=cte("timeline") + """
  SELECT event_id, CAST(CASE event_id % 5 WHEN 4 THEN 2 WHEN 3 THEN 5 ELSE 6 END AS BIGINT) AS fields,
    CASE WHEN event_id % 5 < 3 THEN CAST(event_id % 90 AS BIGINT) END AS prefix,
    CASE WHEN event_id % 5 < 4 THEN 'k' || package END AS session_key,
    CASE WHEN event_id % 5 < 4 THEN unix END AS issued_unix,
    CASE WHEN event_id % 5 < 4 THEN CAST(2 AS BIGINT) END AS signature_version FROM timeline""")
def session_cookie(spark, sf):
    n = F.col("event_id")
    key = F.concat(F.lit("k"), "package")
    full = F.concat_ws("%3A", (n % 90).cast("string"), key, F.lit("2"), F.col("unix").cast("string"), F.lit("-1"), F.lit("-1"))
    value = (F.when(n % 5 == 4, F.concat_ws(":", key, F.lit("x")))
             .when(n % 5 == 3, F.concat_ws(":", key, F.lit("2"), F.col("unix").cast("string"), F.lit("-1"), F.lit("-1")))
             .otherwise(full))
    c = timeline(spark, sf).select("event_id", U.decode_session_cookie(value).alias("c"))
    return c.select("event_id", F.col("c.fields").cast("long").alias("fields"), F.col("c.prefix").cast("long").alias("prefix"),
                    "c.session_key", "c.issued_unix", F.col("c.signature_version").cast("long").alias("signature_version"))


def sql_codes(column: str, table_: dict[int, str]) -> str:
    return (f"CASE WHEN {column} IS NULL THEN 'missing' "
            + " ".join(f"WHEN {column} = {code} THEN '{kind}'" for code, kind in table_.items())
            + " ELSE 'uncatalogued' END")


@query("p36_code_label", "P36", oracle=f"""
  SELECT o_orderkey, code, {sql_codes('code', R.OLDER_TYPES)} AS older, {sql_codes('code', R.NEWER_TYPES)} AS newer
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 31 <> 0 THEN o_orderkey % 60 END AS code FROM orders)""")
def code_label(spark, sf):
    code = F.when(F.col("o_orderkey") % 31 != 0, F.col("o_orderkey") % 60)
    return table(spark, sf, "orders").select(
        "o_orderkey", code.alias("code"), R.code_label(code.cast("string"), R.OLDER_TYPES).alias("older"),
        R.code_label(code.cast("string"), R.NEWER_TYPES).alias("newer"))


RULES = {"f15.db": "exact file", "f30": "thirty", "/databases/": "app database", "procstats": "process snapshots",
         ".XML": "settings file"}


@query("p37_tag_by_rules", "P37", oracle=cte("inventory") + "SELECT inode, CASE "
       + " ".join(f"WHEN regexp_extract(path, '[^/]*$') = '{k}' THEN '{v}'" for k, v in RULES.items()) + " "
       + " ".join(f"WHEN contains(path, '{k}') THEN '{v}'" for k, v in RULES.items()) + " ELSE '' END AS why FROM inventory")
def tag_by_rules(spark, sf):
    return inventory(spark, sf).select("inode", F.coalesce(R.tag_by_rules(F.col("path"), RULES), F.lit("")).alias("why"))


SQL_CATEGORY = ("CASE " + " ".join(f"WHEN contains(path, '{k}') THEN '{k}'" for k in R.CATEGORIES)
                + " WHEN starts_with(regexp_extract(path, '[^/]*$'), 'tombstone') THEN 'tombstone' ELSE 'other' END")


@query("p38_category", "P38", oracle=cte("inventory") + f"SELECT inode, {SQL_CATEGORY} AS category FROM inventory")
def category(spark, sf):
    return inventory(spark, sf).select("inode", R.category(F.col("path")).alias("category"))


def account_documents(spark, sf):
    """Documents by event_id % 6: flat, nested, with a list, no JSON, 3000 levels deep, cut off."""
    n, u = F.col("event_id") % 6, F.col("package")
    doc = (F.when(n == 0, F.concat(F.lit('{"meta": {"k": 1}, "uid": "'), u, F.lit('", "name": "user '), u, F.lit('"}')))
           .when(n == 1, F.concat(F.lit('{"a": {"b": {"id": '), u, F.lit(', "name": ""}}, "z": {"username": "u'), u, F.lit('"}}')))
           .when(n == 2, F.concat(F.lit('{"list": [{"id": 5}], "in": {"fbid": '), u, F.lit('}}')))
           .when(n == 3, "not json")
           .when(n == 4, F.when(F.col("event_id") % 60 == 4, F.concat(F.repeat(F.lit('{"d": '), F.lit(3000)), F.lit('{"id": "'), u, F.lit('"'), F.repeat(F.lit("}"), F.lit(3001)))))
           .otherwise(F.concat(F.lit('{"uid": "'), u, F.lit('", "open": ['))))
    return timeline(spark, sf).select("event_id", doc.alias("doc"))


ACCOUNT = {"uid": (("uid", "fbid", "id"), False), "name": (("name", "display_name", "username"), True)}


@query("p40_json_find", "P40", oracle=cte("timeline") + """
  SELECT event_id, CASE WHEN event_id % 6 IN (3, 5) THEN 'broken' WHEN event_id % 6 < 3 OR event_id % 60 = 4 THEN 'ok' ELSE 'empty' END AS status,
    CASE WHEN event_id % 6 < 3 OR event_id % 60 = 4 THEN package ELSE '' END AS uid,
    CASE event_id % 6 WHEN 0 THEN 'user ' || package WHEN 1 THEN 'u' || package ELSE '' END AS name FROM timeline""")
def json_find(spark, sf):
    found = account_documents(spark, sf).select("event_id", J.json_lookup(F.col("doc"), ACCOUNT).alias("f"))
    return found.select("event_id", "f.*")


@query("p40_json_fields", "P40", oracle=cte("timeline") + """
  SELECT event_id, unnest([{'path': '/meta', 'key': 'k', 'value': '1', 'kind': 'number', 'status': 'ok'}, {'path': '', 'key': 'uid', 'value': package, 'kind': 'text', 'status': 'ok'},
    {'path': '', 'key': 'name', 'value': 'user ' || package, 'kind': 'text', 'status': 'ok'}], recursive := true) FROM timeline WHERE event_id % 6 = 0
  UNION ALL SELECT event_id, unnest([{'path': '/a/b', 'key': 'id', 'value': package, 'kind': 'number', 'status': 'ok'}, {'path': '/a/b', 'key': 'name', 'value': '', 'kind': 'text', 'status': 'ok'},
    {'path': '/z', 'key': 'username', 'value': 'u' || package, 'kind': 'text', 'status': 'ok'}], recursive := true) FROM timeline WHERE event_id % 6 = 1
  UNION ALL SELECT event_id, unnest([{'path': '/list/0', 'key': 'id', 'value': '5', 'kind': 'number', 'status': 'ok'}, {'path': '/in', 'key': 'fbid', 'value': package, 'kind': 'number', 'status': 'ok'}],
    recursive := true) FROM timeline WHERE event_id % 6 = 2
  UNION ALL SELECT event_id, CASE WHEN event_id % 60 = 4 THEN repeat('/d', 3000) END, CASE WHEN event_id % 60 = 4 THEN 'id' END, CASE WHEN event_id % 60 = 4 THEN package END,
    CASE WHEN event_id % 60 = 4 THEN 'text' END, CASE WHEN event_id % 6 <> 4 THEN 'broken' WHEN event_id % 60 = 4 THEN 'ok' ELSE 'empty' END FROM timeline WHERE event_id % 6 > 2""")
def json_fields(spark, sf):
    return J.json_fields(account_documents(spark, sf), "doc", ["event_id"])


@query("p41_to_ascii", "P41", oracle="""
  SELECT doc_id, md5(regexp_replace(strip_accents(text), '[^ -~]', '?', 'g')) AS digest,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^\\x00-\\x7E]'))), '') AS odd,
    regexp_matches(text, '[^\\x00-\\x7E]') AS has_odd FROM documents""")
def to_ascii(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(X.to_ascii(text)).alias("digest"), F.array_join(F.array_sort(X.non_ascii(text)), "").alias("odd"),
        X.has_non_ascii(text).alias("has_odd"))


#: Every place of the needle, which can't overlap itself.
SQL_ON = """h AS (SELECT doc_id, text, CAST(sum(length(p[i])) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * 2 AS BIGINT) AS pos
    FROM (SELECT doc_id, text, string_split(text, 'on') AS p FROM documents WHERE contains(text, 'on')), unnest(range(1, len(p))) AS t(i)),
  c AS (SELECT doc_id, pos, replace(text[greatest(pos - 20, 0) + 1 : greatest(pos - 20, 0) + 42], 'on', '??') AS shown FROM h)"""


@query("p42_context", "P42", oracle=f"WITH {SQL_ON} SELECT doc_id, pos, shown FROM c", needle="on", around=20)
def context(spark, sf, needle, around):
    found = S_.contexts(table(spark, sf, "documents"), "text", needle, ["doc_id"], around)
    return found.select("doc_id", F.col("offset").alias("pos"), F.col("context").alias("shown"))


@query("p42_hexdump", "P42", oracle=f"""WITH {SQL_ON}
  SELECT doc_id, pos, string_agg(lpad(CAST(1000 + i AS VARCHAR), 12, '0') || '  ' || rpad(trim(regexp_replace(lower(hex(c)), '(..)', '\\1 ', 'g')), 48, ' ')
    || ' |' || array_to_string(list_transform(regexp_extract_all(hex(c), '..'), lambda x: CASE WHEN regexp_matches(x, '2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E]')
       THEN chr(CAST(('0x' || x) AS INTEGER)) ELSE '.' END), '') || '|', chr(10) ORDER BY i) AS dump
  FROM (SELECT doc_id, pos, i, unhex(hex(content)[2 * i + 1 : 2 * i + 32]) AS c FROM (SELECT doc_id, pos, encode(shown) AS content FROM c),
    unnest(range(0, octet_length(content), 16)) AS t(i)) GROUP BY doc_id, pos""", needle="on", around=20)
def hexdump(spark, sf, needle, around):
    found = S_.contexts(table(spark, sf, "documents"), "text", needle, ["doc_id"], around)
    return found.select("doc_id", F.col("offset").alias("pos"), B.hexdump(F.encode("context", "UTF-8"), F.lit(1000)).alias("dump"))


@query("p43_utf16_names", "P43", oracle=cte("timeline") + """
  SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS names,
    'com.app' || package || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',com.' || source END AS listed FROM timeline""")
def utf16_names(spark, sf):
    first = F.encode(F.concat(F.lit("com.app"), "package"), "UTF-16LE")
    other = F.when(F.col("event_id") % 4 == 0, first).otherwise(F.encode(F.concat(F.lit("com."), "source"), "UTF-16LE"))
    gap = F.unhex(F.lit("0000FF"))
    blob = F.concat(F.unhex(F.lit("53545350FE")), first, gap, other, gap, first)
    n = timeline(spark, sf).select("event_id", B.utf16_names(blob).alias("n"))
    return n.select("event_id", F.size("n").cast("long").alias("names"), F.array_join("n", ",").alias("listed"))


@query("p44_is_binary", "P44", oracle=cte("blobs") + """
  SELECT doc_id, len(list_filter(regexp_extract_all(hex(content), '..'), lambda x: regexp_matches(x, '2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E]|09|0A|0D')))
    < 0.7 * octet_length(content) AS binary FROM blobs""")
def is_binary(spark, sf):
    return blobs(spark, sf).select("doc_id", B.is_binary(F.col("content")).alias("binary"))


@query("p45_long_hex", "P45", oracle="""
  SELECT o_orderkey, CASE WHEN v >= 0 THEN printf('%x', v) ELSE lower(hex(v)) END AS hex
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN -o_orderkey ELSE o_orderkey * 1099511627 END AS v FROM orders)""")
def long_hex(spark, sf):
    n = F.col("o_orderkey")
    value = F.when(n % 2 == 1, -n).otherwise(n * 1099511627)
    return table(spark, sf, "orders").select("o_orderkey", P.long_hex(value).alias("hex"))


@query("p46_load_status", "P46", oracle="""
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'planned' WHEN o_orderkey % 11 = 0 THEN 'failed'
    WHEN o_orderkey % 5 = 1 THEN 'partial' WHEN o_orderkey % 3 = 0 THEN 'completed'
    WHEN o_orderkey % 13 = 0 THEN 'partial' ELSE 'completed' END AS status FROM orders""")
def load_status(spark, sf):
    n = F.col("o_orderkey")
    size = F.when(n % 11 != 0, n + 1)
    planned = F.when(n % 3 == 0, 0).when(n % 13 == 0, n + 2).otherwise(n + 1)
    rc = F.when(n % 5 == 1, 1).when(n % 5 == 2, 0)
    return table(spark, sf, "orders").select("o_orderkey", R.load_status(n % 7 != 0, rc, size, planned).alias("status"))


@query("p47_integrity", "P47", oracle="""
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'FAIL' WHEN doc_id % 7 = 0 THEN 'UNVERIFIED'
    WHEN doc_id % 3 = 0 THEN 'NOT_CHECKED' WHEN doc_id % 11 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM documents""")
def integrity(spark, sf):
    n, size, sha = F.col("doc_id"), F.octet_length("text"), F.sha2("text", 256)
    claimed = F.when(n % 7 == 0, F.lit("")).when(n % 11 == 0, F.sha2(F.upper("text"), 256)).otherwise(F.upper(sha))
    claimed = F.when(n % 11 == 0, F.when(n % 7 == 0, "").otherwise(F.sha2(F.concat("text", F.lit("x")), 256))).otherwise(claimed)
    return table(spark, sf, "documents").select(
        "doc_id", R.integrity(size, F.when(n % 3 != 0, sha), F.when(n % 5 == 0, size + 1).when(n % 2 == 0, size),
                              claimed).alias("verdict"))
