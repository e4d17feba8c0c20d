"""Registered queries: text and log readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.plans.standins import cte, table, timeline
from tracelake.registry import query
from tracelake.sources import textlogs as L


def usage_lines(spark, sf):
    """Two-field lines from events; some are malformed, some carry a zero."""
    n = F.col("event_id")
    line = (F.when(n % 30 == 9, F.concat("package", F.lit(" "))).when(n % 30 == 19, F.concat_ws(" ", "package", F.lit("x1")))
            .when(n % 30 == 29, F.concat_ws(" ", "package", F.lit("1 2")))
            .otherwise(F.concat(F.lit(" "), "package", F.lit("  "), F.floor(F.col("micros") / 1000).cast("string"))))
    return timeline(spark, sf).select(n.alias("event_id"), line.alias("value"))


def usage_list(spark, sf):
    return L.usage_rows(usage_lines(spark, sf))


@query("s5_usage_rows", "S5", oracle=cte("timeline") + """
  SELECT event_id, package, micros // 1000 AS last_used_ms FROM timeline WHERE event_id % 10 <> 9""")
def usage_rows(spark, sf):
    return usage_list(spark, sf)


NL = "\n"
SQL_LINES = """SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, trim(ls[i], ' ' || chr(9)) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls
  FROM {src}) , unnest(range(1, len(ls) + 1)) AS u(i)"""


def config_texts(spark, sf):
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("ctrl=x\ndevice_name=dev"), n, F.lit('\nnetwork={\n\tssid="net'), F.col("source"),
                    F.lit('"\n\t# a=b\n\tpsk="pw'), n, F.lit('"\n}\n'),
                    F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('network={\n\tssid="open'), "lang", F.lit('"\n\tkey_mgmt=NONE\n}\n')))
                    .when(F.col("doc_id") % 3 == 1, "network={\n\tssid=\"lost\"\nnetwork={\n\tssid=\"kept\"\n}\nnetwork={\n\tssid=\"cut\"\n")
                    .otherwise("late=1\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.alias("t"))


SQL_CONFIG = """(SELECT doc_id, 'ctrl=x' || chr(10) || 'device_name=dev' || doc_id || chr(10) || 'network={' || chr(10) || chr(9) || 'ssid="net' || source || '"' || chr(10)
  || chr(9) || '# a=b' || chr(10) || chr(9) || 'psk="pw' || doc_id || '"' || chr(10) || '}' || chr(10) || CASE doc_id % 3
    WHEN 0 THEN 'network={' || chr(10) || chr(9) || 'ssid="open' || lang || '"' || chr(10) || chr(9) || 'key_mgmt=NONE' || chr(10) || '}' || chr(10)
    WHEN 1 THEN 'network={' || chr(10) || chr(9) || 'ssid="lost"' || chr(10) || 'network={' || chr(10) || chr(9) || 'ssid="kept"' || chr(10) || '}' || chr(10)
      || 'network={' || chr(10) || chr(9) || 'ssid="cut"' || chr(10) ELSE 'late=1' || chr(10) END || text AS t FROM documents)"""
SQL_BLOCKS = f"""l AS ({SQL_LINES.format(src=SQL_CONFIG)}),
  m AS (SELECT *, CASE WHEN starts_with(line, 'network=') THEN 'open' WHEN line = '}}' THEN 'close' END AS mark FROM l WHERE line <> '' AND NOT starts_with(line, '#')),
  s AS (SELECT *, count(mark) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM m),
  k AS (SELECT doc_id, seg, mark, pos FROM s WHERE mark IS NOT NULL),
  p AS (SELECT s.doc_id, CASE WHEN b.mark = 'open' THEN b.pos ELSE -1 END AS block, trim(split_part(line, '=', 1)) AS key, s.pos,
      CASE WHEN b.mark = 'open' THEN trim(trim(substr(line, strpos(line, '=') + 1)), '"') ELSE trim(substr(line, strpos(line, '=') + 1)) END AS value
    FROM s LEFT JOIN k b ON b.doc_id = s.doc_id AND b.seg = s.seg LEFT JOIN k a ON a.doc_id = s.doc_id AND a.seg = s.seg + 1
    WHERE s.mark IS NULL AND contains(line, '=') AND (coalesce(b.mark, 'close') = 'close' OR a.mark = 'close'))"""


@query("s7_block_rows", "S7", oracle=f"WITH {SQL_BLOCKS} SELECT doc_id, block, key, arg_max(value, pos) AS value FROM p GROUP BY ALL")
def block_rows(spark, sf):
    rows = L.block_rows(config_texts(spark, sf), "t", ["doc_id"])
    return rows.withColumn("block", F.col("block").cast("long"))


@query("s7_networks", "S7", oracle=f"""WITH {SQL_BLOCKS}
  SELECT doc_id, block, max(value) FILTER (key = 'ssid') AS ssid, max(value) FILTER (key = 'psk') AS psk FROM p WHERE block >= 0 GROUP BY 1, 2""")
def networks(spark, sf):
    rows = L.block_rows(config_texts(spark, sf), "t", ["doc_id"])
    return L.blocks_wide(rows, ["doc_id"], ["ssid", "psk"]).withColumn("block", F.col("block").cast("long"))


def crash_texts(spark, sf):
    n = F.col("doc_id")
    text = F.concat(F.lit("noise: before\npackage name: com."), F.col("source"), F.lit("\n  package version: v"), n.cast("string"),
                    F.lit("\ncrash since start: about "), (n % 17).cast("string"), F.lit(" times\nsubtype: java\nhappen time: 2024-01-0"),
                    (n % 9 + 1).cast("string"), F.lit(" 10:00:00\nhappen time: 2024-02-01 11:22:33\nfree text line\npackage name: com."),
                    F.col("lang"), F.when(n % 2 == 0, "\nhappen time: 2023-05-05 01:01:01\n").otherwise("\nsubtype : native\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.alias("t"))


SQL_CRASH = """(SELECT doc_id, 'noise: before' || chr(10) || 'package name: com.' || source || chr(10) || '  package version: v' || doc_id || chr(10)
  || 'crash since start: about ' || (doc_id % 17) || ' times' || chr(10) || 'subtype: java' || chr(10) || 'happen time: 2024-01-0' || (doc_id % 9 + 1)
  || ' 10:00:00' || chr(10) || 'happen time: 2024-02-01 11:22:33' || chr(10) || 'free text line' || chr(10) || 'package name: com.' || lang
  || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'happen time: 2023-05-05 01:01:01' || chr(10) ELSE chr(10) || 'subtype : native' || chr(10) END || text AS t FROM documents)"""


@query("s8_crash_history", "S8", oracle=f"""WITH l AS ({SQL_LINES.format(src=SQL_CRASH)}),
  f AS (SELECT doc_id, pos, regexp_extract(line, '^([A-Za-z][\\w .]{{0,40}}?)\\s*:\\s*(.*)$', 1) AS key, regexp_extract(line, '^([A-Za-z][\\w .]{{0,40}}?)\\s*:\\s*(.*)$', 2) AS value
    FROM l WHERE regexp_matches(line, '^([A-Za-z][\\w .]{{0,40}}?)\\s*:\\s*(.*)$')),
  g AS (SELECT *, max(CASE WHEN key = 'package name' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS "group" FROM f)
  SELECT doc_id, "group", max(value) FILTER (key = 'package name') AS package, coalesce(arg_max(value, pos) FILTER (key = 'package version'), '') AS version,
    coalesce(try_cast(regexp_extract(arg_max(value, pos) FILTER (key = 'crash since start'), '(\\d+)', 1) AS BIGINT), 0) AS crashes_since_boot,
    coalesce(arg_max(value, pos) FILTER (key = 'subtype'), '') AS subtype, count(*) FILTER (key = 'happen time') AS occurrences,
    coalesce(min(value) FILTER (key = 'happen time'), '') AS first_time, coalesce(max(value) FILTER (key = 'happen time'), '') AS last_time
  FROM g WHERE "group" IS NOT NULL GROUP BY doc_id, "group\"""")
def crash_history(spark, sf):
    rows = L.crash_history(crash_texts(spark, sf), "t", ["doc_id"])
    return rows.withColumn("group", F.col("group").cast("long"))


@query("s9_carry_note", "S9", oracle="""
  SELECT doc_id, 'note ' || doc_id AS note, '2024-01-02 03:04:05' AS local FROM documents
  UNION ALL SELECT doc_id, '', '2024-01-02 03:05:0' || (doc_id % 10) FROM documents
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE '' END, 'x:y' FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, trim(l[i - 1]), trim(l[i]) FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(2, len(l) + 1, 2)) AS t(i)""")
def carry_note(spark, sf):
    """A few records, then the text: its lines are a note and a record in turn."""
    n = F.col("doc_id")
    lines = F.array_join(F.transform(F.split("text", NL), lambda x, i: F.concat(F.when(i % 2 == 0, "kernel reboot:").otherwise("record time_stamp:"), x)), NL)
    text = F.concat(F.lit("kernel reboot: old\nkernel reboot: note "), n.cast("string"), F.lit("\nother\n record time_stamp: 2024-01-02 03:04:05\nrecord time_stamp: 2024-01-02 03:05:0"),
                    (n % 10).cast("string"), F.lit(NL), F.when(n % 2 == 0, "kernel reboot: second\n").otherwise("kernel reboot\n"),
                    F.when(n % 3 == 0, "record time_stamp: x:y\n").otherwise("kernel reboot: unused\n"), lines)
    d = table(spark, sf, "documents").select("doc_id", text.alias("t"))
    return L.carry_note(d, "t", ["doc_id"]).select("doc_id", "note", "local")


@query("s10_debug_log", "S10", oracle="""
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'app.txt' ELSE 'app_2024.txt' END AS name, '5' AS priority, 'Tag' || source AS tag, 'MAIN' AS level,
    CASE WHEN doc_id % 4 = 0 THEN '03-0' ELSE '2024-03-0' END || (doc_id % 9 + 1) AS date, '10:11:12' AS time, trim(line) AS message
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''""")
def debug_log(spark, sf):
    """Every line of the text as the message of one log line."""
    n = F.col("doc_id")
    head = F.concat(F.lit("  5 Tag"), F.col("source"), F.lit(" [MAIN] 03-0"), (n % 9 + 1).cast("string"), F.lit(" 10:11:12 "))
    text = F.concat(F.lit("header\n"), F.array_join(F.transform(F.split("text", NL), lambda x: F.concat(head, x)), NL), F.lit("\nbad line [x]\n"))
    name = F.when(n % 4 == 0, "app.txt").otherwise("app_2024.txt")
    d = table(spark, sf, "documents").select("doc_id", name.alias("name"), text.alias("t"))
    return L.parse_debug_log(d, "t", "name", ["doc_id"]).drop("pos")


@query("s11_tombstone_fields", "S11", oracle="""
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'com.' || source || CASE WHEN doc_id % 2 = 0 THEN ':remote' ELSE '' END END AS process,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(doc_id + 100 AS VARCHAR) END AS pid, CASE WHEN doc_id % 5 = 0 THEN '' ELSE (doc_id % 12) || ' (SIG' || (doc_id % 3) || ')' END AS signal,
    'brand/' || lang || ':7.0' AS build FROM documents""")
def tombstone_fields(spark, sf):
    n = F.col("doc_id")
    pid = F.when(n % 7 == 0, "pid none").otherwise(F.concat(
        F.lit("pid: "), (n + 100).cast("string"), F.lit(", tid: 7, name: com."), "source", F.when(n % 2 == 0, ":remote").otherwise(""),
        F.when(n % 3 == 0, "").otherwise("  >>> com.x <<<")))
    sig = F.when(n % 5 == 0, "no signal").otherwise(F.concat(F.lit("signal "), (n % 12).cast("string"), F.lit(" (SIG"), (n % 3).cast("string"), F.lit("), code 1")))
    text = F.concat_ws("\n", F.lit("*** ***"), F.concat(F.lit("Build fingerprint: brand/"), "lang", F.lit(":7.0 ")), pid, sig, F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", L.tombstone_fields(text).alias("f"))
    return d.select("doc_id", "f.process", "f.pid", "f.signal", "f.build")


@query("p39_bucket_messages", "P39", oracle="""
  WITH m AS (SELECT doc_id, unnest([CASE doc_id % 6 WHEN 0 THEN 'Inode 7 Timestamp(s) on it pre-1970' WHEN 1 THEN 'Free blocks count wrong (2, counted=3).'
      WHEN 2 THEN 'Unattached inode ' || doc_id WHEN 3 THEN 'Inode 9, i_size is 4, should be 5.' WHEN 4 THEN 'Block bitmap differences: +1' ELSE 'Could not open' END
      || CASE WHEN doc_id % 2 = 0 THEN '  [Fix? no]' ELSE '  [Optimize? yes]  [Fix?]' END, 'plain words ' || source]) AS message FROM documents
    UNION ALL SELECT doc_id, line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' AND NOT regexp_matches(line, '^([$]|Warning:|Pass |exit=)'))
  SELECT bucket, CASE WHEN bucket IN ('timestamp_pre1970', 'extent_tree_short') THEN 'info' WHEN bucket = 'unreadable' THEN 'critical' WHEN bucket = 'other' THEN 'warn' ELSE 'finding' END AS severity,
    count(*) AS messages, min(message) AS sample FROM (SELECT message, CASE WHEN regexp_matches(message, 'Timestamp\\(s\\).*pre-1970') THEN 'timestamp_pre1970'
      WHEN contains(message, 'Free blocks count wrong') THEN 'free_blocks_count' WHEN contains(message, 'Unattached inode') THEN 'unattached_inode'
      WHEN regexp_matches(message, 'i_size is .* should be') THEN 'i_size_mismatch' WHEN contains(message, 'bitmap differences') THEN 'bitmap_diff'
      WHEN regexp_matches(message, '(?i)could not|unable to read|error|corrupt') THEN 'unreadable' ELSE 'other' END AS bucket FROM m) GROUP BY 1, 2""")
def bucket_messages(spark, sf):
    from tracelake.functions.rules import bucket_severity, message_bucket
    n = F.col("doc_id")
    head = (F.when(n % 6 == 0, "Inode 7 Timestamp(s) on it pre-1970").when(n % 6 == 1, "Free blocks count wrong (2, counted=3).")
            .when(n % 6 == 2, F.concat(F.lit("Unattached inode "), n.cast("string"))).when(n % 6 == 3, "Inode 9, i_size is 4, should be 5.")
            .when(n % 6 == 4, "Block bitmap differences: +1").otherwise("Could not open"))
    text = F.concat_ws("\n", F.lit("$ e2fsck\nWarning: x\nPass 1: Checking"), head, F.when(n % 2 == 0, "Fix? no").otherwise("Optimize? yes\n\nFix?"),
                       F.concat(F.lit("  plain words "), "source"), F.lit("exit=4"), "text")
    d = table(spark, sf, "documents").select("doc_id", text.alias("t"))
    m = L.checker_messages(d, "t", ["doc_id"]).withColumn("bucket", message_bucket(F.col("message")))
    return m.groupBy("bucket", bucket_severity(F.col("bucket")).alias("severity")).agg(
        F.count("*").alias("messages"), F.min("message").alias("sample"))
