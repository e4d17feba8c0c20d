"""Registered queries: text search, signatures, scan budgets and recovered names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import blobs as BL
from tracelake.operators import hits as C
from tracelake.operators import scan as S
from tracelake.plans.blocks import SQL_INDEX, index
from tracelake.plans.standins import BLOCK, blobs, cte, table
from tracelake.registry import query
from tracelake.sources.binaries import large_manifest as large_manifest_of
from tracelake.sources.binaries import read_binaries, read_ranges

NEEDLE = "tion"
# The needle cannot overlap itself, so splitting gives every place (tests cover overlaps).
SQL_HITS = """h AS (SELECT doc_id, text, CAST(sum(length(p[i])) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {n} AS BIGINT) AS "offset"
  FROM (SELECT doc_id, text, string_split(text, '{s}') AS p FROM documents WHERE contains(text, '{s}')), unnest(range(1, len(p))) AS t(i))"""


@query("x1_literal_search", "X1", needle=NEEDLE, oracle=f"WITH {SQL_HITS.format(n=4, s=NEEDLE)} SELECT doc_id, \"offset\" FROM h")
def literal_search(spark, sf, needle):
    return S.search_text(table(spark, sf, "documents"), "text", needle, ["doc_id"])


@query("x1_chunk_search", "X1", needle="token", size=256, oracle="""
  SELECT doc_id, CAST(i AS BIGINT) AS "offset" FROM (SELECT doc_id, hex(content) AS h, unnest(list_filter(range(octet_length(content)), lambda i: substr(hex(content), 2 * i + 1, 10) = '746F6B656E')) AS i
    FROM (SELECT doc_id, encode(text) AS content FROM documents WHERE contains(text, 'token')))""")
def chunk_search(spark, sf, needle, size):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return S.search_chunks(S.chunk_rows(d, "doc_id", "content", size), "doc_id", needle.encode(), size)


@query("x1_file_search", "X1", needle="PAR1")
def file_search(spark, sf, needle):
    """A literal in the bytes of all files of the folder, read by ranges (no SQL: it can't read files by name)."""
    chunks = read_ranges(spark, sf, 1 << 18)
    return S.search_chunks(chunks.select("path", "chunk", "data"), "path", needle.encode(), 1 << 18)


@query("s14_large_manifest", "S14")
def large_manifest(spark, sf):
    """Size and SHA-256 of all files of the folder, and of one that is not there."""
    files = read_binaries(spark, sf).select("path", F.col("length").alias("declared_size"))
    absent = spark.range(1).select(F.lit(f"file://{sf}/absent").alias("path"), F.lit(1).cast("long").alias("declared_size"))
    return large_manifest_of(files.unionByName(absent), 1 << 20)


@query("x2_regex_search", "X2", pattern="[0-9]{1,3}(\\.[0-9]{1,3}){3}", oracle="""
  SELECT doc_id, match, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}(\\.[0-9]{1,3}){3}')) AS match FROM documents) GROUP BY 1, 2""")
def regex_search(spark, sf, pattern):
    # Offsets are not asked for, so a built-in finds the matches and no text reaches Python.
    hits = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("match"))
    return hits.groupBy("doc_id", "match").agg(F.count("*").alias("hits"))


@query("x2_regex_offsets", "X2", pattern="[0-9]{6,}", oracle="""
  SELECT doc_id, sum(length(p[i]) + CASE WHEN i > 1 THEN length(m[i - 1]) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS "offset", m[i] AS match
  FROM (SELECT doc_id, regexp_split_to_array(text, '[0-9]{6,}') AS p, regexp_extract_all(text, '[0-9]{6,}') AS m FROM documents), unnest(range(1, len(m) + 1)) AS t(i)""")
def regex_offsets(spark, sf, pattern):
    return S.regex_search(table(spark, sf, "documents"), "text", pattern, ["doc_id"])


@query("x3_hit_report", "X3", oracle=cte("extents") + f""", {SQL_INDEX}, {SQL_HITS.format(n=4, s=NEEDLE)},
  p AS (SELECT doc_id, doc_id * {1000 * BLOCK} + "offset" AS "offset", replace(text[greatest("offset" - 64, 0) + 1 : greatest("offset" - 64, 0) + 132], '{NEEDLE}', '????') AS context FROM h)
  SELECT doc_id, "offset", context, path, (logical + "offset" // {BLOCK} - physical) * {BLOCK} + "offset" % {BLOCK} AS file_offset
  FROM p LEFT JOIN idx ON "offset" // {BLOCK} >= physical AND "offset" // {BLOCK} < physical + count""")
def hit_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return S.hit_report(d, "text", "doc_id", F.col("doc_id") * (1000 * BLOCK), NEEDLE, index(spark, sf), BLOCK)


@query("o4_first_hits", "O4", k=50, oracle=f"""WITH {SQL_HITS.format(n=4, s=NEEDLE)}
  SELECT doc_id, "offset", (SELECT count(*) FROM h) > 50 AS truncated FROM h ORDER BY doc_id, "offset" LIMIT 50""")
def first_hits(spark, sf, k):
    return S.first_hits(S.search_text(table(spark, sf, "documents"), "text", NEEDLE, ["doc_id"]), ["doc_id", "offset"], k)


@query("x9_embedded_db_names", "X9", oracle="""
  SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(['/data/com.' || source || '/databases/s' || (doc_id % 4) || '.db'],
    list_filter(list_transform(string_split(text, '.'), lambda x: regexp_extract(x, '[ -~]{16,}$') || '.db'), lambda x: length(x) > 3)))), ',') AS listed FROM documents""")
def embedded_db_names(spark, sf):
    """A name twice between bytes that end it, then the text, whose sentences end in .db instead of a stop."""
    name = F.concat(F.lit("/data/com."), "source", F.lit("/databases/s"), (F.col("doc_id") % 4).cast("string"), F.lit(".db"))
    text = F.array_join(F.transform(F.split("text", r"\."), lambda x: F.concat(x, F.lit(".db"))), "\x01")
    blob = F.concat(F.unhex(F.lit("00FF")), F.encode(name, "UTF-8"), F.unhex(F.lit("00")), F.encode(F.lit("x.db"), "UTF-8"),
                    F.unhex(F.lit("01")), F.encode(name, "UTF-8"), F.unhex(F.lit("0A")), F.encode(text, "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(BL.embedded_db_names(BL.latin(blob)), ",").alias("listed"))


# Planted objects, by doc_id % 9; the text follows them in the same run of blocks.
PNG = ("89504E470D0A1A0A0000000D4948445200000001000000010806000000" "1F15C489" "0000000049454E44AE426082")
ZIP = "504B03040A00000000000000000000000000030000000300000001000000" "61" "616263" "504B0506" + "00" * 18
PLANTED = {0: PNG, 1: "255044462D312E34", 2: ZIP, 3: "474946383961" "1000" "1000", 4: "FFD8FFE000040000FFC0000B08001000100101110000FFD9",
           5: "1F8B0800000000000203" "4B4C4A0600C241243503000000", 6: "7F454C4602010100" "0000000000000000" "0300B700", 7: "504B0304FFFF"}
SPACE = 512


def image_blocks(spark, sf):
    """Each document is one run of 512-byte blocks: a planted object, then its text."""
    n = F.col("doc_id")
    lead = F.lit("")
    for rest, hexed in PLANTED.items():
        lead = F.when(n % 9 == rest, hexed).otherwise(lead)
    whole = F.concat(F.unhex(lead), F.encode("text", "UTF-8"), F.when(n % 9 == 1, F.encode(F.lit("%%EOF\n"), "UTF-8")).otherwise(F.unhex(F.lit(""))))
    count = F.ceil(F.octet_length("whole") / SPACE)
    padded = F.concat("whole", F.unhex(F.repeat(F.lit("00"), (count * SPACE - F.octet_length("whole")).cast("int"))))
    d = table(spark, sf, "documents").select("doc_id", whole.alias("whole")).withColumn("padded", padded).withColumn("n", count)
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")
    cut = d.select("doc_id", "padded", "n", i)
    return cut.select(n.alias("run"), (n * 100 + F.col("i")).alias("block"), (n * 100 + F.col("n") - 1).alias("run_last"),
                      F.substring("padded", (F.col("i") * SPACE + 1).cast("int"), F.lit(SPACE)).alias("data"))


SQL_IMAGE = f"""b AS (SELECT doc_id, h || repeat('00', (({SPACE} - (length(h) // 2) % {SPACE}) % {SPACE})::INTEGER) AS h FROM (SELECT doc_id, CASE doc_id % 9 """ + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in PLANTED.items()) + """ ELSE '' END || hex(encode(text)) || CASE WHEN doc_id % 9 = 1 THEN '2525454F460A' ELSE '' END AS h FROM documents)),
  blocks AS (SELECT doc_id AS run, doc_id * 100 + i AS block, h[i * """ + str(2 * SPACE) + " + 1 : i * " + str(2 * SPACE) + " + " + str(2 * SPACE) + "] AS h FROM b, unnest(range(length(h) // " + str(2 * SPACE) + ")) AS t(i))"


@query("x4_signature_scan", "X4", oracle=f"WITH {SQL_IMAGE}, sig AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{m}', {o}, '{g}')" for k, m, o, g in S.SIGNATURES) + f""") AS s(kind, magic, shift, grade)),
  w AS (SELECT run, block, length(h) // 2 AS size, h || coalesce(left(lead(h) OVER (PARTITION BY run ORDER BY block), 40), '') AS h FROM blocks),
  c AS (SELECT run, block, size, kind, grade, shift, unnest(list_filter(range(length(h) // 2), lambda i: substr(h, 2 * i + 1, length(magic)) = magic)) AS i FROM w, sig WHERE contains(h, magic))
  SELECT run, block, kind, CAST(i - shift AS INTEGER) AS start, grade FROM c WHERE i >= shift AND i - shift < size""")
def signature_scan(spark, sf):
    return S.signature_hits(image_blocks(spark, sf), ["run", "block"], number="block")


@query("x5_budget", "W14", budget=40, oracle="""
  WITH r AS (SELECT doc_id % 20 AS volume, doc_id AS first, n_chars // 500 + 1 AS count FROM documents),
  u AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY volume ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r)
  SELECT volume, first, count, CAST(greatest(0, least(count, 40 - used)) AS BIGINT) AS take, greatest(0, least(count, 40 - used)) = count AS complete FROM u""")
def budget_runs(spark, sf, budget):
    runs = table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("volume"), F.col("doc_id").alias("first"),
                                                (F.floor(F.col("n_chars") / 500) + 1).alias("count"))
    return C.within_budget(runs, ["volume"], budget)


def overlapping_hits(spark, sf):
    n = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (n % 3).alias("run"), (n * 40 + (F.col("o_custkey") % 30)).alias("offset"), F.col("o_orderstatus").alias("kind"),
        ((F.col("o_custkey") * 13) % 700 + 1).alias("length"), (F.col("o_custkey") % 5 == 0).alias("truncated"))


@query("w14_drop_nested", "W14", oracle="""
  WITH RECURSIVE d AS (SELECT o_orderkey % 3 AS run, o_orderkey * 40 + o_custkey % 30 AS "offset", o_orderstatus AS kind, (o_custkey * 13) % 700 + 1 AS length, o_custkey % 5 = 0 AS truncated FROM orders),
  o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY "offset", kind) AS n FROM d),
  f AS (SELECT run, n, true AS kept, CASE WHEN truncated THEN -1 ELSE "offset" + length END AS reach FROM o WHERE n = 1
    UNION ALL SELECT o.run, o.n, o."offset" >= f.reach, CASE WHEN o."offset" >= f.reach AND NOT o.truncated THEN o."offset" + o.length ELSE f.reach END FROM f JOIN o ON o.run = f.run AND o.n = f.n + 1)
  SELECT o.run, "offset", kind, length, truncated FROM o JOIN f ON f.run = o.run AND f.n = o.n WHERE kept""")
def drop_nested(spark, sf):
    return C.drop_nested(overlapping_hits(spark, sf), ["run"])


@query("a26_name_summary", "A26", oracle="""
  SELECT l_linenumber * 2 - 1 AS kind, count(*) AS names, count(DISTINCT l_suppkey) AS directories, count(*) FILTER (l_linenumber * 2 - 1 > 8) AS implausible FROM lineitem GROUP BY 1""")
def name_summary(spark, sf):
    e = table(spark, sf, "lineitem").select((F.col("l_linenumber") * 2 - 1).alias("kind"), F.col("l_suppkey").alias("directory"))
    return S.name_summary(e)


@query("a26_top_directories", "A26", k=10, oracle="""
  SELECT l_suppkey AS directory, count(*) AS entries FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_directories(spark, sf, k):
    from tracelake.operators.timeline import ranked
    counted = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("directory")).agg(F.count("*").alias("entries"))
    return ranked(counted, "directory", "entries", k)
