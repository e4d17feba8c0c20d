"""Registered queries: blocks, extents and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import ranges as R
from tracelake.plans.standins import BLOCK, cte, extents, table
from tracelake.registry import query

SQL_INDEX = "idx AS (SELECT '/data/f' || inode AS path, inode * 100 + seq AS rank, inode, logical, physical, count FROM extents)"
SQL_ASKED = f"asked AS (SELECT o_orderkey AS id, o_orderkey * {1000 * BLOCK} + (o_custkey % 400) * {BLOCK} + o_orderkey % {BLOCK} AS offset FROM orders)"


def index(spark, sf):
    return extents(spark, sf).select(F.concat(F.lit("/data/f"), F.col("inode").cast("string")).alias("path"),
                                     (F.col("inode") * 100 + F.col("seq")).alias("rank"), "logical", "physical", "count")


def asked(spark, sf):
    n = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        n.alias("id"), (n * (1000 * BLOCK) + (F.col("o_custkey") % 400) * BLOCK + n % BLOCK).alias("offset"))


@query("j4_offset_owner", "J4", oracle=cte("extents") + f", {SQL_INDEX}, {SQL_ASKED}" + f"""
  SELECT id, "offset", "offset" // {BLOCK} AS block, arg_min(path, rank) AS path,
    arg_min((logical + "offset" // {BLOCK} - physical) * {BLOCK} + "offset" % {BLOCK}, rank) AS file_offset, count(path) AS owners
  FROM asked LEFT JOIN idx ON "offset" // {BLOCK} >= physical AND "offset" // {BLOCK} < physical + count GROUP BY id, "offset\"""")
def offset_owner(spark, sf):
    return R.offset_owner(asked(spark, sf), index(spark, sf), BLOCK)


@query("j4_competing_owners", "J4", oracle=cte("extents") + f", {SQL_INDEX}, {SQL_ASKED}" + f"""
  SELECT id, "offset", "offset" // {BLOCK} AS block, path, rank, (logical + "offset" // {BLOCK} - physical) * {BLOCK} + "offset" % {BLOCK} AS file_offset
  FROM asked JOIN idx ON "offset" // {BLOCK} >= physical AND "offset" // {BLOCK} < physical + count""")
def competing_owners(spark, sf):
    return R.owners_of_offsets(asked(spark, sf), index(spark, sf), BLOCK).filter("path is not null")


@query("j5_image_offset", "J5", oracle=cte("extents") + f"""
  SELECT inode, file_offset, (physical + file_offset // {BLOCK} - logical) * {BLOCK} + file_offset % {BLOCK} AS image_offset
  FROM (SELECT o_orderkey AS inode, (o_custkey % 300) * {BLOCK} + o_orderkey % {BLOCK} AS file_offset FROM orders) q
  LEFT JOIN extents e USING (inode) WHERE file_offset // {BLOCK} >= logical AND file_offset // {BLOCK} < logical + count
  UNION ALL SELECT inode, file_offset, NULL FROM (SELECT o_orderkey AS inode, (o_custkey % 300) * {BLOCK} + o_orderkey % {BLOCK} AS file_offset FROM orders) q
  WHERE NOT EXISTS (SELECT 1 FROM extents e WHERE e.inode = q.inode AND file_offset // {BLOCK} >= logical AND file_offset // {BLOCK} < logical + count)""")
def image_offset(spark, sf):
    n = F.col("o_orderkey")
    q = table(spark, sf, "orders").select(n.alias("inode"), ((F.col("o_custkey") % 300) * BLOCK + n % BLOCK).alias("file_offset"))
    return R.image_offsets(q, extents(spark, sf), BLOCK)


@query("j5_extent_listing", "J5", oracle=cte("extents") + f"""
  SELECT inode, logical, physical, count, physical * {BLOCK} AS image_start, (physical + count) * {BLOCK} AS image_end FROM extents""")
def extent_listing(spark, sf):
    return R.extent_listing(extents(spark, sf), BLOCK)


def free_ids(spark, sf):
    """Per supplier group, the parts it does not sell are its free blocks."""
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("volume"), F.col("l_partkey").alias("block")).filter("block % 11 <> 3")


SQL_FREE = "free AS (SELECT DISTINCT l_suppkey % 5 AS volume, l_partkey AS block FROM lineitem WHERE l_partkey % 11 <> 3)"
SQL_RUNS = """runs AS (SELECT volume, min(block) AS first, count(*) AS count FROM (SELECT volume, block, block - row_number() OVER (PARTITION BY volume ORDER BY block) AS g FROM free) GROUP BY volume, g)"""


@query("w11_free_runs", "W11", width=64, oracle=f"WITH {SQL_FREE}, {SQL_RUNS} SELECT volume, first, count FROM runs")
def free_runs(spark, sf, width):
    return R.runs_of(free_ids(spark, sf), ["volume"], "block", width)


@query("a11_run_shape", "A11", oracle=f"""WITH {SQL_FREE}, {SQL_RUNS}
  SELECT volume, count(*) AS runs, CAST(sum(count) AS BIGINT) AS blocks, max(count) AS longest, max(count) * 4096 AS longest_bytes, arg_max(first, count * 10000000 - first) AS longest_first,
    count(*) FILTER (count = 1) AS size_1, count(*) FILTER (count BETWEEN 2 AND 8) AS size_2_8, count(*) FILTER (count BETWEEN 9 AND 128) AS size_9_128,
    count(*) FILTER (count BETWEEN 129 AND 1024) AS size_129_1024, count(*) FILTER (count > 1024) AS size_over_1024 FROM runs GROUP BY volume""")
def run_shape(spark, sf):
    return R.run_shape(R.runs_of(free_ids(spark, sf), ["volume"], "block"), ["volume"], 4096)


SQL_HOLED = "holed AS (SELECT inode, logical + CASE WHEN inode % 3 = 0 AND seq > 2 THEN 7 ELSE 0 END AS logical, physical, count FROM extents)"


def holed(spark, sf):
    shift = F.when((F.col("inode") % 3 == 0) & (F.col("seq") > 2), 7).otherwise(0)
    return extents(spark, sf).select("inode", (F.col("logical") + shift).alias("logical"), "physical", "count")


@query("w13_extent_holes", "W13", width=32, oracle=cte("extents") + f""", {SQL_HOLED},
  r AS (SELECT inode, logical, coalesce(max(logical + count) OVER (PARTITION BY inode ORDER BY logical, count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM holed)
  SELECT inode, arg_min(reach, logical) AS hole_at, min(logical) AS next_logical FROM r WHERE logical > reach GROUP BY inode""")
def extent_holes(spark, sf, width):
    return R.extent_holes(holed(spark, sf), "inode", width)


@query("w13_hole_bytes", "W13", oracle=cte("extents") + f""", {SQL_HOLED}
  SELECT o_orderkey AS inode, greatest(0, size - coalesce(covered, 0)) AS hole_bytes FROM (SELECT o_orderkey, (o_custkey % 200) * {BLOCK} AS size FROM orders)
  LEFT JOIN (SELECT inode, CAST(sum(greatest(0, least((logical + count) * {BLOCK}, (o_custkey % 200) * {BLOCK}) - logical * {BLOCK})) AS BIGINT) AS covered
    FROM holed JOIN orders ON o_orderkey = inode GROUP BY inode) ON inode = o_orderkey""")
def hole_bytes(spark, sf):
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("inode"), ((F.col("o_custkey") % 200) * BLOCK).alias("size"))
    return R.hole_bytes(files, holed(spark, sf), "inode", BLOCK)


@query("w15_systematic_sample", "W15", cap=100, oracle=f"""WITH {SQL_FREE},
  p AS (SELECT volume, block, row_number() OVER (PARTITION BY volume ORDER BY block) - 1 AS position, count(*) OVER (PARTITION BY volume) AS total FROM free)
  SELECT DISTINCT volume, block, position FROM p, range(100) AS i(i) WHERE position = i * total // 100""")
def systematic_sample(spark, sf, cap):
    return R.systematic_sample(free_ids(spark, sf), ["volume"], "block", cap)


@query("w15_stride_sample", "W15", limit=40, oracle=f"""WITH {SQL_FREE},
  p AS (SELECT volume, block, row_number() OVER (PARTITION BY volume ORDER BY block) - 1 AS position, greatest(1, count(*) OVER (PARTITION BY volume) // 40) AS stride FROM free)
  SELECT volume, block, position FROM p WHERE position % stride = 0 AND position // stride < 40""")
def stride_sample(spark, sf, limit):
    return R.stride_sample(free_ids(spark, sf), ["volume"], "block", limit)


@query("j16_metadata_overlap", "J16", oracle=cte("extents") + """,
  f AS (SELECT DISTINCT o_orderkey * 1000 + o_custkey % 60 AS block FROM orders),
  m AS (SELECT DISTINCT physical + i AS block FROM extents, unnest(range(count)) AS t(i) WHERE inode % 10 = 0),
  e AS (SELECT DISTINCT physical + count - 1 AS block FROM extents WHERE inode % 10 = 0)
  SELECT count(*) AS overlap, count(*) FILTER (block IN (SELECT block FROM e)) AS at_extent_end, count(*) FILTER (block NOT IN (SELECT block FROM e)) AS interior
  FROM f WHERE block IN (SELECT block FROM m)""")
def metadata_overlap(spark, sf):
    free = table(spark, sf, "orders").select((F.col("o_orderkey") * 1000 + F.col("o_custkey") % 60).alias("block"))
    meta = extents(spark, sf).filter("inode % 10 = 0").select(F.col("physical").alias("first"), "count")
    return R.metadata_overlap(free, meta)


SQL_RECOVER = """fr AS (SELECT o_orderkey * 1000 + (o_custkey % 5) * 20 AS first, CASE o_custkey % 4 WHEN 0 THEN 1000 - (o_custkey % 5) * 20 ELSE (o_custkey % 4) * 40 END AS count FROM orders WHERE o_orderkey % 6 <> 0),
  fb AS (SELECT first + i AS block FROM fr, unnest(range(count)) AS t(i)),
  eb AS (SELECT inode, physical + i AS block FROM extents, unnest(range(count)) AS t(i)),
  v AS (SELECT o_orderkey AS inode, count(eb.block) AS blocks, count(fb.block) AS free FROM orders LEFT JOIN eb ON inode = o_orderkey LEFT JOIN fb ON fb.block = eb.block
    WHERE o_orderstatus = 'F' GROUP BY 1)"""


def recover_rows(spark, sf):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    runs = table(spark, sf, "orders").filter(n % 6 != 0).select(
        (n * 1000 + (c % 5) * 20).alias("first"), F.when(c % 4 == 0, 1000 - (c % 5) * 20).otherwise((c % 4) * 40).alias("count"))
    items = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(n.alias("inode"))
    return R.recoverability(items, extents(spark, sf), runs, "inode")


@query("j21_recoverability", "J21", oracle=cte("extents") + f""", {SQL_RECOVER}
  SELECT inode, blocks, free, CASE WHEN blocks = 0 THEN 'no blocks' WHEN free = blocks THEN 'all free' WHEN free = 0 THEN 'all reused' ELSE 'mixed' END AS verdict FROM v""")
def recoverability(spark, sf):
    return recover_rows(spark, sf)


@query("j21_verdict_counts", "J21", oracle=cte("extents") + f""", {SQL_RECOVER}
  SELECT CASE WHEN blocks = 0 THEN 'no blocks' WHEN free = blocks THEN 'all free' WHEN free = 0 THEN 'all reused' ELSE 'mixed' END AS verdict, count(*) AS items FROM v GROUP BY 1""")
def verdict_counts(spark, sf):
    return recover_rows(spark, sf).groupBy("verdict").agg(F.count("*").alias("items"))
