"""Blocks, extents and runs.

Intervals meet points and other intervals on fixed-width chunks: a short interval
is repeated once per chunk it touches, so the join stays an equi-join. Windows run
inside a chunk, whose distinct whole numbers are bounded by its width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1024
WIDTH = 65536


def _floor_div(col: Column, width: int) -> Column:
    """Exact floor of whole numbers; a division of doubles is off by one near large multiples."""
    whole = col.cast("long")
    return F.call_function("div", whole - F.pmod(whole, F.lit(width)), F.lit(width))


def chunked(df: DataFrame, first: str, count: str, width: int = CHUNK, name: str = "_chunk") -> DataFrame:
    """One row per chunk an interval touches."""
    last = F.col(first) + F.col(count) - 1
    return df.filter(F.col(count) > 0).withColumn(
        name, F.explode(F.sequence(_floor_div(F.col(first), width), _floor_div(last, width))))


def blocks_of(df: DataFrame, first: str, count: str, keep: list[str] = ()) -> DataFrame:
    return df.filter(F.col(count) > 0).select(
        *keep, F.explode(F.sequence(F.col(first), F.col(first) + F.col(count) - 1)).alias("block"))


def owners_of_offsets(offsets: DataFrame, extents: DataFrame, block_size: int, by: list[str] = ()) -> DataFrame:
    """Byte offsets to every owner of their block; offsets nobody owns stay with a null path.

    ``extents`` carry path, rank (index order), physical, logical, count. The file
    offset always comes from the first mapping of the block, as competing owners
    share it; ``position`` 1 is that first owner. Columns ``by`` (a device, say) are
    in both tables; only equal ones meet.
    """
    asked = (offsets.withColumn("block", _floor_div(F.col("offset"), block_size))
             .withColumn("_chunk", _floor_div(F.col("block"), CHUNK)))
    hit = ((F.col("block") >= F.col("physical")) & (F.col("block") < F.col("physical") + F.col("count")))
    # Only chunks that are asked for bring their extents to the join.
    wanted = asked.select(*by, F.col("_chunk").alias("_c")).distinct()
    mapped = chunked(extents, "physical", "count").withColumnRenamed("_chunk", "_c").join(wanted, [*by, "_c"], "left_semi")
    mapped = mapped.withColumnsRenamed({k: f"_by_{k}" for k in by})
    met = (asked["_chunk"] == mapped["_c"]) & hit
    for k in by:
        met &= asked[k] == mapped[f"_by_{k}"]
    found = asked.join(mapped, met, "left")
    inside = ((F.col("logical") + F.col("block") - F.col("physical")) * block_size
              + F.pmod(F.col("offset"), F.lit(block_size)))
    return found.select(*offsets.columns, "block", "path", "rank", inside.alias("file_offset"))


def offset_owner(offsets: DataFrame, extents: DataFrame, block_size: int, by: list[str] = ()) -> DataFrame:
    """One row per offset: first owner, offset inside it, and how many owners compete."""
    found = owners_of_offsets(offsets, extents, block_size, by)
    first = F.min(F.when(F.col("path").isNotNull(), F.struct("rank", "path", "file_offset")))
    return (found.groupBy(*offsets.columns, "block").agg(first.alias("f"), F.count("path").alias("owners"))
            .select(*offsets.columns, "block", F.col("f.path").alias("path"),
                    F.col("f.file_offset").alias("file_offset"), "owners"))


def image_offsets(asked: DataFrame, extents: DataFrame, block_size: int, by: list[str] = ()) -> DataFrame:
    """File offsets to image offsets; an offset in a hole stays with null. ``by`` as in ``owners_of_offsets``."""
    a = (asked.withColumn("_block", _floor_div(F.col("file_offset"), block_size))
         .withColumn("_chunk", _floor_div(F.col("_block"), CHUNK)).alias("a"))
    e = chunked(extents.select(*by, "inode", "logical", "physical", "count"), "logical", "count").alias("e")
    hit = ((F.col("a.inode") == F.col("e.inode")) & (F.col("a._chunk") == F.col("e._chunk"))
           & (F.col("_block") >= F.col("logical")) & (F.col("_block") < F.col("logical") + F.col("count")))
    for k in by:
        hit &= F.col(f"a.{k}") == F.col(f"e.{k}")
    image = ((F.col("physical") + F.col("_block") - F.col("logical")) * block_size
             + F.pmod(F.col("file_offset"), F.lit(block_size)))
    return a.join(e, hit, "left").select(*[F.col(f"a.{c}") for c in asked.columns], image.alias("image_offset"))


def extent_listing(extents: DataFrame, block_size: int) -> DataFrame:
    return extents.select(
        "inode", "logical", "physical", "count", (F.col("physical") * block_size).alias("image_start"),
        ((F.col("physical") + F.col("count")) * block_size).alias("image_end"))


def runs_of(ids: DataFrame, by: list[str], column: str, width: int = WIDTH) -> DataFrame:
    """Maximal runs of consecutive whole numbers as ``(first, count)``.

    Islands are formed inside chunks of ``width`` numbers; islands that touch a
    chunk edge are then stitched over one small row per island.
    """
    d = ids.select(*by, F.col(column).alias("id")).distinct().withColumn("_chunk", _floor_div(F.col("id"), width))
    place = F.row_number().over(W.partitionBy(*by, "_chunk").orderBy("id"))
    islands = (d.withColumn("_g", F.col("id") - place).groupBy(*by, "_chunk", "_g")
               .agg(F.min("id").alias("lo"), F.max("id").alias("hi")))
    touches = (F.pmod("lo", F.lit(width)) == 0) | (F.pmod("hi", F.lit(width)) == width - 1)
    inner = islands.filter(~touches).select(*by, F.col("lo").alias("first"), (F.col("hi") - F.col("lo") + 1).alias("count"))
    order = W.partitionBy(*by).orderBy("lo")
    edge = islands.filter(touches).withColumn("_new", (F.col("lo") - F.lag("hi").over(order) > 1).cast("int"))
    stitched = (edge.withColumn("_run", F.sum(F.coalesce("_new", F.lit(1))).over(order)).groupBy(*by, "_run")
                .agg(F.min("lo").alias("first"), (F.max("hi") - F.min("lo") + 1).alias("count")).drop("_run"))
    return inner.unionByName(stitched)


def run_shape(runs: DataFrame, by: list[str], block_size: int) -> DataFrame:
    """Runs, longest (first block on a tie) and size buckets per key."""
    n = F.col("count")
    longest = F.max(F.struct("count", (-F.col("first")).alias("f")))
    sizes = {"size_1": n == 1, "size_2_8": n.between(2, 8), "size_9_128": n.between(9, 128),
             "size_129_1024": n.between(129, 1024), "size_over_1024": n > 1024}
    agg = runs.groupBy(*by).agg(F.count("*").alias("runs"), longest.alias("l"), F.sum("count").alias("blocks"),
                                *[F.count_if(test).alias(name) for name, test in sizes.items()])
    return agg.select(*by, "runs", "blocks", F.col("l.count").alias("longest"),
                      (F.col("l.count") * block_size).alias("longest_bytes"),
                      (-F.col("l.f")).alias("longest_first"), *sizes)


def extent_holes(extents: DataFrame, by: str, width: int = 4096) -> DataFrame:
    """First logical block past everything mapped before it, per file that has a hole.

    The reach before an extent is the larger of the reach inside its chunk and the
    reach of all earlier chunks, so a file with very many extents is still split.
    """
    e = extents.withColumn("_end", F.col("logical") + F.col("count")).withColumn("_chunk", _floor_div(F.col("logical"), width))
    own = W.partitionBy(by, "_chunk").orderBy("logical", "_end").rowsBetween(W.unboundedPreceding, -1)
    chunks = e.groupBy(by, "_chunk").agg(F.max("_end").alias("_top"))
    earlier = W.partitionBy(by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = chunks.select(by, "_chunk", F.max("_top").over(earlier).alias("_carry"))
    reach = F.greatest(F.coalesce(F.max("_end").over(own), F.lit(0)), F.coalesce("_carry", F.lit(0)))
    return (e.join(carried, [by, "_chunk"]).withColumn("_reach", reach)
            .filter(F.col("logical") > F.col("_reach")).groupBy(by)
            .agg(F.min(F.struct("logical", "_reach")).alias("h"))
            .select(by, F.col("h._reach").alias("hole_at"), F.col("h.logical").alias("next_logical")))


def hole_bytes(files: DataFrame, extents: DataFrame, by: str, block_size: int) -> DataFrame:
    """Bytes inside the size that no extent maps."""
    sized = extents.join(files.select(by, "size"), by)
    covered = F.greatest(F.lit(0), F.least((F.col("logical") + F.col("count")) * block_size, F.col("size"))
                         - F.col("logical") * block_size)
    total = sized.groupBy(by).agg(F.sum(covered).alias("covered"))
    return (files.select(by, "size").join(total, by, "left")
            .select(by, F.greatest(F.lit(0), F.col("size") - F.coalesce("covered", F.lit(0))).alias("hole_bytes")))


def positions(ids: DataFrame, by: list[str], column: str, width: int = WIDTH) -> DataFrame:
    """Zero-based position of every distinct whole number in order, without one big window.

    Chunk counts give each chunk's start; inside a chunk at most ``width`` numbers are ranked.
    """
    d = ids.select(*by, column).distinct().withColumn("_chunk", _floor_div(F.col(column), width))
    counts = d.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*by, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy(*by, "_chunk").orderBy(column)) - 1
    return (d.withColumn("_place", place).join(starts, [*by, "_chunk"])
            .select(*by, column, (F.col("_start") + F.col("_place")).alias("position")))


def systematic_sample(ids: DataFrame, by: list[str], column: str, cap: int) -> DataFrame:
    """Element ``int(i * total / cap)`` for i below cap; everything when cap covers the total."""
    placed = positions(ids, by, column)
    totals = ids.select(*by, column).distinct().groupBy(*by).agg(F.count("*").alias("_total"))
    joined = placed.join(totals, by)
    # Position p is picked when some i has floor(i * total / cap) = p.
    i = F.ceil(F.col("position") * cap / F.col("_total"))
    picked = (i < cap) & (F.floor(i * F.col("_total") / cap) == F.col("position"))
    return joined.filter((F.col("_total") <= cap) | picked).drop("_total")


def stride_sample(ids: DataFrame, by: list[str], column: str, limit: int) -> DataFrame:
    """Every ``max(1, total // limit)``-th element of the sorted list, at most ``limit`` of them."""
    placed = positions(ids, by, column)
    totals = ids.select(*by, column).distinct().groupBy(*by).agg(F.count("*").alias("_total"))
    stride = F.greatest(F.lit(1), F.floor(F.col("_total") / limit))
    return (placed.join(totals, by).filter((F.col("position") % stride == 0) & (F.col("position") / stride < limit))
            .drop("_total"))


def overlap_blocks(left: DataFrame, right: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """Blocks of each left interval that lie in the disjoint right intervals of the same ``by``.

    ``right`` intervals must not overlap one another (free runs never do). Only intervals that
    do overlap leave the join.
    """
    a, b = chunked(left, "first", "count").alias("a"), chunked(right, "first", "count").alias("b")
    low = F.greatest(F.col("a.first"), F.col("b.first"), F.col("a._chunk") * CHUNK)
    high = F.least(F.col("a.first") + F.col("a.count"), F.col("b.first") + F.col("b.count"), (F.col("a._chunk") + 1) * CHUNK)
    met = ((F.col("a._chunk") == F.col("b._chunk")) & (F.col("a.first") < F.col("b.first") + F.col("b.count"))
           & (F.col("b.first") < F.col("a.first") + F.col("a.count")))
    for k in by:
        met &= F.col(f"a.{k}") == F.col(f"b.{k}")
    joined = a.join(b, met)
    return joined.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.sum(F.greatest(high - low, F.lit(0))).alias("blocks"))


def recoverability(items: DataFrame, extents: DataFrame, free_runs: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """Whether a deleted item's former blocks are still unclaimed, per item (and device, if ``by`` names it)."""
    keys = [*by, key]
    e = extents.select(*keys, F.col("physical").alias("first"), "count")
    owned = e.groupBy(*keys).agg(F.sum("count").alias("blocks"))
    free = overlap_blocks(e, free_runs, keys, by).withColumnRenamed("blocks", "free")
    joined = items.select(*keys).join(owned, keys, "left").join(free, keys, "left").select(
        *keys, F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("free", F.lit(0)).alias("free"))
    verdict = (F.when(F.col("blocks") == 0, "no blocks").when(F.col("free") == F.col("blocks"), "all free")
               .when(F.col("free") == 0, "all reused").otherwise("mixed"))
    return joined.withColumn("verdict", verdict)


def metadata_overlap(free: DataFrame, metadata: DataFrame, by: list[str] = (), width: int = WIDTH) -> DataFrame:
    """Unallocated blocks that are also metadata, split into extent ends and interior (one row per ``by``).

    ``free`` holds blocks (``block``) or intervals (``first``, ``count``), ``metadata`` intervals; both
    may overlap themselves. A sweep: where an interval begins one more is open, past its end one less.
    Sums over the places inside a chunk start from the sums of all chunks before it, and between two
    neighbouring places nothing changes. So the work depends on the number of intervals, not on how
    many blocks they hold. Where ``by`` has metadata or free blocks but no overlap the row says 0.
    """
    if "block" in free.columns:
        free = free.select(*by, F.col("block").alias("first"), F.lit(1).cast("long").alias("count"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def points(side: DataFrame, f, m) -> DataFrame:
        i = side.filter(F.col("count") > 0)
        end = F.col("first") + F.col("count")
        return (i.select(*by, F.col("first").alias("pos"), f.alias("f"), m.alias("m"), F.lit(0).alias("last"))
                .unionByName(i.select(*by, end.alias("pos"), (-f).alias("f"), (-m).alias("m"), F.lit(0).alias("last"))))

    lasts = metadata.filter(F.col("count") > 0).select(*by, (F.col("first") + F.col("count") - 1).alias("pos"), none.alias("f"), none.alias("m"), F.lit(1).alias("last"))
    places = (points(free, one, none).unionByName(points(metadata, none, one)).unionByName(lasts)
              .groupBy(*by, "pos").agg(F.sum("f").alias("f"), F.sum("m").alias("m"), F.max("last").alias("last"))
              .withColumn("_chunk", _floor_div(F.col("pos"), width)))
    chunks = places.groupBy(*by, "_chunk").agg(F.sum("f").alias("f"), F.sum("m").alias("m"), F.min("pos").alias("lo"))
    order = W.partitionBy(*by).orderBy("_chunk")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    carried = chunks.select(*by, "_chunk", F.coalesce(F.sum("f").over(before), none).alias("_f"), F.coalesce(F.sum("m").over(before), none).alias("_m"), F.lead("lo").over(order).alias("_next"))
    own = W.partitionBy(*by, "_chunk").orderBy("pos")
    here = own.rowsBetween(W.unboundedPreceding, 0)
    is_free, is_meta = F.col("_f") + F.sum("f").over(here) > 0, F.col("_m") + F.sum("m").over(here) > 0
    stretch = F.coalesce(F.lead("pos").over(own), F.col("_next")) - F.col("pos")
    swept = places.join(carried, [*by, "_chunk"]).select(*by, "last", is_free.alias("free"), is_meta.alias("meta"), stretch.alias("n"))
    return swept.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("free") & F.col("meta"), F.col("n"))), none).alias("overlap"),
        F.count_if(F.col("free") & (F.col("last") == 1)).alias("at_extent_end")).withColumn("interior", F.col("overlap") - F.col("at_extent_end"))
