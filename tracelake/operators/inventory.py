"""Questions asked of a file inventory: one pass gives the shape, filters give the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.paths import base_name, package_of, second, top
from tracelake.functions.rules import category
from tracelake.functions.times import local_text, time_class, utc_text

ENCRYPTED = ("/data/", "/data/user/0/")
NOT_EMPTY = 4096


def classify(files: DataFrame, since: int) -> DataFrame:
    return files.withColumn("class", time_class(F.col("mtime"), since))


def file_scan(files: DataFrame, since: int, by: list[str] = ()) -> DataFrame:
    """Class counts, coherent range and recent totals in a single aggregation."""
    c = F.col("class")
    coherent = F.when(c == "coherent", F.col("mtime"))
    return (classify(files, since).groupBy(*by).agg(
        F.count("*").alias("files"),
        *[F.count_if(c == name).alias(name) for name in ("epoch", "installer", "coherent", "recent")],
        F.coalesce(F.sum(F.when(c == "recent", F.col("size"))), F.lit(0)).alias("recent_bytes"),
        F.min(F.when(coherent > 0, coherent)).alias("_lo"), F.max(coherent).alias("_hi"))
        .withColumn("coherent_first", utc_text(F.col("_lo")))
        .withColumn("coherent_last", utc_text(F.col("_hi"))).drop("_lo", "_hi"))


def recent_files(files: DataFrame, since: int) -> DataFrame:
    return files.filter(F.col("mtime") >= since).select(
        *files.columns, utc_text(F.col("mtime")).alias("mtime_utc"),
        local_text(F.col("mtime")).alias("mtime_local"), package_of(F.col("path")).alias("package"))


def _top_keys(counted: DataFrame, k: int) -> DataFrame:
    """Top k keys per facet; the plain rank filter lets Spark cut each task to k before the shuffle."""
    order = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), F.asc("key")))
    return counted.withColumn("rank", order).filter(F.col("rank") <= k).drop("rank")


def class_breakdown(files: DataFrame, since: int, k: int = 8, samples: int = 12) -> DataFrame:
    """Years, installer values, locations and samples as ``(facet, key, n)`` rows.

    Counts come from one aggregation; samples are limited in every map task
    before they are shuffled.
    """
    c, mtime, path = F.col("class"), F.col("mtime"), F.col("path")
    facet = lambda name, key, on: F.when(on, F.struct(F.lit(name).alias("facet"), key.alias("key")))
    facets = F.array_compact(F.array(
        facet("coherent_year", F.date_format(F.timestamp_seconds(mtime), "yyyy"), c == "coherent"),
        facet("installer_value", utc_text(mtime), c == "installer"),
        facet("epoch_location", top(path), c == "epoch"),
        facet("installer_location", second(path), c == "installer")))
    counted = (classify(files, since).select(F.explode(facets).alias("f")).select("f.*")
               .groupBy("facet", "key").agg(F.count("*").alias("n")))
    years = F.col("facet") == "coherent_year"
    ranked = counted.filter(years).unionByName(_top_keys(counted.filter(~years), k))
    first = F.row_number().over(W.partitionBy("class").orderBy("path"))
    sampled = (classify(files, since).filter(c.isin("epoch", "installer")).select("class", "path")
               .withColumn("r", first).filter(F.col("r") <= samples)
               .select(F.concat("class", F.lit("_sample")).alias("facet"), F.col("path").alias("key"),
                       F.col("r").cast("long").alias("n")))
    return ranked.unionByName(sampled)


def in_encrypted_area(files: DataFrame, minimum: int = NOT_EMPTY) -> DataFrame:
    inside = F.col("path").startswith(ENCRYPTED[0])
    for prefix in ENCRYPTED[1:]:
        inside = inside | F.col("path").startswith(prefix)
    return files.filter((F.col("size") >= minimum) & inside)


def encrypted_writes(files: DataFrame, since: int) -> DataFrame:
    """Per package: files and bytes written to the encrypted area since the cut-off."""
    return (in_encrypted_area(files.filter(F.col("mtime") >= since))
            .groupBy(package_of(F.col("path")).alias("package"))
            .agg(F.count("*").alias("files"), F.sum("size").alias("bytes")))


def largest(files: DataFrame, k: int) -> DataFrame:
    return files.orderBy(F.desc("size"), F.asc("path")).limit(k)


def system_files(files: DataFrame, since: int) -> DataFrame:
    """Recent files outside the application area, with their category."""
    outside = files.filter((F.col("mtime") >= since) & ~F.col("path").startswith(ENCRYPTED[0]))
    return outside.select(*files.columns, base_name(F.col("path")).alias("name"),
                          category(F.col("path")).alias("category"), utc_text(F.col("mtime")).alias("utc"))


def app_inventory(files: DataFrame, app: str) -> DataFrame:
    """Per application: files, bytes and files under ``databases/``."""
    return files.groupBy(app).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"),
        F.count_if(F.col("path").contains("/databases/")).alias("databases"))


def top_per(files: DataFrame, by: str, k: int) -> DataFrame:
    order = F.row_number().over(W.partitionBy(by).orderBy(F.desc("size"), F.asc("path")))
    return files.withColumn("rank", order).filter(F.col("rank") <= k)


def deleted_summary(entries: DataFrame, owners: int = 10) -> DataFrame:
    """Kinds, deletion years, top owners and declared bytes as ``(facet, key, n)`` rows."""
    facets = F.array(
        F.struct(F.lit("kind").alias("facet"), F.col("kind").alias("key"), F.lit(1).alias("w")),
        F.struct(F.lit("year").alias("facet"), F.date_format(F.timestamp_seconds("dtime"), "yyyy").alias("key"),
                 F.lit(1).alias("w")),
        F.struct(F.lit("owner").alias("facet"), F.col("uid").cast("string").alias("key"), F.lit(1).alias("w")),
        F.struct(F.lit("total").alias("facet"), F.lit("bytes").alias("key"), F.col("size").alias("w")),
        F.struct(F.lit("total").alias("facet"), F.lit("entries").alias("key"), F.lit(1).alias("w")))
    counted = (entries.select(F.explode(facets).alias("f")).select("f.*")
               .groupBy("facet", "key").agg(F.sum("w").cast("long").alias("n")))
    by_owner = F.col("facet") == "owner"
    return counted.filter(~by_owner).unionByName(_top_keys(counted.filter(by_owner), owners))


def attribute_census(df: DataFrame, attributes: str) -> DataFrame:
    """Attribute names with their counts and how many distinct values each carries."""
    pairs = df.select(F.explode(attributes).alias("name", "value"))
    values = pairs.groupBy("name", "value").agg(F.count("*").alias("n"))
    return values.groupBy("name").agg(F.sum("n").alias("rows"), F.count("value").alias("distinct_values"))


def major_types(df: DataFrame, mime: str) -> DataFrame:
    major = F.substring_index(F.coalesce(F.col(mime), F.lit("")), "/", 1)
    return (df.groupBy(F.when(major == "", "?").otherwise(major).alias("major"))
            .agg(F.count("*").alias("n")))


def counters(free: DataFrame, declared: DataFrame, grouped: DataFrame) -> DataFrame:
    """Three one-row counters side by side; the counted one is the authority."""
    joined = free.withColumns({"from_superblock": declared.scalar(), "from_groups": grouped.scalar()})
    return joined.select(
        "*", (F.col("from_bitmaps") - F.col("from_superblock")).alias("bitmaps_minus_superblock"),
        (F.col("from_bitmaps") - F.col("from_groups")).alias("bitmaps_minus_groups"),
        F.lit("from_bitmaps").alias("authoritative"))


def zero_share(blocks: DataFrame, total: DataFrame) -> DataFrame:
    """Zero and non-zero blocks among those looked at, scaled to the total (one row)."""
    seen = blocks.agg(F.count_if("zero").alias("zero_blocks"), F.count_if(~F.col("zero")).alias("nonzero_blocks"))
    looked = F.col("zero_blocks") + F.col("nonzero_blocks")
    return seen.withColumn("total", total.scalar()).select(
        "zero_blocks", "nonzero_blocks", "total",
        F.when(looked > 0, F.round(F.col("zero_blocks") / looked, 6)).otherwise(0.0).alias("zero_share"),
        F.when(looked > 0, F.rint(F.col("nonzero_blocks") * F.col("total") / looked)).otherwise(0)
        .cast("long").alias("nonzero_estimate"))


CLASSES = ("epoch", "installer", "coherent", "recent")


def write_recent(files: DataFrame, since: int, path: str, unreadable: Column | None = None) -> DataFrame:
    """Write the recent files to ``path`` as Parquet and return the counts of the whole scan, from the same pass.

    One row: files, one count per class, bytes of the recent ones, files without a readable time
    (skipped) and those that ``unreadable`` marks. The counts are observed while the rows are written,
    so neither costs a scan of its own; they are those of ``file_scan`` over the same rows.
    """
    seen = Observation("scan")
    c = time_class(F.col("mtime"), since)
    bad = F.lit(False) if unreadable is None else F.coalesce(unreadable, F.lit(False))
    watched = files.observe(
        seen, F.count(F.lit(1)).alias("files"), *[F.count_if(c == name).alias(name) for name in CLASSES],
        F.coalesce(F.sum(F.when(c == "recent", F.col("size"))), F.lit(0)).alias("recent_bytes"),
        F.count_if(F.col("mtime").isNull()).alias("skipped"), F.count_if(bad).alias("unreadable"))
    recent_files(watched, since).write.mode("overwrite").parquet(path)
    counts = seen.get
    names = ["files", *CLASSES, "recent_bytes", "skipped", "unreadable"]
    return files.sparkSession.createDataFrame([tuple(int(counts[n]) for n in names)], ", ".join(f"{n} bigint" for n in names))
