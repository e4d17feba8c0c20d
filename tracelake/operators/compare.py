"""Two independent readings of the same thing, compared without guessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.ranges import positions


def _paired(ours: DataFrame, theirs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    a = ours.select(*keys, F.struct(*fields).alias("a"))
    b = theirs.select(*keys, F.struct(*fields).alias("b"))
    return a.join(b, keys, "full_outer")


def _relation(field: str, unavailable: list[str]) -> Column:
    """agree, differ, only_ours, only_theirs, or unavailable when a reader has no value for it."""
    mine, other = F.col(f"a.{field}"), F.col(f"b.{field}")
    chain = F.when(F.col("b").isNull(), "only_ours").when(F.col("a").isNull(), "only_theirs")
    if field in unavailable:
        chain = chain.when(mine.isNull() | other.isNull(), "unavailable")
    return chain.when(mine.eqNullSafe(other), "agree").otherwise("differ")


def compare_summary(ours: DataFrame, theirs: DataFrame, keys: list[str], fields: list[str],
                    unavailable: list[str] = ()) -> DataFrame:
    """Per field: how many keys agree, differ, or are on one side only."""
    relations = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _relation(f, unavailable).alias("relation"))
                                    for f in fields])).alias("r")
    return (_paired(ours, theirs, keys, fields).select(relations).select("r.*")
            .groupBy("field", "relation").agg(F.count("*").alias("n")))


def compare_differences(ours: DataFrame, theirs: DataFrame, keys: list[str], fields: list[str],
                        unavailable: list[str] = ()) -> DataFrame:
    """The differing fields as ``(key, field, ours, theirs)`` rows."""
    cells = F.explode(F.array(*[F.struct(
        F.lit(f).alias("field"), _relation(f, unavailable).alias("relation"),
        F.col(f"a.{f}").cast("string").alias("ours"), F.col(f"b.{f}").cast("string").alias("theirs")) for f in fields])).alias("r")
    return _paired(ours, theirs, keys, fields).select(*keys, cells).filter("r.relation = 'differ'").select(
        *keys, "r.field", "r.ours", "r.theirs")


def row_relation(ours: Column, theirs: Column) -> Column:
    """Decoded rows as arrays: agree, schema_evolved (a shorter prefix), or the first differing column."""
    shared = F.least(F.size(ours), F.size(theirs))
    same = F.zip_with(F.slice(ours, 1, shared), F.slice(theirs, 1, shared), lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False)
    status = (F.when((F.size(ours) != F.size(theirs)) & (first > 0), "mismatch")
              .when(F.size(ours) != F.size(theirs), "schema_evolved")
              .when(first > 0, "mismatch").otherwise("agree"))
    column = F.when((first > 0) & (F.size(ours) == F.size(theirs)), first - 1)
    return F.struct(status.alias("status"), column.alias("column"))


def coverage_gap(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys only one list has, with the side that has them."""
    a, b = ours.select(*keys).distinct(), theirs.select(*keys).distinct()
    return (b.join(a, keys, "left_anti").withColumn("side", F.lit("theirs"))
            .unionByName(a.join(b, keys, "left_anti").withColumn("side", F.lit("ours"))))


def first_divergence(ours: DataFrame, theirs: DataFrame, by: str, key: str) -> DataFrame:
    """First position at which two ordered key lists disagree, per table."""
    a = positions(ours, [by], key).withColumnRenamed(key, "our_key")
    b = positions(theirs, [by], key).withColumnRenamed(key, "their_key")
    both = a.join(b, [by, "position"])
    return (both.filter(F.col("our_key") != F.col("their_key")).groupBy(by)
            .agg(F.min(F.struct("position", "our_key", "their_key")).alias("m")).select(by, "m.*"))


def content_identity(ours: DataFrame, theirs: DataFrame, key: str, content: str) -> DataFrame:
    """Identical, differing and unread objects by SHA-256, with the bytes compared (one row)."""
    digest = lambda df, name: df.select(key, F.sha2(content, 256).alias(name),
                                        F.octet_length(content).cast("long").alias(f"{name}_bytes"))
    both = digest(ours, "a").join(digest(theirs, "b"), key, "left")
    read = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(
        F.count("*").alias("objects"), F.count_if(read & (F.col("a") == F.col("b"))).alias("identical"),
        F.count_if(read & (F.col("a") != F.col("b"))).alias("differing"), F.count_if(~read).alias("unread"),
        F.coalesce(F.sum(F.when(read, F.col("a_bytes"))), F.lit(0)).alias("bytes_compared"))


def content_copies(df: DataFrame, content: str) -> DataFrame:
    """Contents held by more than one object: digest, copies, first object."""
    return (df.groupBy(F.sha2(content, 256).alias("sha256")).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1"))


def status_of_reads(wanted: DataFrame, log: DataFrame, artifact: str = "artifact") -> DataFrame:
    """PRESENT, ABSENT or UNREADABLE per artifact; a failed read outranks an absent one."""
    worst = log.groupBy(artifact).agg(F.max(F.when(F.col("status") == "UNREADABLE", 2).otherwise(1)).alias("_w"))
    return wanted.join(worst, artifact, "left").select(
        *wanted.columns, F.when(F.col("_w") == 2, "UNREADABLE").when(F.col("_w") == 1, "ABSENT").otherwise("PRESENT").alias("status"))
