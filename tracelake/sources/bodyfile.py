"""Body files: eleven ``|`` fields, the name second and free to contain ``|``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = 11
NUMBER_FIELDS = ("uid", "gid", "size", "atime", "mtime", "ctime", "crtime")


def _numbers(parts: Column) -> list[Column]:
    """The last seven fields, counted from the end of the line."""
    return [F.get(parts, F.size(parts) - len(NUMBER_FIELDS) + i) for i in range(len(NUMBER_FIELDS))]


def _well_formed(parts: Column) -> Column:
    tail = F.array_join(F.slice(parts, F.size(parts) - 6, F.lit(7)), "|")
    return (F.size(parts) >= FIELDS) & tail.rlike(r"^(\d+\|){3}(-?\d+\|){3}-?\d+$")


def _split(lines: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """Lines that are no comments, with their fields.

    A list of one is unfolded, so that the line and its fields are made once and not again in every
    expression that follows (the optimizer does not copy expressions through a generator).
    """
    once = F.explode(F.array(F.struct(F.col(value).alias("line"), F.split(value, r"\|").alias("p"))))
    return (lines.select(*keep, once.alias("_l")).select(*keep, F.col("_l.line").alias(value), F.col("_l.p").alias("_p"))
            .filter(~F.col(value).startswith("#")))


def parse_body(lines: DataFrame, value: str = "value", keep: list[str] = ()) -> DataFrame:
    """Parsed records: one field before the name, nine after it, the name is what lies between."""
    p = F.col("_p")
    good = _split(lines, value, keep).filter(_well_formed(p))
    name = F.array_join(F.slice(p, F.lit(2), F.size(p) - (FIELDS - 1)), "|")
    numbers = [n.try_cast("long").alias(label) for n, label in zip(_numbers(p), NUMBER_FIELDS)]
    return good.select(*keep, F.get(p, 0).alias("md5"), name.alias("name"), F.get(p, F.size(p) - 9).alias("inode"),
                       F.get(p, F.size(p) - 8).alias("mode"), *numbers)


def quarantined(lines: DataFrame, value: str = "value") -> DataFrame:
    return _split(lines, value, []).filter(~_well_formed(F.col("_p"))).select(value)


def body_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Live, unlinked, malformed and virtual lines (one row)."""
    line = F.col(value)
    malformed = F.size(F.split(line, r"\|", 12)) < 11
    virtual = line.startswith("V|") | line.contains("$OrphanFiles")
    kind = (F.when(malformed, "malformed").when(virtual, "virtual")
            .when(line.contains(" (deleted"), "unlinked").otherwise("live"))
    kinds = lines.filter(~line.startswith("#")).select(kind.alias("k"))
    return kinds.agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("live", "unlinked", "malformed", "virtual")])


def read_body(spark: SparkSession, path: str) -> DataFrame:
    return parse_body(spark.read.text(path))
