"""Tables of many devices, laid out so that work per device needs no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_buckets(df: DataFrame, name: str, by: list[str], buckets: int = 512, order: list[str] = ()) -> DataFrame:
    """Write ``df`` as the table ``name``, bucketed by ``by``, and read it back.

    Joins and groups on exactly these columns then read the buckets as they lie, on that side
    without an exchange; two tables meet without any if they have the same columns and number of
    buckets. Bucket by the device where answers are per device, and by device and id where a device
    may hold a large share of all rows, so that it spreads over all buckets. One task writes one
    bucket; ``order`` sorts the rows inside.
    """
    rows = df.repartition(buckets, *by).write.mode("overwrite").format("parquet").bucketBy(buckets, *by)
    (rows.sortBy(*order) if order else rows).saveAsTable(name)
    return df.sparkSession.table(name)


def drop_buckets(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
