"""Verdicts over dated signals, one aggregation per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def network_verdict(df: DataFrame, by: str, floor: int, signals: dict[str, Column]) -> DataFrame:
    """Age in days of the newest stamp per signal, and whether any is past the floor.

    Traffic counters are no signal: counting proves accounting, not a session.
    """
    newest = df.groupBy(by).agg(*[F.max(F.when(test, F.col("unix"))).alias(name)
                                  for name, test in signals.items()])
    online = F.lit(False)
    for name in signals:
        online = online | F.coalesce(F.col(name) > floor, F.lit(False))
    ages = [F.round((floor - F.col(name)) / 86400, 1).alias(f"{name}_days") for name in signals]
    return newest.select(by, *ages, online.alias("online"))


def stability_verdict(df: DataFrame, by: str, reboot: Column, crash: Column, since: int) -> DataFrame:
    """More than one reboot, or any crash since the session began, is unstable."""
    agg = df.groupBy(by).agg(
        F.count_if(reboot).alias("reboots"),
        F.count_if(crash & (F.col("unix") >= since)).alias("crashes_in_session"))
    unstable = (F.col("reboots") > 1) | (F.col("crashes_in_session") > 0)
    return agg.withColumn("verdict", F.when(unstable, "unstable_session").otherwise("stable_session"))
