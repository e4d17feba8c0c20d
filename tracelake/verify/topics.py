"""Topics of the report: one row (topic, answer, evidence, source) each, from one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.times import utc_text
from tracelake.operators import timeline as TL
from tracelake.operators.inventory import in_encrypted_area
from tracelake.operators.verdicts import stability_verdict
from tracelake.verify.report import verdict_row


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def unlock(files: DataFrame, since: int) -> DataFrame:
    """Files written to the encrypted area since the cut-off prove that it was open."""
    e = in_encrypted_area(files.filter(F.col("mtime") >= since)).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"))
    return verdict_row(e, "unlock", F.when(F.col("n") > 0, "unlocked").otherwise("cannot be confirmed"),
                       _said(F.col("n"), " files, ", F.col("b"), " bytes since ", utc_text(F.lit(since))), "inventory")


def network(events: DataFrame, floor: int, signals: dict[str, Column]) -> DataFrame:
    """Signals newer than the floor; without any there is no sign of a connection."""
    newest = events.agg(*[F.max(F.when(test, F.col("unix"))).alias(name) for name, test in signals.items()])
    late = F.array_join(F.array_compact(F.array(*[F.when(F.col(name) > floor, name) for name in signals])), ", ")
    return verdict_row(newest, "network", F.when(late == "", "no sign of a connection").otherwise("connected"), late, "timeline")


def accounts(services: DataFrame) -> DataFrame:
    """Services with an authentication, of all services seen."""
    n = services.agg(F.count("*").alias("all"), F.count_if(F.col("auth_events") > 0).alias("auth"), F.max("last_auth_utc").alias("last"))
    return verdict_row(n, "accounts", _said(F.col("auth"), " of ", F.col("all")), _said("last authentication ", F.coalesce("last", F.lit("—"))), "timeline")


def session(events: DataFrame) -> DataFrame:
    w = TL.window_summary(events)
    return verdict_row(w, "session", F.col("events").cast("string"), F.concat_ws(" / ", "first_utc", "last_utc"), "timeline")


def last_login(events: DataFrame, tie: str) -> DataFrame:
    """No row if nobody logged in."""
    return verdict_row(TL.latest_event(events, tie, kind="login"), "last login", utc_text(F.col("unix")), F.col("package"), "timeline")


def clock(summary: DataFrame) -> DataFrame:
    """From one row of ``clock_summary``."""
    return verdict_row(summary, "clock", _said(F.round(F.col("agreement") * 1000).cast("long"), " per mille agree"),
                       _said(F.col("matched_either"), " of ", F.col("compared"), ", at most ", F.col("max_delta_seconds"), " s apart"), "packages")


def applications(states: DataFrame) -> DataFrame:
    """From the rows of ``install_state``."""
    names = ("data_dir_present", "gone_but_listed", "no_data_dir")
    n = states.agg(F.count("*").alias("n"), *[F.count_if(F.col("state") == s).alias(s) for s in names])
    parts = [p for s in names for p in (f"{s} ", F.col(s), ", ")][:-1]
    return verdict_row(n, "applications", F.col("n").cast("string"), _said(*parts), "packages")


def system_session(events: DataFrame, reboot: Column, crash: Column, since: int) -> DataFrame:
    v = stability_verdict(events.withColumn("_whole", F.lit(1)), "_whole", reboot, crash, since)
    return verdict_row(v, "system session", F.col("verdict"), _said(F.col("reboots"), " reboots, ", F.col("crashes_in_session"), " crashes since ", utc_text(F.lit(since))), "timeline")


def acquisition(status: DataFrame) -> DataFrame:
    """Whether every source was read; from rows with a status."""
    n = status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("PRESENT", "ABSENT", "UNREADABLE")])
    whole = F.when(F.col("UNREADABLE") > 0, "incomplete").when(F.col("ABSENT") > 0, "sources absent").otherwise("complete")
    return verdict_row(n, "acquisition", whole, _said(F.col("PRESENT"), " read, ", F.col("ABSENT"), " absent, ", F.col("UNREADABLE"), " unreadable"), "reads")


def files(inventory: DataFrame) -> DataFrame:
    n = inventory.agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    return verdict_row(n, "files", F.col("n").cast("string"), F.col("b").cast("string"), "inventory")


def source_times(expected: DataFrame, written: DataFrame) -> DataFrame:
    """When each expected source was last written, a dash where it is missing; ``written`` has source and unix."""
    newest = written.groupBy("source").agg(F.max("unix").alias("unix"), F.count("*").alias("rows"))
    return expected.join(newest, "source", "left").select(
        "source", F.coalesce(F.when(F.col("unix").isNotNull(), utc_text(F.col("unix"))), F.lit("—")).alias("written_utc"), F.coalesce("rows", F.lit(0)).alias("rows"))
