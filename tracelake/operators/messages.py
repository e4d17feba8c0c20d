"""Message stores: statistics, type profiles, sender and thread names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.rules import KIND_FAMILIES, code_label
from tracelake.functions.times import PLAUSIBLE_FROM_MS, utc_ms_text


def store_statistics(messages: DataFrame, by: list[str]) -> DataFrame:
    """Totals, positive time range, zero and implausible stamps, text, attachments, outgoing."""
    ms = F.col("ms")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    sane = F.when(ms >= PLAUSIBLE_FROM_MS, ms)
    return messages.groupBy(*by).agg(
        F.count("*").alias("messages"),
        utc_ms_text(F.min(F.when(ms > 0, ms))).alias("first_utc"), utc_ms_text(F.max(F.when(ms > 0, ms))).alias("last_utc"),
        F.count_if(ms == 0).alias("zero_stamps"), F.count_if(filled("body")).alias("with_text"),
        F.count_if(filled("attachments")).alias("with_attachments"), F.count_if("outgoing").alias("outgoing"),
        F.count_if((ms > 0) & (ms < PLAUSIBLE_FROM_MS)).alias("implausible"),
        utc_ms_text(F.min(sane)).alias("plausible_first_utc"), utc_ms_text(F.max(sane)).alias("plausible_last_utc"))


def _allowed(kind: Column, family: Column) -> Column:
    """Family membership; null for a kind that declares no families."""
    out = None
    for name, families in KIND_FAMILIES.items():
        test = family.isin(families) if families else F.lit(False)
        out = F.when(kind == name, test) if out is None else out.when(kind == name, test)
    return out


def type_profile(messages: DataFrame, media: DataFrame, table: Mapping[int, str], by: list[str] = ()) -> DataFrame:
    """Per type code: kind, count, observed media families and whether they dispute the kind.

    Message ids count inside one store only: columns ``by`` (a device, say) are in both tables.

    Media join on the unique message id and collapse to distinct (code, family)
    pairs first; a code without media, or whose kind lists no families, is never disputed.
    """
    kind = code_label(F.col("code").cast("string"), table)
    counted = messages.groupBy(*by, "code").agg(F.count("*").alias("messages"))
    family = F.lower(F.substring_index("mime", "/", 1))
    seen = (media.filter(F.coalesce(F.col("mime"), F.lit("")) != "")
            .join(messages.select(*by, "message_id", "code"), [*by, "message_id"])
            .select(*by, "code", family.alias("family")).distinct())
    # At most one entry per media family, a vocabulary of a few words.
    observed = seen.groupBy(*by, "code").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max(_allowed(kind, F.col("family"))).alias("any_allowed"))
    joined = counted.join(observed, [*by, "code"], "left")
    return joined.select(*by, "code", kind.alias("kind"), "messages", F.coalesce("families", F.lit("")).alias("families"),
                         F.coalesce(~F.col("any_allowed"), F.lit(False)).alias("disputed"))


def flag_counts(df: DataFrame, flags: list[str], unreadable: list[str] = ()) -> DataFrame:
    """Counts of set flags, three-valued: a column that is absent or unreadable has no count."""
    present = [f for f in flags if f in df.columns and f not in unreadable]
    agg = df.agg(*[F.count_if(F.coalesce(F.col(f), F.lit(0)) != 0).alias(f) for f in present], F.count("*").alias("_rows"))
    cells = []
    for flag in flags:
        status = "UNREADABLE" if flag in unreadable else "PRESENT" if flag in present else "ABSENT"
        value = F.col(flag) if flag in present else F.lit(None).cast("long")
        cells.append(F.struct(F.lit(flag).alias("flag"), F.lit(status).alias("status"), value.alias("n")))
    return agg.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def table_counts(rows: DataFrame, expected: DataFrame, unreadable: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts per expected table: -1 when absent, null when unreadable, never zero for either."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    bad = unreadable.select(*keys).distinct().withColumn("_bad", F.lit(True))
    joined = expected.join(counted, keys, "left").join(bad, keys, "left")
    return joined.select(
        *keys, F.when(F.col("_bad"), F.lit(None)).otherwise(F.coalesce("n", F.lit(-1))).cast("long").alias("rows"),
        F.when(F.col("_bad"), "UNREADABLE").when(F.col("n").isNull(), "ABSENT").otherwise("PRESENT").alias("status"))


def top_senders(messages: DataFrame, users: DataFrame, threads: DataFrame, device: str) -> DataFrame:
    """Messages per named sender; a device where no sender resolves falls back to thread snippets."""
    keyed = messages.withColumn("user_key", F.get_json_object("sender", "$.user_key"))
    per_key = keyed.groupBy(device, "user_key").agg(F.count("*").alias("_n"))
    named = users.filter(F.coalesce(F.col("name"), F.lit("")) != "")
    resolved = (per_key.join(named, [device, "user_key"]).groupBy(device, "name").agg(F.sum("_n").alias("messages"))
                .withColumn("named_by", F.lit("thread_users")))
    snippets = (threads.filter(F.coalesce(F.col("snippet_sender"), F.lit("")) != "")
                .groupBy(device, F.col("snippet_sender").alias("name")).agg(F.count("*").alias("messages"))
                .withColumn("named_by", F.lit("snippet")))
    return resolved.unionByName(snippets.join(resolved.select(device).distinct(), device, "left_anti"))


def name_threads(threads: DataFrame, participants: DataFrame, users: DataFrame, by: list[str] = ()) -> DataFrame:
    """Own name, else the counterpart in the thread key, else the first named participant (per ``by``, a device, say)."""
    named = users.filter(F.coalesce(F.col("name"), F.lit("")) != "").groupBy(*by, "user_key").agg(F.max("name").alias("who"))
    parts = F.split("thread_key", ":")
    counterpart = (F.col("thread_key").startswith("ONE_TO_ONE:") & (F.size(parts) == 3)
                   & F.col("user_key").endswith(F.concat(F.lit(":"), F.get(parts, 1))))
    people = (participants.join(named, [*by, "user_key"]).groupBy(*by, "thread_key")
              .agg(F.min(F.when(counterpart, F.col("who"))).alias("_counterpart"), F.min("who").alias("_first")))
    own = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("name"))
    found = F.coalesce("_counterpart", "_first")
    return threads.join(people, [*by, "thread_key"], "left").select(
        *by, "thread_key", F.coalesce(own, found, F.lit("")).alias("name"),
        F.when(own.isNotNull(), "threads.name").when(found.isNotNull(), "thread_participants").otherwise("").alias("named_by"))
