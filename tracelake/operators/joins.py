"""Joins between evidence tables.

Sides that may repeat a key are aggregated to one row per key before they meet,
so no join multiplies a hot key; AQE splits what skew is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.times import utc_text


def crashes_in_window(files: DataFrame, dumps: DataFrame, by: list[str] = ()) -> DataFrame:
    """Dumps whose file was written inside the window, matched on the base name, with what they say.

    Files bring path, mtime and size, dumps process, pid, signal and build (``tombstone_fields``). Of
    several files with one name (per ``by``, a device, say) the one written last counts, by path on a
    tie, so a dump meets at most one file.
    """
    keys = [*by, "name"]
    latest = files.groupBy(*keys).agg(F.max(F.struct("mtime", "path", "size")).alias("f"))
    return latest.join(dumps, keys).select(*keys, F.col("f.path").alias("path"), utc_text(F.col("f.mtime")).alias("utc"), F.col("f.size").alias("size"),
                                           "process", "pid", "signal", "build")


def install_state(installed: DataFrame, directories: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Install records with the state of the data directory and the usage list."""
    here = directories.select(key).distinct().withColumn("_dir", F.lit(True))
    seen = used.groupBy(key).agg(F.max("last_used_ms").alias("last_used_ms"))
    joined = installed.join(here, key, "left").join(seen, key, "left")
    present, listed = F.col("_dir").isNotNull(), F.col("last_used_ms").isNotNull()
    return joined.select(
        *installed.columns, present.alias("data_dir_present"), listed.alias("usage_list_entry"), "last_used_ms",
        F.when(present, "data_dir_present").when(listed, "gone_but_listed").otherwise("no_data_dir").alias("state"))


def gone(installed: DataFrame, directories: DataFrame, key: str) -> DataFrame:
    return installed.join(directories, key, "left_anti")


def clock_check(directories: DataFrame, installs: DataFrame, key: str, tolerance: int = 900) -> DataFrame:
    """Directory time against install and update time, one row per compared key."""
    joined = directories.join(installs, key)

    def delta(column):
        return F.when(F.coalesce(F.col(column), F.lit(0)) != 0, F.col("mtime") - F.col(column))

    d = joined.withColumn("delta_install", delta("install_unix")).withColumn("delta_update", delta("update_unix"))
    hit_install = F.coalesce(F.abs("delta_install") <= tolerance, F.lit(False))
    hit_update = F.coalesce(F.abs("delta_update") <= tolerance, F.lit(False))
    return d.select(
        key, "mtime", "install_unix", "update_unix", hit_install.alias("matched_install"), hit_update.alias("matched_update"),
        (hit_install | hit_update).alias("matched"),
        F.when(hit_install, F.col("delta_install")).when(hit_update, F.col("delta_update")).alias("delta_seconds"))


def clock_summary(checked: DataFrame, by: list[str] = ()) -> DataFrame:
    agg = checked.groupBy(*by).agg(
        F.count("*").alias("compared"), F.count_if("matched_install").alias("matched_install"),
        F.count_if("matched_update").alias("matched_update"), F.count_if("matched").alias("matched_either"),
        F.coalesce(F.max(F.abs("delta_seconds")), F.lit(0)).alias("max_delta_seconds"))
    ratio = F.when(F.col("compared") > 0, F.round(F.col("matched_either") / F.col("compared"), 3)).otherwise(0.0)
    return agg.withColumn("agreement", ratio)


def merge_credentials(rows: DataFrame, key: str = "ssid") -> DataFrame:
    """Credential stores merged by network; rows carry store, store_rank, row_id, psk, bssid, account.

    The first non-empty key in store order wins, the last account, distinct
    access points are counted.
    """
    psk = F.when(F.coalesce(F.col("psk"), F.lit("")) != "", F.col("psk"))
    place = F.struct("store_rank", "row_id")
    point = F.when((F.coalesce(F.col("bssid"), F.lit("")) != "") & (F.col("bssid") != "restore"), F.col("bssid"))
    account = F.when(F.coalesce(F.col("account"), F.lit("")) != "", F.col("account"))
    agg = rows.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("store")), ",").alias("sources"),
        F.countDistinct("store").alias("_n"), F.coalesce(F.min_by(psk, F.when(psk.isNotNull(), place)), F.lit("")).alias("psk"),
        F.countDistinct(point).alias("access_points"),
        F.coalesce(F.max_by(account, F.when(account.isNotNull(), F.col("row_id"))), F.lit("")).alias("account"))
    return agg.select(key, "psk", F.length("psk").cast("long").alias("length"), "sources", "access_points", "account",
                      ((F.col("_n") > 1) & (F.col("psk") != "")).alias("has_both"))


def named_owner(df: DataFrame, dictionary: DataFrame, uid: str, name: str, by: list[str] = ()) -> DataFrame:
    """Owner names from a uid dictionary (of the same ``by``, a device, say); unknown uids show as ``uid:N``."""
    label = F.coalesce(F.col(name), F.concat(F.lit("uid:"), F.col(uid).cast("string")))
    return df.join(dictionary, [*by, uid], "left").withColumn("owner", label).drop(name)


def best_candidate(stores: DataFrame, by: list[str]) -> DataFrame:
    """Best store per group: most non-empty tables, largest, shortest name, name."""
    best = F.min(F.struct((-F.col("non_empty")).alias("e"), (-F.col("size")).alias("s"),
                          F.length("name").alias("l"), "name"))
    return stores.groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.name").alias("name"), (-F.col("b.e")).alias("non_empty"), (-F.col("b.s")).alias("size"))


def chain_and_window(chain: DataFrame, window: DataFrame, keys: list[str]) -> DataFrame:
    """Chain names plus the window names at positions the chain does not have."""
    extra = window.join(chain.select(*keys).distinct(), keys, "left_anti")
    return (chain.withColumn("source", F.lit("chain")).withColumn("trust", F.lit("high"))
            .unionByName(extra.withColumn("source", F.lit("window")).withColumn("trust", F.lit("low"))))


def record_events(df: DataFrame, keys: list[str], dated: dict[str, str]) -> DataFrame:
    """Dated columns of one record as ``(utc, event)`` rows; empty dates are left out."""
    rows = df.select(*keys, F.explode(F.array(*[
        F.struct(F.col(column).alias("unix"), F.lit(label).alias("event")) for column, label in dated.items()
    ])).alias("e"))
    return rows.filter("e.unix is not null and e.unix <> 0").select(
        *keys, utc_text(F.col("e.unix")).alias("utc"), F.col("e.event").alias("event"))
