"""Browser history: visits, search terms, sessions and identity hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.times import webkit_time
from tracelake.functions.urls import host, may_hint, url_hints
from tracelake.operators.bursts import bucketed, numbered_runs, with_run
from tracelake.operators.timeline import first_k_per
from tracelake.session import cut_lineage

MICROS = 1_000_000


def visits_with_urls(visits: DataFrame, urls: DataFrame, by: list[str] = ()) -> DataFrame:
    """Visits joined to their addresses, whichever name the key column has.

    Ids count inside one store only: columns ``by`` (device, profile) are in both tables.
    """
    key = "url" if "url" in visits.columns else "url_id"
    right = urls.select(*by, F.col("id").alias(key), F.col("url").alias("address"))
    return visits.join(right, [*by, key])


def search_terms(terms: DataFrame, urls: DataFrame, by: list[str] = ()) -> DataFrame:
    """Typed terms with the address they led to; the caller orders or limits. ``by`` as in ``visits_with_urls``."""
    right = urls.withColumnRenamed("id", "url_id")
    return terms.join(right, [*by, "url_id"]).select(
        *by, "term", "url", webkit_time(F.col("last_visit")).alias("last_visit_utc"), "last_visit", "visit_count")


def recent_urls(urls: DataFrame, k: int) -> DataFrame:
    return (urls.orderBy(F.desc("last_visit"), F.asc("id")).limit(k)
            .select("id", "url", "visit_count", webkit_time(F.col("last_visit")).alias("last_visit_utc")))


def top_domains(urls: DataFrame, k: int = 15) -> DataFrame:
    name = host(F.col("url"))
    counted = (urls.groupBy(F.when(name == "", "(none)").otherwise(name).alias("host"))
               .agg(F.sum(F.coalesce("visit_count", F.lit(0))).alias("visits")))
    return counted.orderBy(F.desc("visits"), F.asc("host")).limit(k)


def identity_hints(urls: DataFrame) -> DataFrame:
    """Newest row per distinct set of hints and address; heuristic by nature."""
    hinted = (urls.filter(may_hint(F.col("url"))).withColumn("hints", F.to_json(F.map_from_entries(
        F.array_sort(F.map_entries(url_hints(F.col("url"))))))).filter("hints <> '{}'"))
    newest = F.max(F.struct("last_visit", (-F.col("id")).alias("i"), "url")).alias("m")
    return hinted.groupBy("hints", F.col("url").alias("head")).agg(newest).select(
        "hints", "m.url", (-F.col("m.i")).alias("id"))


def known_visits(visits: DataFrame, urls: DataFrame, store: list[str] = ()) -> DataFrame:
    """Visits whose address is on record (in the same ``store``); only keys meet here, no address is carried along."""
    return visits.join(urls.select(*store, F.col("id").alias("url_id")), [*store, "url_id"], "left_semi")


def session_runs(visits: DataFrame, by: list[str], gap_seconds: int = 1800) -> DataFrame:
    """One row per session with its visits and edges, from time buckets alone."""
    gap = gap_seconds * MICROS
    buckets = bucketed(visits, by, "visit_time", gap, [F.count("*").alias("_n")])
    return numbered_runs(buckets, by, gap, "session").groupBy(*by, "session").agg(
        F.sum("_n").alias("visits"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))


def session_visits(visits: DataFrame, urls: DataFrame, by: list[str], gap_seconds: int = 1800, store: list[str] = ()) -> DataFrame:
    """Visits with their session number, keys only; ``store`` (device, profile) names columns of ``by`` that ``urls`` has too.

    Several answers start from these rows, so they are written once to the
    checkpoint folder instead of being joined again for each.
    """
    known = known_visits(visits.select(*by, "visit_id", "visit_time", "url_id"), urls, store)
    return cut_lineage(with_run(known, by, gap_seconds * MICROS, "visit_time", "session"))


def session_hosts(placed: DataFrame, urls: DataFrame, by: list[str], store: list[str] = ()) -> DataFrame:
    """Every host of every session, one row each, from whole addresses.

    Sessions meet hosts on the distinct addresses they visited; an address is read once, not per visit.
    """
    named = urls.select(*store, F.col("id").alias("url_id"), host(F.col("url")).alias("host"))
    return placed.select(*by, "session", "url_id").distinct().join(named, [*store, "url_id"]).select(*by, "session", "host").distinct()


def sessions(placed: DataFrame, urls: DataFrame, by: list[str], min_size: int = 1, show: int = 10, store: list[str] = ()) -> DataFrame:
    """One row per session: start, end, visits, addresses, hosts, viewers, and hosts to show.

    ``hosts`` counts all hosts; ``domains`` shows the first ``show`` of them by name, and ``more_domains``
    tells that there are others, which ``session_hosts`` has.
    """
    keys = [*by, "session"]
    summary = placed.groupBy(*keys).agg(
        F.count("*").alias("visits"), F.min("visit_time").alias("_lo"), F.max("visit_time").alias("_hi"), F.countDistinct("url_id").alias("urls")
    ).filter(F.col("visits") >= min_size)
    all_hosts = session_hosts(placed, urls, by, store)
    shown = first_k_per(all_hosts, keys, [F.asc("host")], show).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("host")), ",").alias("domains"))
    listed = all_hosts.groupBy(*keys).agg(F.count("*").alias("hosts")).join(shown, keys)
    viewers = session_viewers(placed, urls, by, store).groupBy(*keys).agg(F.count("*").alias("viewers"))
    return (summary.join(listed, keys).join(viewers, keys, "left").select(
        *keys, "visits", webkit_time(F.col("_lo")).alias("start_utc"), webkit_time(F.col("_hi")).alias("end_utc"),
        "urls", "hosts", "domains", (F.col("hosts") > show).alias("more_domains"), F.coalesce("viewers", F.lit(0)).alias("viewers")))


def url_viewers(urls: DataFrame, store: list[str] = ()) -> DataFrame:
    """Acting accounts an address shows; read from the addresses once, not from every visit."""
    hints = url_hints(F.col("url"))
    pair = F.array_compact(F.array(F.try_element_at(hints, F.lit("viewer_uid")), F.try_element_at(hints, F.lit("viewer_av"))))
    return urls.filter(may_hint(F.col("url"))).select(*store, F.col("id").alias("url_id"), F.explode(pair).alias("viewer"))


def session_viewers(placed: DataFrame, urls: DataFrame, by: list[str], store: list[str] = ()) -> DataFrame:
    """Distinct acting accounts per session, one row each."""
    return placed.select(*by, "session", "url_id").distinct().join(url_viewers(urls, store), [*store, "url_id"]).select(*by, "session", "viewer").distinct()


def longest_sessions(visits: DataFrame, urls: DataFrame, by: list[str], gap_seconds: int = 1800) -> DataFrame:
    """Per user the session with most visits, the earlier one on a tie."""
    runs = session_runs(known_visits(visits, urls), by, gap_seconds)
    best = F.max(F.struct("visits", (-F.col("session")).alias("s"))).alias("b")
    return runs.groupBy(*by).agg(best).select(*by, (-F.col("b.s")).alias("session"), F.col("b.visits").alias("visits"))


def visits_per_day(visits: DataFrame, by: list[str]) -> DataFrame:
    day = F.left(webkit_time(F.col("visit_time")), F.lit(10)).alias("day")
    return visits.groupBy(*by, day).agg(F.count("*").alias("visits"))


def history_summary(urls: DataFrame, visits: DataFrame, terms: DataFrame, by: str) -> DataFrame:
    """Per user: addresses, visit range and search terms (total, distinct, newest, oldest)."""
    v = visits.groupBy(by).agg(F.count("*").alias("visits"), F.countDistinct("url_id").alias("urls"),
                               F.min("visit_time").alias("_lo"), F.max("visit_time").alias("_hi"))
    t = terms.groupBy(by).agg(F.count("*").alias("terms"), F.countDistinct("term").alias("unique_terms"),
                              F.max(F.struct("visit_time", "term")).alias("_new"), F.min(F.struct("visit_time", "term")).alias("_old"))
    return v.join(t, by, "left").select(
        by, "urls", "visits", webkit_time(F.col("_lo")).alias("first_visit"), webkit_time(F.col("_hi")).alias("last_visit"),
        F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("unique_terms", F.lit(0)).alias("unique_terms"),
        F.col("_new.term").alias("newest_term"), F.col("_old.term").alias("oldest_term"))
