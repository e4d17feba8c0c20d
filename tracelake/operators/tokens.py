"""Access tokens in documents and text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.jsons import json_lookup, json_read, lookup
from tracelake.functions.secrets import SHAPES, TOKEN_RX, is_noise, mask_kind, shape_hits

# Markers of OAuth2 grants and of another provider's keys.
OAUTH2_RX, OTHER_RX = r":oauth2:", r":(\^\^[^:]+)"
# Markers left behind in an application directory.
LEFTOVER = ("SCOUT_TOKEN", "snapchat_token", "auth_token")


def access_tokens(docs: DataFrame, doc: str, keep: list[str]) -> DataFrame:
    """Top-level string fields holding a token, with the account the document names.

    A document is read once, whatever its depth, and only if it shows a token at all.
    """
    rows = docs.filter(F.col(doc).contains("EAA")).select(*keep, F.col(doc).alias("_doc"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            row, columns = [], [[], [], [], []]
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                document, _ = json_read(text)
                tokens = [(k, v) for k, v in document.items() if isinstance(v, str) and v.startswith("EAA")] if isinstance(document, dict) else []
                if tokens:
                    account = lookup(document, ("uid", "fbid", "id")), lookup(document, ("name", "display_name", "username"), True)
                    row += [i] * len(tokens)
                    for column, values in zip(columns, zip(*((*t, *account) for t in tokens))):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]), *(pa.array(c, pa.string()) for c in columns)],
                                             names=[*batch.schema.names[:-1], "field", "token", "uid", "name"])

    found = rows.mapInArrow(run, (types + ", " if types else "") + "field string, token string, uid string, name string")
    return found.withColumn("noise", is_noise(F.col("token"), F.col("field")))


def unread_documents(docs: DataFrame, doc: str, by: list[str]) -> DataFrame:
    """Per ``by``: documents, and those that are broken or empty and so show no token they may hold."""
    status = json_lookup(F.col(doc), {})["status"]
    return docs.select(*by, status.alias("status")).groupBy(*by).agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "broken").alias("broken"), F.count_if(F.col("status") == "empty").alias("empty"))


def merge_tokens(hits: DataFrame, tie: str) -> DataFrame:
    """One row per token: occurrences, sources, and the account from a source that names it."""
    named = F.when(F.col("uid") != "", F.struct(F.col(tie), F.col("uid"), F.col("name")))
    agg = hits.groupBy("token").agg(
        F.count("*").alias("occurrences"), F.countDistinct("source").alias("sources"),
        F.min(named).alias("n"), F.min(F.struct(tie, "field")).alias("f"))
    return agg.select("token", F.coalesce("n.uid", F.lit("")).alias("uid"), F.coalesce("n.name", F.lit("")).alias("name"),
                      F.col("f.field").alias("field"), F.length("token").cast("long").alias("length"), "occurrences", "sources")


def token_statistics(hits: DataFrame, raw: DataFrame, by: str) -> DataFrame:
    """Per source: raw hits, real tokens and noise, which is never below zero."""
    real = hits.filter(~F.col("noise")).groupBy(by).agg(F.countDistinct("token").alias("tokens"), F.count("*").alias("occurrences"))
    seen = raw.groupBy(by).agg(F.count("*").alias("raw_hits"))
    return seen.join(real, by, "left").select(
        by, "raw_hits", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        F.greatest(F.col("raw_hits") - F.coalesce("tokens", F.lit(0)), F.lit(0)).alias("noise_hits"))


def pattern_runs(df: DataFrame, text: Column, keep: list[str], pattern: str = TOKEN_RX, marker: str = "") -> DataFrame:
    """Matches of a token pattern with their ordinal in the text."""
    rows = df.filter(text.contains(marker)) if marker else df
    return rows.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("position", "token"))


def first_occurrences(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct token once per document, at its first position."""
    return runs.groupBy(*keys, "token").agg(F.min("position").alias("position"))


def by_authenticator(rows: DataFrame) -> DataFrame:
    """Tokens per authenticator and scope test; tokens without a kind are orphans, kept apart."""
    kinded = F.col("kind").isNotNull()
    name = F.when(kinded, F.substring_index("kind", ":", 1)).otherwise("(orphan)")
    scope = F.coalesce(F.get(F.split("kind", ":oauth2:", 2), 1), F.lit(""))
    distinct = rows.groupBy("token").agg(F.min(F.struct("row_id", "kind")).alias("r")).select("token", "r.kind")
    return distinct.groupBy(name.alias("authenticator")).agg(
        F.count("*").alias("tokens"), F.count_if(F.col("kind").rlike(OAUTH2_RX)).alias("oauth2"),
        F.count_if(F.col("kind").rlike(OTHER_RX)).alias("other_provider"),
        F.count_if(scope.contains("mail.google.com") | scope.contains("gmail")).alias("mail_scope"))


def marker_counts(df: DataFrame, text: str, key: str, markers: tuple[str, ...] = LEFTOVER) -> DataFrame:
    """Occurrences per file and marker; pairs without any are left out."""
    body = F.col(text)
    cells = F.array(*[F.struct(F.lit(m).alias("marker"),
                               ((F.length(body) - F.length(F.replace(body, F.lit(m), F.lit("")))) / len(m)).cast("long").alias("n"))
                      for m in markers])
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.marker", "c.n").filter("n > 0")


def shape_scan(df: DataFrame, text: str, keep: list[str], shapes: dict = SHAPES, reveal: bool = False) -> DataFrame:
    """Secret-looking strings by shape, masked unless revealed."""
    rows = df.select(*keep, F.explode(shape_hits(F.col(text), shapes)).alias("h")).select(*keep, "h.shape", "h.value")
    shown = F.col("value") if reveal else mask_kind(F.col("value"), "token")
    return rows.groupBy(*keep, "shape", shown.alias("shown")).agg(F.count("*").alias("hits"))
