"""Structured documents: XML preferences, backup records, JSON histories, JSON in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.jsons import is_document, json_objects

_ITEM = "array<struct<_name:string,_value:string,_text:string>>"
PREFS_SCHEMA = (f"string {_ITEM}, int {_ITEM}, long {_ITEM}, boolean {_ITEM}, float {_ITEM}, "
                "`set` array<struct<_name:string,string:array<string>>>, _bad string")


def prefs_rows(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """Typed preference rows ``(key, type, value)`` plus one ``error`` row per bad file.

    Entries without a name are skipped; longs keep all their digits as text.
    """
    parsed = F.from_xml(F.col(xml), PREFS_SCHEMA,
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "valueTag": "_text"})
    rows = df.select(*keep, parsed.alias("p"))

    def item(kind: str):
        def one(e):
            value = F.coalesce(e["_value"], e["_text"], F.lit("")) if kind == "string" else (
                F.when(e["_value"] == "true", "true").otherwise("false") if kind == "boolean"
                else F.coalesce(e["_value"], F.lit("0")))
            return F.struct(e["_name"].alias("key"), F.lit(kind).alias("type"), value.alias("value"))
        return F.transform(F.coalesce(F.col(f"p.{kind}"), F.array().cast(_ITEM)), one)

    sets = F.transform(F.col("p.set"), lambda e: F.struct(
        e["_name"].alias("key"), F.lit("set").alias("type"),
        F.to_json(F.coalesce(e["string"], F.array().cast("array<string>"))).alias("value")))
    entry = "array<struct<key:string,type:string,value:string>>"
    refused = F.when(F.col("p._bad").isNotNull() | F.col("p").isNull(), "not well formed")
    error = F.array(F.struct(F.lit("").alias("key"), F.lit("error").alias("type"), refused.alias("value")))
    good = F.concat(*[item(k).cast(entry) for k in ("string", "int", "long", "boolean", "float")],
                    F.coalesce(sets, F.array().cast(entry)).cast(entry))
    exploded = rows.select(*keep, F.explode(F.when(refused.isNotNull(), error.cast(entry)).otherwise(good)).alias("e"))
    return (exploded.select(*keep, "e.key", "e.type", "e.value")
            .filter("type = 'error' or (key is not null and key <> '')"))


def backup_records(df: DataFrame, xml: str, keep: list[str], package: str = "") -> DataFrame:
    """``<package name=…><child>text</child>…`` as one row per package and child."""
    text = F.col(xml)
    names = F.from_xml(text, "package array<struct<_name:string>>")["package"]
    fields = F.from_xml(text, "package array<map<string,string>>")["package"]
    rows = (df.select(*keep, F.explode(F.arrays_zip(names.alias("n"), fields.alias("f"))).alias("z"))
            .select(*keep, F.coalesce("z.n._name", F.lit("")).alias("package"),
                    F.explode("z.f").alias("field", "value")).filter("field <> '_name'"))
    rows = rows.withColumn("value", F.trim(F.coalesce("value", F.lit(""))))
    return rows.filter(F.col("package") == package) if package else rows


HISTORY_SCHEMA = "array<struct<package:string,component:string,recent:bigint,history:string>>"


def component_history(df: DataFrame, doc: str, keep: list[str], package: str = "") -> DataFrame:
    """Last component per app; launches is the sum of the day counts, 0 when they are no map."""
    rows = df.select(*keep, F.explode(F.from_json(doc, HISTORY_SCHEMA)).alias("e")).filter("e is not null")
    days = F.map_values(F.from_json("e.history", "map<string,bigint>"))
    launches = F.aggregate(days, F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0)))
    out = rows.select(*keep, F.coalesce("e.package", F.lit("")).alias("package"),
                      F.coalesce("e.component", F.lit("")).alias("component"),
                      F.col("e.recent").alias("recent_ms"), F.coalesce(launches, F.lit(0)).alias("launches"))
    return out.filter(F.col("package") == package) if package else out


def json_docs(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text is a JSON object or array, parsed to VARIANT."""
    return df.filter(is_document(F.col(col))).withColumn("document", F.try_parse_json(col))


def extract_json_objects(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(json_objects(F.col(col))).alias("position", "object"))


def token_expiries(df: DataFrame, key: Column, value: Column, keep: list[str]) -> DataFrame:
    """``EXP:<authenticator>:<sig>:oauth2:<scopes>`` rows with a whole-number stamp."""
    text = value.cast("string")
    stamp = F.when(text.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(text).try_cast("long"))
    return (df.filter(key.startswith("EXP:")).select(
        *keep, F.coalesce(F.get(F.split(key, ":"), 1), F.lit("")).alias("authenticator"),
        F.coalesce(F.get(F.split(key, ":oauth2:", 2), 1), F.lit("")).alias("scope"),
        stamp.alias("expires_unix")).filter("expires_unix is not null"))


def project_optional(df: DataFrame, columns: dict[str, Column | None]) -> DataFrame:
    """Named columns where present, else the given default (schema drift)."""
    present = set(df.columns)
    return df.select(*[F.col(name) if name in present else
                       (F.lit(None) if default is None else default).alias(name)
                       for name, default in columns.items()])


def merge_drifted(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def wanted_preferences(rows: DataFrame, expected: DataFrame, segments: list[str], file: str) -> DataFrame:
    """Values by the last dotted part of the key, for every expected file, present or not."""
    part = F.substring_index("key", ".", -1)
    found = rows.filter(part.isin(segments)).select(file, part.alias("name"), "value")
    present = rows.select(file).distinct().withColumn("present", F.lit(True))
    return (expected.join(present, file, "left").join(found, file, "left")
            .select(file, F.coalesce("present", F.lit(False)).alias("present"), "name", "value"))
