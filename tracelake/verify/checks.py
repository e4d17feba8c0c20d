"""Recorded expectations against results, and the reading status behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def capped_log(log: DataFrame, by: list[str], order: str, keep: int = 50) -> DataFrame:
    """First ``keep`` entries per key with the true total beside them."""
    totals = log.groupBy(*by).agg(F.count("*").alias("total"))
    first = F.row_number().over(W.partitionBy(*by).orderBy(order))
    shown = log.withColumn("_r", first).filter(F.col("_r") <= keep).drop("_r")
    return shown.join(totals, by).withColumn("truncated", F.col("total") > keep)


def split_path(path: str) -> list[str]:
    """Dotted path to its parts; ``'a.b'`` in quotes is one literal key."""
    import re
    return [quoted or plain for quoted, plain in re.findall(r"'([^']*)'|([^.']+)", path)]


def json_path(parts: list[str], as_index: bool) -> str:
    """Variant path; a number is an array index or, failing that, an object key."""
    steps = [f"[{p}]" if as_index and p.isdigit() else '["' + p.replace('"', '\\"') + '"]' for p in parts]
    return "$" + "".join(steps)


ASSERTION = ("check_id string, module string, scopes array<string>, position int, path string, pin int, "
             "as_index string, as_key string, operator string, expected string, tolerance double")
# Positions that are not a finding's own number.
ANY_FINDING, NO_FINDING, PAYLOAD = -1, -2, -3
# In the order they are tried; one the template lists but nothing implements fails.
OPERATORS = ("equals", "contains", "not_contains", "matches", "gte", "lte", "in")


def assertions(spark, case: dict) -> DataFrame:
    """One row per assertion of a case file (a small document a person wrote)."""
    import json
    rows = []
    for check in case.get("checks", []):
        for position, expect in enumerate(check.get("expect", [])):
            parts = split_path(expect["path"])
            head = parts[0] if parts else ""
            pin = ANY_FINDING
            if expect["path"].startswith("data."):
                pin, parts = PAYLOAD, parts[1:]
            elif head.startswith("#"):
                pin, parts = int(head[1:]) if head[1:].isdigit() else NO_FINDING, parts[1:]
            operator = next((op for op in OPERATORS if op in expect), "")
            rows.append((check["id"], check["module"], check.get("scopes") or ["all"], position, expect["path"], pin,
                         json_path(parts, True), json_path(parts, False), operator,
                         json.dumps(expect.get(operator)) if operator else None, float(expect.get("tolerance", 0))))
    return spark.createDataFrame(rows, ASSERTION)


def in_scope(checks: DataFrame, scope: str = "all", only: str = "") -> DataFrame:
    if scope not in ("all", "full", ""):
        checks = checks.filter(F.array_contains("scopes", scope))
    return checks.filter(F.col("check_id").contains(only)) if only else checks


def _plain(value):
    """JSON text of a scalar to its plain text."""
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.when(value.startswith('"'), quoted).otherwise(value)


def holds(actual, operator, expected, tolerance):
    """One assertion over JSON texts; an unknown operator never holds."""
    number = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
    a, e = F.when(actual.rlike(number), actual.try_cast("double")), F.when(expected.rlike(number), expected.try_cast("double"))
    loose_a, loose_e = _plain(actual).try_cast("double"), _plain(expected).try_cast("double")
    listed = F.array_contains(F.from_json(actual, "array<string>"), _plain(expected))
    within = F.when(actual.startswith("["), listed).otherwise(F.contains(_plain(actual), _plain(expected)))
    equal = F.when(a.isNotNull() & e.isNotNull(), F.abs(a - e) <= tolerance).otherwise(actual == expected)
    test = (F.when(operator == "equals", equal).when(operator == "contains", within)
            .when(operator == "not_contains", ~within).when(operator == "matches", F.rlike(_plain(actual), _plain(expected)))
            .when(operator == "gte", loose_a >= loose_e).when(operator == "lte", loose_a <= loose_e)
            .when(operator == "in", F.array_contains(F.from_json(expected, "array<string>"), _plain(actual))))
    return F.coalesce(test, F.lit(False))


def run_assertions(checks: DataFrame, findings: DataFrame) -> DataFrame:
    """Every assertion against the findings of its module (module, position, values VARIANT).

    ``data.`` paths look at the module's payload row (position ``PAYLOAD``).

    A path found in one finding is that value, in several it is the list of them,
    in none it fails. Findings are report rows, a handful per module.
    """
    value = F.coalesce(F.try_variant_get("values", F.col("as_index"), "variant"), F.try_variant_get("values", F.col("as_key"), "variant"))
    seen = findings.select("module", F.col("position").alias("finding"), "values")
    asked = (F.col("pin") == F.col("finding")) | ((F.col("pin") == ANY_FINDING) & (F.col("finding") >= 0))
    matched = (checks.join(seen, "module", "left").filter(F.col("finding").isNull() | asked)
               .withColumn("hit", F.to_json(value)))
    grouped = matched.groupBy("check_id", "position", "path", "operator", "expected", "tolerance").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("hit").isNotNull(), F.struct("finding", "hit")))), lambda s: s["hit"]).alias("hits"))
    joined = checks.select("check_id", "position", "path").join(grouped, ["check_id", "position", "path"], "left")
    hits = F.coalesce("hits", F.array().cast("array<string>"))
    actual = F.when(F.size(hits) == 1, F.get(hits, 0)).when(F.size(hits) > 1, F.concat(F.lit("["), F.array_join(hits, ","), F.lit("]")))
    ok = actual.isNotNull() & holds(actual, F.col("operator"), F.col("expected"), F.col("tolerance"))
    why = (F.when(actual.isNull(), F.concat("path", F.lit(": path not in results")))
           .when(~ok, F.concat_ws(" ", F.concat("path", F.lit(":")), actual, F.coalesce("operator", F.lit("")), "expected")))
    return joined.select("check_id", "position", "path", actual.alias("actual"), ok.alias("passed"), F.coalesce(why, F.lit("")).alias("failure"))


def check_results(asserted: DataFrame) -> DataFrame:
    return asserted.groupBy("check_id").agg(
        F.count("*").alias("assertions"), F.count_if(~F.col("passed")).alias("failures"),
        F.min("passed").alias("passed"))


def run_summary(results: DataFrame, integrity: str) -> DataFrame:
    """Checks, passed, failed; a failed integrity verdict overrides a full pass (one row)."""
    agg = results.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    verdict = (F.when(F.lit(integrity) == "FAIL", "FAIL: evidence").when(F.col("failed") > 0, "FAIL").otherwise("PASS"))
    return agg.withColumn("integrity", F.lit(integrity)).withColumn("verdict", verdict)


def case_template(profile: DataFrame, module: str) -> DataFrame:
    """Case checks from profiled values (facet, key): expectations stay TODO and fail until filled."""
    check = F.struct(
        F.concat_ws(".", F.lit(module), "facet", "key").alias("id"), F.lit(module).alias("module"), F.array(F.lit("all")).alias("scopes"),
        F.array(F.struct(F.concat(F.lit("data."), "facet", F.lit(".'"), "key", F.lit("'")).alias("path"), F.lit("TODO").alias("equals"))).alias("expect"))
    return profile.select(F.to_json(check).alias("value"))


def severity_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """Findings per severity and the worst one."""
    from tracelake.functions.rules import SEVERITIES, severity_rank
    rank = severity_rank(F.col("severity"))
    agg = findings.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
                                    F.max_by("severity", rank).alias("worst"))
    return agg


def skipped_rollup(frames: dict[str, DataFrame]) -> DataFrame:
    """Skipped records over modules: (kind, n) frames by module, zero counts left out."""
    out = None
    for module, frame in frames.items():
        part = frame.select(F.lit(module).alias("module"), "kind", F.col("n").alias("count"))
        out = part if out is None else out.unionByName(part)
    return out.filter("count > 0")
