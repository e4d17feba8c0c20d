"""The report: verdict, account and credential rows, and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.secrets import mask_kind


def verdict_row(one_row: DataFrame, topic: str, answer: Column, evidence: Column, source: str) -> DataFrame:
    return one_row.select(F.lit(topic).alias("topic"), answer.alias("answer"), evidence.alias("evidence"), F.lit(source).alias("source"))


def stack(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def account_table(services: DataFrame) -> DataFrame:
    """Last authentication and last activity side by side; a missing date shows as a dash."""
    dash = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "—").otherwise(F.col(c))
    return services.select(F.col("package").alias("service"), dash("last_auth_utc").alias("last_auth_utc"),
                           dash("last_utc").alias("last_activity_utc"), F.col("last_source").alias("source"))


def credential_table(rows: DataFrame) -> DataFrame:
    return rows.select("kind", "place", mask_kind(F.col("value"), F.col("kind")).alias("shown"))


def missing_sources(expected: DataFrame, present: DataFrame, key: str = "module") -> DataFrame:
    return expected.join(present.select(key).distinct(), key, "left_anti")


def markdown_lines(title: str, sections: dict[str, DataFrame]) -> DataFrame:
    """(line_no, line): a finished report as Markdown, a table per section with its rows in the order of their text.

    Cells that hold a bar are escaped, nulls are empty. Only report rows come here, never evidence, so
    the lines are numbered in one task.
    """
    spark = next(iter(sections.values())).sparkSession
    fixed, bodies = [(0, 0, f"# {title}"), (0, 1, "")], []
    for n, (name, table) in enumerate(sections.items(), 1):
        fixed += [(n, 0, f"## {name}"), (n, 1, ""), (n, 2, "| " + " | ".join(table.columns) + " |"), (n, 3, "|" + "---|" * len(table.columns)), (n, 5, "")]
        cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in table.columns]
        bodies.append(table.select(F.lit(n).alias("section"), F.lit(4).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))
    lines = spark.createDataFrame(fixed, "section int, part int, line string")
    for body in bodies:
        lines = lines.unionByName(body)
    order = W.orderBy("section", "part", "line")
    return lines.select((F.row_number().over(order)).cast("long").alias("line_no"), "line")


def markdown(title: str, report: DataFrame) -> str:
    """Markdown table of a finished report (report rows only, never evidence)."""
    lines = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    for row in report.collect():
        lines.append("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |")
    return "\n".join(lines) + "\n"
