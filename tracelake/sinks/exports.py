"""Masked text exports and the findings store.

Every writer masks before it renders; ``*_lines`` give the lines as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.paths import mode_text
from tracelake.functions.secrets import mask_df


def to_body(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Body-file lines, and the rows whose name holds a line break (refused, never dropped)."""
    breaks = F.col("path").rlike("[\r\n]")
    md5 = F.when(F.coalesce(F.col("md5"), F.lit("")) == "", "0").otherwise(F.col("md5")) if "md5" in files.columns else F.lit("0")
    numbers = [F.col(c).cast("long").cast("string") for c in ("uid", "gid", "size", "atime", "mtime", "ctime", "crtime")]
    line = F.concat_ws("|", md5, "path", F.col("inode").cast("string"), mode_text(F.col("mode")), *numbers)
    return files.filter(~breaks).select("inode", line.alias("value")), files.filter(breaks)


def write_body(files: DataFrame, path: str) -> DataFrame:
    good, refused = to_body(files)
    good.select("value").write.mode("overwrite").text(path)
    return refused


def refused_packages(refused: DataFrame) -> DataFrame:
    """Which application the refused names come from."""
    parts = F.split("path", "/")
    package = F.when((F.size(parts) > 2) & (F.get(parts, 1) == "data"), F.get(parts, 2)).otherwise(
        F.array_join(F.slice(parts, 2, 2), "/"))
    return refused.groupBy(package.alias("package")).agg(F.count("*").alias("names"))


def _plain(df: DataFrame) -> DataFrame:
    """Bytes as hex, sets (arrays flagged by name ``*_set``) sorted."""
    shaped = {n: F.lower(F.hex(n)) for n, t in df.dtypes if t == "binary"}
    shaped.update({n: F.array_sort(n) for n, t in df.dtypes if t.startswith("array") and n.endswith("_set")})
    return df.withColumns(shaped) if shaped else df


def csv_lines(df: DataFrame, kinds: dict[str, str], reveal: bool = False) -> DataFrame:
    masked = _plain(mask_df(df, kinds, reveal))
    return masked.select(F.to_csv(F.struct(*masked.columns), {"quoteAll": "false"}).alias("value"))


def json_lines(df: DataFrame, kinds: dict[str, str], reveal: bool = False) -> DataFrame:
    masked = _plain(mask_df(df, kinds, reveal))
    return masked.select(F.to_json(F.struct(*masked.columns), {"ignoreNullFields": "false"}).alias("value"))


def to_csv(df: DataFrame, path: str, kinds: dict[str, str], reveal: bool = False) -> None:
    _plain(mask_df(df, kinds, reveal)).write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame, path: str, kinds: dict[str, str], reveal: bool = False) -> None:
    _plain(mask_df(df, kinds, reveal)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def merge_runs(prior: DataFrame, current: DataFrame, run: str = "run_id") -> DataFrame:
    """Earlier runs kept, the same run replaced."""
    return prior.join(current.select(run).distinct(), run, "left_anti").unionByName(current)


def save_findings(findings: DataFrame, path: str, run: str = "run_id") -> None:
    """Only the partitions of the runs being written are replaced."""
    (findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path))


def hashes_manifest(entries: DataFrame) -> DataFrame:
    """``name,source,sha256,bytes,recorded_utc`` lines; rows without a digest are left out."""
    def quoted(name):
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[,"\r\n]'), doubled).otherwise(text)

    held = entries.filter(F.coalesce(F.col("sha256"), F.lit("")) != "")
    return held.select(F.concat_ws(",", quoted("name"), quoted("source"), "sha256",
                                   F.coalesce("bytes", F.lit(0)).cast("long").cast("string"), "recorded_utc").alias("value"))
