"""Readers for text logs.

Lines carry their file, the split of the file they come from, and their place in it. Lines of a file
that Spark reads in many splits (``read_lines``) go to as many tasks; a text in a cell is cut into
splits of ``LINES`` lines. What a line needs from lines before or after it (the header that owns it,
the note before it) is looked up in its own split first, else carried over from the nearest split
that has one: windows run inside a split and over one summary row per split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usage_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """``package millis`` lines; malformed ones dropped, zero kept."""
    parts = F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")
    millis = F.when(F.get(parts, 1).rlike(r"^[+-]?\d{1,18}$"), F.get(parts, 1).try_cast("long"))
    keep = [c for c in lines.columns if c != value]
    return (lines.select(*keep, F.when(F.size(parts) == 2, F.get(parts, 0)).alias("package"),
                         millis.alias("last_used_ms"))
            .filter("package is not null and last_used_ms is not null"))


LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


#: Lines of one split of a text that arrives in a cell.
LINES = 1 << 16


def _stripped(line: str) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def read_lines(spark: SparkSession, path: str, keep: list[str] = ()) -> DataFrame:
    """(file, split, pos, line) of text files of any size, each read in as many tasks as it has splits.

    ``split`` is where the split begins in the file, ``pos`` grows with the lines of a split; ``keep``
    names partition columns of the folder. Order inside a file is (split, pos).
    """
    rows = spark.read.text(path).select(
        *keep, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    return rows.withColumn("line", _stripped("line"))


def numbered(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``pos`` as the number of the line in its file, from 0."""
    sizes = lines.groupBy(*keys, "split").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy(*keys, "split").orderBy("pos")) - 1
    return lines.withColumn("_own", own).join(starts, [*keys, "split"]).withColumn("pos", F.col("_start") + F.col("_own")).drop("_own", "_start")


def file_lines(files: DataFrame, text: str | None, keep: list[str], holding: list[str] = ()) -> DataFrame:
    """One row per line, trimmed, with its split and its place in the file; rows that are lines already pass.

    With ``holding`` only lines that contain one of these texts, looked for before lines are trimmed.
    """
    some = F.lit(not holding)
    for part in holding:
        some = some | F.col("line").contains(part)
    if text is None:
        return files.select(*keep, "split", "pos", "line").filter(some)
    return (files.select(*keep, F.posexplode(F.split(text, LINE_BREAK)).alias("pos", "line")).filter(some)
            .withColumn("line", _stripped("line")).withColumn("split", F.floor(F.col("pos") / LINES)))


def _carried(lines: DataFrame, keys: list[str], value: Column, name: str, back: bool = True, own: bool = True) -> DataFrame:
    """``lines`` with the nearest non-null ``value`` at or before each line (after it, unless ``back``).

    ``own`` tells whether the line itself counts. Inside a split a window finds it; what a split has
    not is the last (or first) value of the splits before (or after), one row each.
    """
    d = lines.withColumn(name, value)
    place = F.when(F.col(name).isNotNull(), F.col("pos"))
    pick = F.max_by if back else F.min_by
    ends = d.groupBy(*keys, "split").agg(pick(name, place).alias("_end"))
    inside, between = W.partitionBy(*keys, "split").orderBy("pos"), W.partitionBy(*keys).orderBy("split")
    edge = 0 if own else -1 if back else 1
    if back:
        near = F.last(name, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, edge))
        far = F.last("_end", ignorenulls=True).over(between.rowsBetween(W.unboundedPreceding, -1))
    else:
        near = F.first(name, ignorenulls=True).over(inside.rowsBetween(edge, W.unboundedFollowing))
        far = F.first("_end", ignorenulls=True).over(between.rowsBetween(1, W.unboundedFollowing))
    carried = ends.select(*keys, "split", far.alias("_far"))
    return d.withColumn("_near", near).join(carried, [*keys, "split"]).withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far")


def block_rows(files: DataFrame, text: str | None, keys: list[str], opens: str = "network=",
               closes: str = "}") -> DataFrame:
    """``opens{ k=v … }`` blocks as ``(block, key, value)``; outside pairs have block -1.

    A pair is in a block when the marker before it opens one and the marker after
    it closes one; a block that is reopened or never closed is not reported. ``block`` is the place
    of the opening line.
    """
    # A line that holds no mark and no pair tells nothing: it is dropped before it is trimmed and shuffled.
    lines = file_lines(files, text, keys, [opens, closes, "="]).filter("line <> '' and not startswith(line, '#')").repartition(*keys, "split")
    kind = (F.when(F.col("line").startswith(opens), "open").when(F.col("line") == closes, "close"))
    mark = F.when(kind.isNotNull(), F.struct("pos", kind.alias("kind")))
    marked = _carried(lines.withColumn("mark", mark), keys, F.col("mark"), "b")
    placed = (_carried(marked, keys, F.col("mark"), "a", back=False)
              .filter(F.col("mark").isNull() & F.col("line").contains("=")))
    inside = F.coalesce(F.col("b.kind") == "open", F.lit(False))
    pair = F.split("line", "=", 2)
    value = F.trim(F.get(pair, 1))
    rows = (placed.filter(~inside | (F.col("a.kind") == "close"))
            .select(*keys, F.when(inside, F.col("b.pos")).otherwise(-1).alias("block"), "split", "pos",
                    F.trim(F.get(pair, 0)).alias("key"),
                    F.when(inside, F.regexp_replace(value, '^"+|"+$', "")).otherwise(value).alias("value")))
    return rows.groupBy(*keys, "block", "key").agg(F.max_by("value", F.struct("split", "pos")).alias("value"))


def blocks_wide(rows: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    picked = [F.max(F.when(F.col("key") == name, F.col("value"))).alias(name) for name in wanted]
    return rows.filter("block >= 0").groupBy(*keys, "block").agg(*picked)


FIELD = r"^([A-Za-z][\w .]{0,40}?)\s*:\s*(.*)$"


def grouped_log(files: DataFrame, text: str | None, keys: list[str], start_key: str = "package name") -> DataFrame:
    """``key: value`` lines with the header line that owns them; lines before any header are dropped."""
    lines = file_lines(files, text, keys).filter(F.col("line").rlike(FIELD))
    fields = lines.select(*keys, "split", "pos", F.regexp_extract("line", FIELD, 1).alias("key"),
                          F.regexp_extract("line", FIELD, 2).alias("value"))
    header = F.when(F.col("key") == start_key, F.struct("pos", "value"))
    return (_carried(fields, keys, header, "h").filter("h is not null")
            .select(*keys, F.col("h.pos").alias("group"), F.col("h.value").alias("package"), "split", "pos", "key", "value"))


def crash_history(files: DataFrame, text: str | None, keys: list[str]) -> DataFrame:
    rows = grouped_log(files, text, keys)
    last = lambda name: F.max_by(F.when(F.col("key") == name, F.col("value")),
                                 F.when(F.col("key") == name, F.struct("split", "pos")))
    times = F.when(F.col("key") == "happen time", F.col("value"))
    count = F.regexp_extract(last("crash since start"), r"(\d+)", 1).try_cast("long")
    return rows.groupBy(*keys, "group", "package").agg(
        F.coalesce(last("package version"), F.lit("")).alias("version"),
        F.coalesce(count, F.lit(0)).alias("crashes_since_boot"),
        F.coalesce(last("subtype"), F.lit("")).alias("subtype"),
        F.count(times).alias("occurrences"), F.coalesce(F.min(times), F.lit("")).alias("first_time"),
        F.coalesce(F.max(times), F.lit("")).alias("last_time"))


def carry_note(files: DataFrame, text: str | None, keys: list[str]) -> DataFrame:
    """Reboot records with the note line written since the record before."""
    note, record = F.col("line").startswith("kernel reboot"), F.col("line").startswith("record time_stamp")
    after_colon = F.trim(F.coalesce(F.get(F.split("line", ":", 2), 1), F.lit("")))
    marks = (file_lines(files, text, keys).filter(note | record)
             .select(*keys, "split", "pos", record.alias("is_record"), after_colon.alias("value")))
    previous = _carried(marks, keys, F.struct("is_record", "value"), "p", own=False)
    return (previous.filter("is_record").select(
        *keys, "split", "pos", F.col("value").alias("local"),
        F.when(~F.col("p.is_record"), F.col("p.value")).otherwise("").alias("note")))


DEBUG_LINE = r"^(\d+)\s+(\S+)\s+\[(\w+)\]\s+([\d-]+)\s+([\d:]+)\s+(.*)$"


def parse_debug_log(files: DataFrame, text: str | None, name: str, keep: list[str]) -> DataFrame:
    """Priority, tag, level, date, time and message; the year comes from the file name."""
    year = F.regexp_extract(name, r"(\d{4})", 1)
    lines = file_lines(files, text, [name, *keep]).filter(F.col("line").rlike(DEBUG_LINE))
    field = lambda i: F.regexp_extract("line", DEBUG_LINE, i)
    return lines.select(
        name, *keep, "pos", field(1).alias("priority"), field(2).alias("tag"), field(3).alias("level"),
        F.when(year != "", F.concat_ws("-", year, field(4))).otherwise(field(4)).alias("date"),
        field(5).alias("time"), field(6).alias("message"))


def tombstone_fields(text: Column) -> Column:
    """Header of a crash dump: process, pid, signal and build."""
    pid = r"(?m)^pid:[ \t]*(\d+),[ \t]*tid:[ \t]*(\d+),[ \t]*name:[ \t]*([^>\n]+?)[ \t]*(?:>>>|$)"
    signal = r"(?m)^signal[ \t]+(\d+)[ \t]*\(([^)\n]+)\)"
    number = F.regexp_extract(text, signal, 1)
    return F.struct(
        F.regexp_extract(text, pid, 3).alias("process"), F.regexp_extract(text, pid, 1).alias("pid"),
        F.when(number == "", "").otherwise(
            F.concat(number, F.lit(" ("), F.regexp_extract(text, signal, 2), F.lit(")"))).alias("signal"),
        F.trim(F.regexp_extract(text, r"(?m)^Build fingerprint:([^\n]*)$", 1)).alias("build"))


CONTINUATION = r"^(Fix|Optimize|Connect)\?\s*(no|yes)?$"
SKIPPED = ("$", "Warning:", "Pass ", "exit=")


def checker_messages(files: DataFrame, text: str | None, keys: list[str]) -> DataFrame:
    """Message lines with their continuation lines joined on, in file order."""
    lines = file_lines(files, text, keys).filter("line <> ''")
    for prefix in SKIPPED:
        lines = lines.filter(~F.col("line").startswith(prefix))
    more = F.col("line").rlike(CONTINUATION)
    place = F.struct("split", "pos")
    placed = _carried(lines.withColumn("place", place), keys, F.when(~more, F.col("place")), "head")
    # A continuation with nothing before it stands as a message of its own: the
    # first one becomes the head the following ones attach to.
    first = lines.groupBy(*keys).agg(F.min(place).alias("_first"))
    placed = placed.join(first, keys).withColumn("head", F.coalesce("head", "_first"))
    piece = F.when(F.col("place") == F.col("head"), F.col("line")).otherwise(
        F.concat(F.lit("  ["), "line", F.lit("]")))
    # Continuations of one message are a handful of prompt lines.
    return placed.withColumn("piece", piece).groupBy(*keys, "head").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))),
                                 lambda s: s["piece"]), "").alias("message"))
