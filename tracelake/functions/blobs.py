"""Expressions over BINARY columns.

Bytes are read as ISO-8859-1 text, one character per byte, so byte patterns
stay inside Spark's own string functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes of the container formats.
SQLITE_MAGIC = "SQLite format 3\x00"
JAVA_MAGIC = "¬í"
PRINTABLE_RUN = r"[ -~]{4,}"
# Wording of a second classifier mapped to our labels, in order.
SECOND_OPINION = (
    ("sqlite", "sqlite"), ("java serialization", "java-serialized"),
    ("java class", "java-serialized"), ("json", "json"), ("xml", "shared-prefs-xml"),
    ("ascii text", "text"), ("utf-8 text", "text"), ("unicode text", "text"),
    ("iso-8859", "text"),
)


def latin(blob: Column) -> Column:
    return F.decode(blob, "ISO-8859-1")


def _head(blob: Column, n: int) -> Column:
    return latin(F.substring(blob, 1, n))


def blob_class(blob: Column) -> Column:
    """Container format by leading bytes; the order of the tests matters."""
    head = latin(blob)
    space = r"^[ \t\n\r\x0b\f]*"
    return (F.when(head.startswith(SQLITE_MAGIC), "sqlite")
            .when(head.startswith(JAVA_MAGIC), "java-serialized")
            .when(head.rlike(space + r"(<\?xml|<map>)"), "shared-prefs-xml")
            .when(head.rlike(space + r"[{\[]"), "json")
            .when(head.startswith("\x00\x02") & (F.octet_length(blob) > 8), "ber-properties-store")
            .otherwise("opaque"))


def second_label(raw: Column) -> Column:
    low = F.lower(raw)
    out = F.when(raw.isNull(), "")
    for needle, label in SECOND_OPINION:
        out = out.when(low.contains(needle), label)
    return out.otherwise("")


def class_checked(ours: Column, theirs: Column, raw: Column) -> Column:
    """Two classifiers side by side: which label to report and how they relate."""
    relation = (F.when(F.coalesce(raw, F.lit("")) == "", "no answer")
                .when(theirs == "", "no label").when(ours == theirs, "agree")
                .when(ours == "opaque", "theirs reported").otherwise("disagree"))
    report = F.when((ours == "opaque") & (theirs != ""), theirs).otherwise(ours)
    return F.struct(report.alias("report"), relation.alias("relation"))


def looks_encrypted(blob: Column) -> Column:
    """At least 512 bytes, no magic, no printable run in 4 KiB, few NULs in 8 KiB."""
    head, sample = _head(blob, 4096), _head(blob, 8192)
    nuls = F.length(sample) - F.length(F.replace(sample, F.lit("\x00"), F.lit("")))
    return F.coalesce(
        (F.octet_length(blob) >= 512) & ~head.startswith(SQLITE_MAGIC)
        & ~head.startswith(JAVA_MAGIC) & ~head.rlike(PRINTABLE_RUN)
        & (nuls < F.floor(F.length(sample) / 64)), F.lit(False))


def longest_first(values: Column) -> Column:
    keyed = F.transform(F.array_distinct(values),
                        lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def text_strings(text: Column) -> Column:
    """Distinct printable runs of four or more, longest first, then by text."""
    return longest_first(F.regexp_extract_all(text, F.lit(PRINTABLE_RUN), F.lit(0)))


def digit_fields(text: Column, country: str = "48", domain: str = "s.whatsapp.net") -> Column:
    """Digit runs of 6 to 15, and the identity they spell out; a composed id is flagged."""
    rx_id = rf"(\d{{6,15}})@{domain.replace('.', chr(92) + '.')}"
    runs = longest_first(F.regexp_extract_all(text, F.lit(r"(?<![0-9])(\d{6,15})(?![0-9])"), F.lit(1)))
    stated = F.regexp_extract(text, rx_id, 1)
    country_run = F.get(F.filter(runs, lambda v: v.startswith(country) & (F.length(v) >= 10)), 0)
    national = F.get(F.filter(runs, lambda v: F.length(v).between(8, 10)), 0)
    e164 = F.when(stated != "", stated).otherwise(country_run)
    return F.struct(
        runs.alias("digits"), F.coalesce(e164, F.lit("")).alias("e164"),
        F.coalesce(national, F.lit("")).alias("number"),
        F.coalesce(F.concat(e164, F.lit("@" + domain)), F.lit("")).alias("address"),
        (e164.isNotNull() & (stated == "")).alias("derived"))


def utf16_names(blob: Column) -> Column:
    """Names written as UTF-16 runs, distinct, in order of appearance."""
    runs = F.regexp_extract_all(latin(blob), F.lit(r"(?:[ -~]\x00){3,}"), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda r: F.replace(r, F.lit("\x00"), F.lit(""))))


def is_binary(blob: Column) -> Column:
    text = latin(blob)
    kept = F.length(F.regexp_replace(text, r"[^ -~\t\n\r]", ""))
    return F.coalesce((F.length(text) > 0) & (kept < 0.7 * F.length(text)), F.lit(False))


def embedded_db_names(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"[ -~]{16,}\.db"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def context(text: Column, at: Column, around: int, needle: str, reveal: bool = False) -> Column:
    """Characters around a zero-based hit, the needle itself shown as question marks."""
    start = F.greatest(at - around, F.lit(0))
    window = F.substr(text, (start + 1).cast("int"), F.lit(2 * around + len(needle)))
    return window if reveal else F.replace(window, F.lit(needle), F.lit("?" * len(needle)))


def hexdump(blob: Column, base: Column) -> Column:
    """Sixteen bytes a line with absolute offsets."""
    size = F.octet_length(blob)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(16)))
    # Both renderings are made once and cut as bytes, where a slice costs its own length.
    pairs = F.encode(F.regexp_replace(F.lower(F.hex(blob)), "(..)", "$1 "), "US-ASCII")
    shown = F.encode(F.regexp_replace(latin(blob), r"[^ -~]", "."), "US-ASCII")
    parts = F.struct(starts.alias("s"), pairs.alias("p"), shown.alias("t"))

    def cut(binary, at, n):
        return F.decode(F.substring(binary, at + 1, F.lit(n)), "US-ASCII")

    def line(w, at):
        return F.concat(F.lpad((base + at).cast("string"), 12, "0"), F.lit("  "),
                        F.rpad(F.rtrim(cut(w["p"], at * 3, 48)), 48, " "),
                        F.lit(" |"), cut(w["t"], at, 16), F.lit("|"))

    lines = F.transform(F.array(parts), lambda w: F.array_join(
        F.transform(w["s"], lambda at: line(w, at)), "\n"))
    return F.coalesce(F.get(lines, 0), F.lit(""))
