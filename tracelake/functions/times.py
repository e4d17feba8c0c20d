"""Time expressions. ``unix`` (whole seconds, BIGINT) is the canonical column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit cut-offs and epochs.
MILLI_FROM = 100_000_000_000
MICRO_FROM = 100_000_000_000_000
WEBKIT_DELTA = 11_644_473_600
DAY = 86_400
EPOCH_1980 = 315_532_800
PLAUSIBLE_FROM_MS = 1_420_070_400_000
FIRST_UTC, LAST_UTC = -62_135_596_800, 253_402_300_799
ZONE_HOURS = {"UTC": 0, "GMT": 0, "CET": 1, "CEST": 2}

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_HEAD = r"^\d{4}[-/: ]"
ISO_WHOLE = (r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?"
             r"(Z|[+-]\d{2}:\d{2})?)?\s*$")


def as_number(col: Column) -> Column:
    """Text to double; anything that is not a plain number is null."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def epoch_seconds(col: Column) -> Column:
    """Stamp of unknown unit to ``struct<unix, unit, ok>``.

    ISO-looking text is tried before numbers. Below 1e11 a number is seconds,
    below 1e14 milliseconds, above that microseconds; fractions truncate to zero.
    """
    text = col.cast("string")
    number = F.trim(text).try_cast("double")
    iso = F.when(text.rlike(ISO_WHOLE), F.trim(text).try_cast("timestamp"))
    looks_iso, looks_number = text.rlike(ISO_HEAD), text.rlike(NUMBER)
    scale = F.when(number < MILLI_FROM, 1.0).when(number < MICRO_FROM, 1e3).otherwise(1e6)
    unix = (F.when(looks_iso, (F.unix_micros(iso) / 1_000_000).cast("long"))
            .when(looks_number, (number / scale).try_cast("long")))
    unit = (F.when(looks_iso, F.when(iso.isNotNull(), "iso"))
            .when(looks_number, F.when(number < MILLI_FROM, "s").when(number < MICRO_FROM, "ms")
                  .otherwise("us")))
    ok = F.when(looks_iso, iso.isNotNull()).when(looks_number, number != 0)
    return F.struct(F.coalesce(unix, F.lit(0).cast("long")).alias("unix"),
                    F.coalesce(unit, F.lit("")).alias("unit"),
                    F.coalesce(ok, F.lit(False)).alias("ok"))


def utc_text(unix: Column) -> Column:
    """ISO text with ``Z``; zero, null and out-of-range give the empty string."""
    usable = (unix != 0) & unix.between(FIRST_UTC, LAST_UTC)
    stamp = F.timestamp_seconds(F.when(usable, unix))
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def utc_ms_text(millis: Column) -> Column:
    return utc_text(F.floor(millis / 1000).cast("long"))


def epoch_auto(col: Column) -> Column:
    """Seconds or milliseconds only; values that are not positive are empty."""
    number = F.coalesce(as_number(col), F.lit(0.0))
    unit = F.when(number <= 0, "").when(number < MILLI_FROM, "s").otherwise("ms")
    seconds = F.when(unit == "ms", number / 1e3).otherwise(number)
    return F.struct(
        F.when(number <= 0, "").otherwise(utc_text(F.floor(seconds).cast("long"))).alias("utc"),
        unit.alias("unit"),
    )


def webkit_unix(col: Column) -> Column:
    """Microseconds since 1601 to Unix seconds."""
    whole = col.cast("long")
    return F.call_function("div", whole - F.pmod(whole, F.lit(1_000_000)), F.lit(1_000_000)) - WEBKIT_DELTA


def webkit_time(col: Column) -> Column:
    return F.when(col.isNull() | (col == 0), "").otherwise(utc_text(webkit_unix(col)))


def _last_sunday(year: Column, month: int) -> Column:
    end = F.make_date(year, F.lit(month), F.lit(31))
    return F.date_sub(end, (F.dayofweek(end) - 1).cast("int"))


def local_text(unix: Column, winter_hours: int = 1) -> Column:
    """Local wall time under the current EU summer-time rule, for every year."""
    usable = F.when((unix != 0) & unix.between(FIRST_UTC, LAST_UTC), unix)
    year = F.year(F.timestamp_seconds(usable))
    start = F.unix_date(_last_sunday(year, 3)).cast("long") * DAY + 3600
    end = F.unix_date(_last_sunday(year, 10)).cast("long") * DAY + 3600
    summer = (usable >= start) & (usable < end)
    shifted = usable + F.when(summer, (winter_hours + 1) * 3600).otherwise(winter_hours * 3600)
    return F.coalesce(F.date_format(F.timestamp_seconds(shifted), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def span_human(seconds: Column) -> Column:
    """``2 d 3 h 4 min``; seconds appear only when there are no whole days."""
    s = seconds.cast("long")
    days, rest = F.floor(s / DAY), s % DAY
    hours, rest = F.floor(rest / 3600), rest % 3600
    minutes, secs = F.floor(rest / 60), rest % 60

    def part(n, unit, extra=None):
        shown = n > 0 if extra is None else (n > 0) & extra
        return F.when(shown, F.concat(n.cast("string"), F.lit(unit)))

    text = F.concat_ws(" ", part(days, " d"), part(hours, " h"), part(minutes, " min"),
                       part(secs, " s", days == 0))
    return F.when(s <= 0, "0 s").otherwise(text)


def zoned_epoch(col: Column) -> Column:
    """``2024-01-02 03:04:05 (CET)`` to Unix seconds; unknown zones give null."""
    head = F.regexp_extract(col, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    zone = F.regexp_extract(col, r"\(([A-Z]+)\)\s*$", 1)
    pairs = [F.lit(item) for pair in ZONE_HOURS.items() for item in pair]
    hours = F.try_element_at(F.create_map(*pairs), zone)
    stamp = F.when(head != "", head.try_cast("timestamp"))
    return F.unix_seconds(stamp) - hours * 3600


def cutoff(text: Column) -> Column:
    """Three accepted date spellings to Unix seconds, anything else is zero."""
    day = r"\d{4}-\d{1,2}-\d{1,2}"
    clock = r"\d{1,2}:\d{1,2}:\d{1,2}"
    shape = rf"^{day}( {clock}|T{clock}Z)?$"
    stamp = F.when(text.rlike(shape), text.try_cast("timestamp"))
    return F.coalesce(F.unix_seconds(stamp), F.lit(0).cast("long"))


def time_class(unix: Column, since: int) -> Column:
    """``recent`` is tested first, then the epoch day, then the installer range."""
    chain = F.when(F.lit(bool(since)) & (unix >= since), "recent")
    return (chain.when(unix < DAY, "epoch").when(unix < EPOCH_1980, "installer")
            .otherwise("coherent"))


def plausible(millis: Column) -> Column:
    return (F.when(millis.isNull() | (millis == 0), "zero")
            .when(millis < PLAUSIBLE_FROM_MS, "implausible").otherwise("ok"))


def name_stamp_ms(name: Column) -> Column:
    """Digits after the last dot of a file name, a trailing dash ignored."""
    stem = F.regexp_replace(F.substring_index(name, ".", -1), r"-+$", "")
    return F.when(stem.rlike(r"^\d{1,18}$"), stem.try_cast("long"))


def name_local_time(name: Column) -> Column:
    """``…2024-01-02-03-04-05…`` inside a file name as local wall time."""
    rx = r"(\d{4}-\d{2}-\d{2})-(\d{2})-(\d{2})-(\d{2})"
    day = F.regexp_extract(name, rx, 1)
    clock = F.concat_ws(":", *[F.regexp_extract(name, rx, i) for i in (2, 3, 4)])
    return F.when(day == "", "").otherwise(F.concat_ws(" ", day, clock))
