"""Path, mode and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# File-type bits of a mode and the letters body files use.
TYPE_LETTERS = {0o100000: "r", 0o040000: "d", 0o120000: "l", 0o140000: "s",
                0o010000: "p", 0o060000: "b", 0o020000: "c"}
SOCKET = 0o140000
DIGEST_CHARS = 12
STOP_DIRS = ("media", "misc", "system", "app", "cache", "data", "sdcard")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _without_suffix(name: Column) -> Column:
    return F.regexp_replace(name, "-[^-]*$", "")


def package_of(path: Column) -> Column:
    """Owning package of an absolute path; anything else has none."""
    p = parts(path)
    first, second, third = F.get(p, 0), F.get(p, 1), F.get(p, 2)
    deep = F.size(p) > 1
    return (
        F.when(path.isNull() | ~path.startswith("/") | (F.size(p) == 0), "")
        .when((first == "data") & deep, second)
        .when((first == "system") & deep & (second == "app"),
              F.coalesce(_without_suffix(third), F.lit("")))
        .when((first == "app") & deep, _without_suffix(second))
        .otherwise(first)
    )


def top(path: Column) -> Column:
    return F.coalesce(F.get(parts(path), 0), F.lit("/"))


def second(path: Column) -> Column:
    p = parts(path)
    return F.coalesce(F.get(p, 1), F.get(p, 0), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def mode_text(mode: Column) -> Column:
    """``d/drwxrwx---``: the type letter is repeated, a socket repeats as ``h``."""
    m = mode.cast("long")
    kind = m.bitwiseAND(0o170000)
    letters = F.create_map(*[F.lit(x) for pair in TYPE_LETTERS.items() for x in pair])
    letter = F.coalesce(F.try_element_at(letters, kind.cast("int")), F.lit("-"))
    inner = F.when(kind == SOCKET, "h").otherwise(letter)

    def bit(mask, mark):
        return F.when(m.bitwiseAND(mask) != 0, mark).otherwise("-")

    def special(mask, execute, low, high):
        on, run = m.bitwiseAND(mask) != 0, m.bitwiseAND(execute) != 0
        return (F.when(on & run, low).when(on, high).when(run, "x").otherwise("-"))

    return F.concat(
        letter, F.lit("/"), inner,
        bit(0o400, "r"), bit(0o200, "w"), special(0o4000, 0o100, "s", "S"),
        bit(0o040, "r"), bit(0o020, "w"), special(0o2000, 0o010, "s", "S"),
        bit(0o004, "r"), bit(0o002, "w"), special(0o1000, 0o001, "t", "T"))


def extension(path: Column, none_label: str = "(none)") -> Column:
    name = base_name(path)
    return (F.when(~name.contains("."), none_label)
            .otherwise(F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))))


def flat_name(path: Column) -> Column:
    trimmed = F.regexp_replace(path, "^/+|/+$", "")
    flat = F.regexp_replace(trimmed, "[^A-Za-z0-9._-]+", "_")
    return F.when(flat.isin("", ".", ".."), "root").otherwise(flat)


def safe_name(path: Column) -> Column:
    """Readable flat name plus a digest of the whole original path."""
    return F.concat(flat_name(path), F.lit("--"), F.substring(F.sha2(path, 256), 1, DIGEST_CHARS))


def unique_names(df: DataFrame, path: str = "path") -> DataFrame:
    """One distinct output name per distinct path; a clash gets an ordinal.

    Only paths whose 48-bit digest and flat form both coincide share a window
    group, so groups stay tiny however many paths come in.
    """
    names = df.select(path).distinct().withColumn("base", safe_name(F.col(path)))
    ordinal = F.row_number().over(W.partitionBy("base").orderBy(path))
    return names.withColumn("n", ordinal).select(
        path, F.when(F.col("n") == 1, F.col("base"))
        .otherwise(F.concat_ws("--", "base", F.col("n").cast("string"))).alias("name"))


def is_package_dir(name: Column) -> Column:
    """A directory named like a package: dotted, alphanumeric, not a known system one."""
    return ((~name.startswith(".")) & (~name.isin(*STOP_DIRS)) & name.contains(".")
            & name.rlike(r"^[A-Za-z0-9._]+$") & name.rlike("[A-Za-z0-9]"))


def human_bytes(size: Column) -> Column:
    """Two decimals, B to TiB by 1024, a space as thousands mark."""
    s = size.cast("double")
    step = 1024.0
    out = None
    for power, unit in enumerate(("B", "KiB", "MiB", "GiB")):
        text = F.concat(F.translate(F.format_number(s / step ** power, 2), ",", " "), F.lit(" " + unit))
        fits = F.abs(s) < step ** (power + 1)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out.otherwise(
        F.concat(F.translate(F.format_number(s / step ** 4, 2), ",", " "), F.lit(" TiB")))


def long_hex(col: Column) -> Column:
    return F.lower(F.hex(col.cast("long")))
