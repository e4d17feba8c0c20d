"""Masking and verdicts for values that must not be shown in the clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELLIPSIS = "…"
KEEP = {"token": (8, 0), "password": (0, 2), "wifi-psk": (0, 2), "credential-hash": (0, 0),
        "secret": (0, 4)}
# Version prefixes of protected browser secrets.
PREFIXES = ("v10", "v20", "v11")
# Token shape, base64 coincidence and the fields that hold real tokens.
TOKEN_RX = r"EAA[A-Za-z0-9_\-]{40,}"
TOKEN_NOISE = "EAAAAAAQ"
TOKEN_FIELDS = ("unseen_count_access_token", "access_token", "auth_token", "token")
# Shape name to (text that must be present, pattern); the text is the cheap first test.
SHAPES = {
    "hex40": ("", r"\b[0-9a-f]{40}\b"),
    "bearer": ("EAA", TOKEN_RX),
    "oauth": ("ya29.", r"ya29\.[A-Za-z0-9_\-]{20,}"),
    "email": ("@", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
}


def shape_hits(text: Column, shapes: dict[str, tuple[str, str]]) -> Column:
    """Secret-looking strings as ``array<struct<shape, value>>``."""
    def found(shape, marker, rx):
        hits = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(0)),
                           lambda v: F.struct(F.lit(shape).alias("shape"), v.alias("value")))
        none = F.array().cast("array<struct<shape:string,value:string>>")
        return F.when(text.contains(marker), hits).otherwise(none)

    return F.concat(*[found(shape, *rule) for shape, rule in shapes.items()])


def mask(col: Column, head: int = 0, tail: int = 4) -> Column:
    """``ab…yz (26)``; short values are shown whole, empty ones stay empty."""
    n = F.length(col)
    count = F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))
    short = F.concat(F.left(col, F.lit(head)), F.lit(ELLIPSIS), F.right(col, F.lit(tail)), count)
    return (F.when(col.isNull() | (col == ""), "")
            .when(n <= head + tail, F.concat(col, count)).otherwise(short))


def mask_phone(col: Column) -> Column:
    digits = F.regexp_replace(col, "[^0-9]", "")
    tail = F.right(digits, F.lit(4))
    prefix = F.when(col.endswith(tail), F.left(col, F.length(col) - 4)).otherwise("")
    return F.when(F.length(digits) < 6, mask(col, 2, 2)).otherwise(
        F.concat(prefix, F.lit(ELLIPSIS), tail))


def mask_kind(col: Column, kind: Column | str) -> Column:
    """Mask by kind; an unknown kind is treated as a plain secret."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    out = F.when(k == "phone", mask_phone(col))
    for name, (head, tail) in KEEP.items():
        out = out.when(k == name, mask(col, head, tail))
    return out.otherwise(mask(col))


def mask_df(df: DataFrame, kinds: dict[str, str], reveal: bool = False) -> DataFrame:
    """Mask tagged columns; arrays and maps of text are masked inside."""
    if reveal:
        return df
    shape = dict(df.dtypes)

    def masked(name, kind):
        col = F.col(name)
        if shape[name].startswith("array<string"):
            return F.transform(col, lambda x: mask_kind(x, kind))
        if shape[name].startswith("map<string,string"):
            return F.transform_values(col, lambda _, v: mask_kind(v, kind))
        return mask_kind(col.cast("string"), kind)

    return df.withColumns({name: masked(name, kind) for name, kind in kinds.items()})


def secret_verdict(blob: Column) -> Column:
    """What a stored password or cookie value is: missing, empty, prefixed, plain or binary."""
    text = F.decode(blob, "ISO-8859-1")
    out = F.when(blob.isNull(), "missing").when(F.octet_length(blob) == 0, "empty")
    for prefix in PREFIXES:
        out = out.when(text.startswith(prefix), f"encrypted ({prefix})")
    return (out.when(text.rlike(r"^[ -~]+\z"), "plain text")
            .otherwise(F.concat(F.lit("binary ("), F.octet_length(blob).cast("string"), F.lit(" B)"))))


def is_noise(token: Column, field: Column) -> Column:
    """A base64 coincidence or a token in an unnamed field; a flag, never a drop."""
    return token.startswith(TOKEN_NOISE) | ~field.isin(*TOKEN_FIELDS)
