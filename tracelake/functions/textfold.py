"""ASCII folding.

The fold table follows a rule (NFKD without combining marks) and is generated when
the expression is built; only signs the rule cannot reach are listed.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and signs without a usable decomposition.
SIGNS = {
    "ł": "l", "Ł": "L",
    "─": "-", "━": "-", "│": "|", "┃": "|", "═": "=", "║": "|",
    "—": "--", "–": "-", "‒": "-", "―": "-", "−": "-",
    "‘": "'", "’": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‹": "'", "›": "'",
    "…": "...", "·": "*", "•": "*", "×": "x", "÷": "/", "±": "+/-",
    "≤": "<=", "≥": ">=", "≠": "!=", "→": "->", "←": "<-", "↔": "<>",
    "€": "EUR", "£": "GBP", "°": " deg", "©": "(c)", "®": "(r)", "§": "S", "¶": "P",
    "✓": "OK", "✔": "OK", "✗": "x", "✘": "x", "★": "*", "☆": "*",
    "☐": "[ ]", "☑": "[x]", "☒": "[x]", "➔": "->", "▪": "*",
}
# Box corners and crossings, all drawn as a plus sign.
CORNERS = "┌┐└┘├┤┬┴┼╭╮╰╯╔╗╚╝╒╕╘╛╞╡╤╧╪╫╬"


@functools.cache
def fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """(one character to one, one character to several) for the basic plane."""
    table = {}
    for code in range(0x7F, 0x10000):
        char = chr(code)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char)
                         if not unicodedata.combining(c))
        if folded and folded != char and all(" " <= c <= "~" for c in folded):
            table[char] = folded
    table.update(dict.fromkeys(CORNERS, "+"))
    table.update(SIGNS)
    one = {k: v for k, v in table.items() if len(v) == 1}
    several = {k: v for k, v in table.items() if len(v) > 1}
    return one, several


def to_ascii(text: Column, strict: bool = True) -> Column:
    """Fold to printable ASCII; what cannot be folded becomes ``?`` or is dropped."""
    one, several = fold_tables()
    spelled = F.create_map(*[F.lit(item) for pair in several.items() for item in pair])
    rest = F.lit("?" if strict else "")
    flat = F.translate(text, "".join(one), "".join(one.values()))
    whole = F.aggregate(non_ascii(flat), flat, lambda out, c: F.replace(
        out, c, F.coalesce(F.try_element_at(spelled, c), rest)))
    return F.regexp_replace(whole, "[^ -~]", "?" if strict else "")


def non_ascii(text: Column) -> Column:
    """Distinct characters that folding would change, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7e]"), F.lit(0)))


def has_non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7e]")
