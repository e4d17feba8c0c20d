"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identity parameters seen in addresses. A hint, not a confirmed identity.
HINTS = {
    "story_fbid": r"story_fbid=(\d+)",
    "ft_ent_identifier": r"ft_ent_identifier=([\w]+)",
    "profile_id": r"[?&]id=(\d+)",
    "post_id": r"/posts/(\d+)",
    "viewer_av": r"[?&]av=(\d+)",
    "viewer_lst": r"[?&]lst=([^&]+)",
    "page_id": r"/(?:pg|page)/([\w]+)",
}
HINT_MARKERS = ("av=", "lst=", "story_fbid", "ft_ent_identifier")
STAMP_FROM, STAMP_TO = 946_684_800, 4_102_444_800
SESSION_COOKIES = ("xs", "c_user", "datr", "sb", "ss", "fr", "wd")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def url_hints(url: Column) -> Column:
    """Identifiers visible in an address as ``map<string,string>``; absent ones left out."""
    text = F.coalesce(url, F.lit(""))
    values = {name: F.regexp_extract(text, rx, 1) for name, rx in HINTS.items()}
    pieces = F.split(values["viewer_lst"], ":")
    whole = (F.size(pieces) == 3) & F.get(pieces, 0).rlike(r"^\d+$")
    for i, name in enumerate(("viewer_uid", "author_uid", "story_ts")):
        values[name] = F.when(whole, F.get(pieces, i)).otherwise("")
    entries = [item for name, value in values.items() for item in (F.lit(name), value)]
    return F.map_filter(F.create_map(*entries), lambda _, v: v != "")


def may_hint(url: Column) -> Column:
    """Cheap prefilter in front of the seven patterns."""
    test = url.contains(HINT_MARKERS[0])
    for marker in HINT_MARKERS[1:]:
        test = test | url.contains(marker)
    return test


def query_map(url: Column) -> Column:
    """Query parameters; blank values are dropped and the first value of a name wins."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("=."))
    entries = F.transform(pairs, lambda p: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
        F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(
        keys, lambda k: F.get(F.filter(entries, lambda e: e["k"] == k), 0)["v"]))


def decode_session_cookie(value: Column) -> Column:
    """``prefix:key:version:stamp:…`` with an optional numeric prefix below 1000."""
    parts = F.split(F.coalesce(F.try_url_decode(value), value, F.lit("")), ":")
    usable = F.size(parts) >= 3
    first = F.get(parts, 0)
    prefix = F.when(first.rlike(r"^\d{1,9}$"), first.try_cast("int"))
    prefixed = usable & F.coalesce(prefix < 1000, F.lit(False))
    rest = F.when(usable, F.when(prefixed, F.slice(parts, 3, F.size(parts)))
                  .otherwise(F.slice(parts, 2, F.size(parts))))
    whole = F.filter(rest, lambda x: x.rlike(r"^-*\d{1,18}$"))
    stamps = F.filter(F.transform(whole, lambda x: x.try_cast("long")),
                      lambda n: (F.abs(n) > STAMP_FROM) & (F.abs(n) < STAMP_TO))
    version = F.when((F.size(rest) > 1) & F.get(rest, 0).rlike(r"^\d{1,9}$"),
                     F.get(rest, 0).try_cast("int"))
    return F.struct(
        F.size(parts).alias("fields"), F.when(prefixed, prefix).alias("prefix"),
        F.when(prefixed, F.get(parts, 1)).when(usable, first).alias("session_key"),
        F.get(stamps, 0).alias("issued_unix"), version.alias("signature_version"))
