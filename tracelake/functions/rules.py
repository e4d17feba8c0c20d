"""First-match rule tables as generated ``CASE`` chains, and status verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.paths import base_name

# File names worth naming, in table order.
NOTABLE = {
    "accounts.db": "account transaction (removes tokens)",
    "locksettings.db": "lock state rewritten",
    "gcm_connection_infos": "push connection state",
    "gservices.db": "service state database",
    "app_screenshot": "task switcher screenshots",
    "tombstone": "process crash dump",
    "the.apk": "file written to an encrypted directory",
    "contacts2.db": "contacts database in an encrypted directory",
    "Contacts.dict": "contacts dictionary in an encrypted directory",
    "whatsapp.log": "messenger log",
    "midrive": "cloud drive database",
}
# System file categories, in test order.
CATEGORIES = ("netstats", "procstats", "klo", "tombstone", "accounts", "locksettings",
              "batterystats", "appops", "policy", "bluedroid", "usb", "fstrim", "icons",
              "debug_log", "other")
# Checker message buckets, first match wins.
MESSAGE_BUCKETS = (
    ("timestamp_pre1970", r"Timestamp\(s\).*pre-1970", "info"),
    ("extent_tree_short", r"extent tree .*could be shorter", "info"),
    ("free_blocks_count", r"Free blocks count wrong", "finding"),
    ("free_inodes_count", r"Free inodes count wrong", "finding"),
    ("directories_count", r"Directories count wrong", "finding"),
    ("unattached_inode", r"Unattached inode", "finding"),
    ("i_size_mismatch", r"i_size is .* should be", "finding"),
    ("bitmap_diff", r"bitmap differences", "finding"),
    ("unreadable", r"(?i)could not|unable to read|Error|corrupt", "critical"),
)
# Message type numbers of the two store generations.
OLDER_TYPES = {0: "text", 1: "image", 2: "audio", 3: "video", 4: "contact", 5: "location",
               8: "call", 9: "document", 10: "call_missed", 13: "gif", 16: "live_location",
               20: "sticker"}
NEWER_TYPES = {0: "text", 1: "image", 2: "audio", 3: "video", 4: "contact", 5: "location",
               7: "system", 9: "document", 10: "call", 13: "gif", 16: "call_missed",
               20: "live_location", 35: "ephemeral", 47: "view_once", 49: "reaction",
               51: "poll", 53: "album"}
# Media families each kind may carry. A kind not listed is never disputed.
KIND_FAMILIES = {
    "image": ["image"], "audio": ["audio"], "video": ["video"],
    "document": ["application", "text"], "gif": ["image"], "sticker": ["image"],
    "view_once": ["image", "video", "audio"], "contact": ["text", "vcard"],
    "location": ["", "text"], "live_location": ["", "text"], "poll": ["text", "application"],
    "reaction": ["", "text"], "deleted": [], "album": ["image", "video", "text"],
    "system": ["", "text"], "call": ["", "text"], "call_missed": ["", "text"],
    "text": ["", "text"], "ephemeral": ["", "text"],
}
SEVERITIES = ("info", "ok", "warn", "finding", "critical")


def _chain(tests: Sequence[tuple[Column, str]], otherwise) -> Column:
    out = None
    for test, label in tests:
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def tag_by_rules(path: Column, rules: Mapping[str, str] = NOTABLE) -> Column:
    """Exact base name first, then containment, both in table order; no match is null."""
    name = base_name(path)
    tests = [(name == key, text) for key, text in rules.items()]
    tests += [(path.contains(key), text) for key, text in rules.items()]
    return _chain(tests, None)


def category(path: Column, keys: Sequence[str] = CATEGORIES) -> Column:
    tests = [(path.contains(key), key) for key in keys]
    tests.append((base_name(path).startswith("tombstone"), "tombstone"))
    return _chain(tests, "other")


def message_bucket(text: Column) -> Column:
    return _chain([(text.rlike(rx), name) for name, rx, _ in MESSAGE_BUCKETS], "other")


def bucket_severity(bucket: Column) -> Column:
    return _chain([(bucket == name, level) for name, _, level in MESSAGE_BUCKETS], "warn")


def code_label(code: Column, table: Mapping[int, str]) -> Column:
    """Code to kind; a missing code is named, an unknown one stays visible."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    value = code.try_cast("int")
    return (F.when(value.isNull(), "missing")
            .otherwise(F.coalesce(F.try_element_at(F.create_map(*pairs), value),
                                  F.lit("uncatalogued"))))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def load_status(executed: Column, returncode: Column, size: Column, planned: Column) -> Column:
    """Planned, failed, partial or completed, from what is really there."""
    return (F.when(~executed, "planned").when(size.isNull(), "failed")
            .when(F.coalesce(returncode, F.lit(0)) != 0, "partial")
            .when((F.coalesce(planned, F.lit(0)) != 0) & (size != planned), "partial")
            .otherwise("completed"))


def integrity(size: Column, sha256: Column, claimed_size: Column, claimed_sha256: Column) -> Column:
    """Size is tested first; no claim, no computed hash and mismatch stay apart."""
    have = F.lower(F.trim(F.coalesce(sha256, F.lit(""))))
    want = F.lower(F.trim(F.coalesce(claimed_sha256, F.lit(""))))
    return (F.when(claimed_size.isNotNull() & ~claimed_size.eqNullSafe(size), "FAIL")
            .when((want != "") & (have == ""), "NOT_CHECKED")
            .when(want == "", "UNVERIFIED").when(have == want, "PASS").otherwise("FAIL"))
