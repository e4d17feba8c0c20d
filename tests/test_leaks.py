"""Secrets in texts against plain search, and what the audit says about what it could not read."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions.rolling import Powers, Rolling, fingerprint
from tracelake.operators import leaks


def brute(texts, secrets):
    out = []
    for i, t in texts:
        data = (t or "").encode()
        for s in {s for s in secrets if s}:
            raw, at = s.encode(), -1
            while (at := data.find(raw, at + 1)) >= 0:
                out.append((i, hashlib.sha256(raw).hexdigest(), at, len(raw)))
    return sorted(out, key=repr)


def test_fingerprints_depend_on_the_bytes_only():
    powers, data = Powers(), b"abcabc" * 40
    rolling = Rolling(data, powers)
    assert rolling.all(3)[0] == rolling.all(3)[3] == fingerprint(b"abc", powers) != rolling.all(3)[1]
    assert len(rolling.all(len(data))) == 1 and len(rolling.all(len(data) + 1)) == 0


@pytest.mark.parametrize("size", [leaks.PASS, 3])
def test_every_place_is_found(spark, monkeypatch, size):
    monkeypatch.setattr(leaks, "PASS", size)
    dice = random.Random(size)
    secrets = ["a", "ab", "p@ss-w0rd!", "two words 7", "zażółć ✓", "aaaa", "abababab", "abababa", None, "", "a", "x" * 300, "password1", "password22", "password"]
    texts = [(i, "".join(dice.choice(["ab", "a", " ", "p@ss-w0rd!", "two words 7", "zażółć ✓", "password22", "é", "\n", "x" * 301]) for _ in range(dice.randint(0, 12)))) for i in range(80)]
    texts += [(900, None), (901, ""), (902, "(p@ss-w0rd!)?pw=p@ss-w0rd!&x=1"), (902, "p@ss-w0rd!, he said"), (None, "a")]
    registry = leaks.secret_registry(spark.createDataFrame([(s,) for s in secrets], "s string"), "s")
    assert {r.sha256 for r in registry.collect()} == {hashlib.sha256(s.encode()).hexdigest() for s in secrets if s}
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, sha256 int")
    got = leaks.secret_places(df, registry, "text", ["doc_id"]).collect()
    assert sorted(map(tuple, got), key=repr) == brute(texts, secrets)
    once = leaks.secret_places(df.where("doc_id = 902"), registry, "text", ["doc_id"], every=False)
    assert once.groupBy("sha256").count().agg(F.max("count")).first()[0] <= 2


def verdicts(spark, texts, registry):
    rows = leaks.leak_audit(spark.createDataFrame(texts, "artefact string, text string"), registry, "text", "artefact").collect()
    return {r.artefact: (r.leaks, r.secrets, r.skipped, r.unchecked, r.verdict) for r in rows}


def test_verdicts(spark):
    registry = leaks.secret_registry(spark.createDataFrame([("p@ss-w0rd!",), ("never used 9",)], "s string"), "s")
    texts = [("derived", "p@ss-w0rd!, he said"), ("derived", "(p@ss-w0rd!)p@ss-w0rd!"), ("clean", "p@ss-w0rd"), ("evidence", "never used 9"), ("working", "p@ss-w0rd!"), ("holes", None), ("holes", "x"), (None, "x")]
    assert verdicts(spark, texts, registry) == {
        "derived": (2, 1, 0, 0, "FAIL: leak"), "clean": (0, 0, 0, 0, "clean"), "evidence": (1, 1, 0, 0, "excluded"),
        "working": (1, 1, 0, 0, "private mode required"), "holes": (0, 0, 1, 0, "NOT CHECKED"), None: (0, 0, 0, 0, "clean")}
    bare = registry.unionByName(spark.createDataFrame([("0" * 64, None, None, None)], leaks.REGISTRY))
    assert verdicts(spark, texts, bare)["clean"] == (0, 0, 0, 1, "NOT CHECKED")
    assert verdicts(spark, texts, registry.limit(0))["derived"][4] == "FAIL: empty registry"
    assert verdicts(spark, [("derived", "x")], registry)["derived"][4] == "clean"
