"""Hard negatives, license scan and ranked lexical search against brute force."""

import math
import random
import re

import numpy as np
import pytest

from tracelake.llm import hard_negatives, lexical, licenses

ODD = [None, "", " ", "...", "CC BY", "cc by cc by", "All rights reserved all RIGHTS  reserved", "x" * 3000, "漢字 general public license 漢", "Cc-By_4.0", "GNU General\nPublic License, version 3.", "all rights reserved"]


def brute_negatives(rows, every=50, positives=5, negatives=3, least=50, most=95, scale=256):
    taken = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            taken[i] = min(taken.get(i, (v, label)), (v, label))
    taken = {i: ([math.floor(x * scale) for x in v], label) for i, (v, label) in taken.items()}
    out = []
    for a in taken:
        if a % every:
            continue
        q, mine = taken[a]
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, label == mine) for i, (v, label) in taken.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            found = [(n, -t) for t, n, same in scored if not same and least * -s <= 100 * -t <= most * -s][:negatives]
            out += [(a, p, rank + 1, n, -s, t) for rank, (n, t) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed, scale", [(1, 256), (2, 4), (3, 256)])
def test_hard_negatives(spark, monkeypatch, seed, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "BUNDLE", 3)
    monkeypatch.setattr(hard_negatives, "SHARE", 2)
    dice = np.random.default_rng(seed)
    # One label holds a third of the rows, and one vector many of them: ties everywhere.
    common = dice.normal(0, 0.3, 8).tolist()
    rows = []
    for i in range(900):
        v = common if i % 3 == 0 else dice.normal(0, 0.3, 8).tolist()
        rows.append((i, v, int(dice.integers(0, 2)) if i % 4 else 7))
    rows += [(1000, None, 1), (1050, [None] * 8, 1), (1100, [float("nan")] * 8, 1), (1150, [0.1] * 8, None), (None, [0.1] * 8, 1), (1200, [0.0] * 8, 1),
             (1250, [float("inf")] * 8, 1), (1300, [-0.5] * 8, 1), (1350, [0.4] * 8, 99), (0, rows[1][1], 1), rows[50]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, cell string, block int")
    got = sorted(map(tuple, hard_negatives.mine(df, scale=scale).collect()))
    want = brute_negatives(rows, scale=scale)
    assert got == want and len(want) > 100


def test_hard_negatives_few_readings(monkeypatch):
    """Bounds are tested twice on 64 dimensions, whatever the number of windows (before: eight times, window by window)."""
    dice = np.random.default_rng(5)
    data = np.floor(256 * dice.normal(size=(300, 64)))
    block = hard_negatives.Columns(np.arange(300).tobytes(), np.zeros(300, np.int64).tobytes(), np.ascontiguousarray(data.T).tobytes())
    tested = []
    joined = hard_negatives.joined
    monkeypatch.setattr(hard_negatives, "joined", lambda low, high: tested.append(len(low)) or joined(low, high))
    places = np.arange(0, 300, 3)
    for a, part in hard_negatives.firsts(block, data, places):
        scores = data @ data[a]
        high = np.sort(scores)[[-2, -9, -30, -60, -90]].astype(np.int64)
        alive, found = hard_negatives.scan(block, int(a), data[a], np.delete(np.arange(300), a), high // 2, high, 3, part)
        assert found.tolist() == scores[alive].tolist()
        for top in high:
            inside = [i for i in np.lexsort((np.arange(300), -scores)) if i != a and top // 2 <= scores[i] <= top][:3]
            assert set(inside) <= set(alive.tolist())
    assert len(tested) == 2 * len(places)
    assert hard_negatives.joined(np.array([5.0, 1.0, 9.0]), np.array([7.0, 5.0, 8.0])) == [(1.0, 7.0)]


def test_hard_negatives_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1)], schema)).count() == 0
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 1.0], 2), (3, [1.0, 1.0], 2), (50, [1.0, 0.0, 0.0], 2)]
    assert [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, schema)).collect()] == [(0, 1, 1, 2, 65536, 49152)]


def test_scan_keeps_the_best_of_each_window():
    dice = np.random.default_rng(5)
    for _ in range(50):
        data = dice.integers(-9, 10, (40, 6)).astype(np.float64)
        block = hard_negatives.Columns(np.arange(40).tobytes(), np.zeros(40, np.int64).tobytes(), np.ascontiguousarray(data.T).tobytes())
        q = dice.integers(-9, 10, 6).astype(np.float64)
        low, high = np.array([5, -50]), np.array([60, 20])
        alive, scores = hard_negatives.scan(block, -1, q, np.arange(1, 40), low, high, 3)
        exact = data @ q
        assert (exact[alive] == scores).all()
        for a, b in zip(low, high):
            want = sorted((i for i in range(1, 40) if a <= exact[i] <= b), key=lambda i: (-exact[i], i))[:3]
            assert alive[hard_negatives.cut(alive, scores.astype(np.int64), a, b, 3, 99)].tolist() == want


def brute_lexical(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(i, cut(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    total, length = len(held), sum(len(w) for _, w in held)
    chosen = {}
    for i, t in items:
        if i is not None and t is not None:
            chosen[i] = min(chosen.get(i, t), t)
    out = []
    for item, text in chosen.items():
        found = []
        for doc, words in held:
            score, m = 0, 10 + 90 * len(words) * total // length
            for t in set(cut(text)):
                if tf := words.count(t):
                    df = sum(t in w for _, w in held)
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, items", [(lexical.BLOCK, lexical.ITEMS), (7, 60)])
def test_lexical_search(spark, monkeypatch, block, items):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ITEMS", items)
    monkeypatch.setattr(lexical, "STEP", 2)
    dice = random.Random(block)
    words = ["the", "of", "and", "é", "日本", "A1"] + ["".join(dice.choice("abcd") for _ in range(3)) for _ in range(80)]
    text = lambda n: "-".join(dice.choice(words[:6] if dice.random() < .5 else words) for _ in range(n))
    docs = [(i, text(dice.randint(0, 60))) for i in range(150)] + [(900 + i, t) for i, t in enumerate(ODD)] + [(5, "the same"), (5, "the same"), (None, "of of abc"), (None, "of of abc")]
    docs += [(2000 + i, "the common line of all") for i in range(40)]
    asked = [(i, text(dice.randint(1, 90))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (None, "the"), (3, "the"), (53, " ".join(words)), (54, "The THE the")]
    got = lexical.search(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int"),
                         spark.createDataFrame([(*a, 1.0) for a in asked], "item_id long, text string, score double"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lexical(docs, asked)


def test_lexical_search_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (spark.createDataFrame([(1, None)], "doc_id long, text string"), items)):
        assert lexical.search(d, i).count() == 0


def test_masks_are_left_out_only_below_the_floor():
    dice = np.random.default_rng(8)
    held = [np.array(sorted((int(t), int(dice.integers(1, 4))) for t in dice.choice(70, dice.integers(1, 40), replace=False)), np.int64).tobytes() for _ in range(600)]
    block = lexical.Block(np.arange(600), np.zeros(600, bool), dice.integers(40, 300, 600), held, np.arange(1, 71) * 50, (600, 100_000))
    few = lexical.Kept(10)
    scored = lexical.take(block, np.arange(66, 70), 70, few)
    every = lexical.Kept(10)
    asked = np.zeros(70, np.int64)
    asked[66:70] = 1
    every.add(block.scores(np.arange(600), asked), block.ids, block.null)
    assert few.id.tolist() == every.id.tolist() and few.score.tolist() == every.score.tolist() and scored < 300


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(label, i) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
              for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places, key=lambda p: (p[1], p[0]))


def brute_detections(given, line):
    """Every rule tried on every text, and suppression pair by pair in falling priority."""
    found = [(m.start(), m.end(), i) for i, rule in enumerate(given) for m in rule.pattern.finditer(line)]
    kept = []
    for s, e, i in sorted(found, key=lambda d: (-given[d[2]].priority, d[0], -d[1], d[2])):
        def loses(a, b, j):
            if given[j].priority == given[i].priority:
                return a <= s and e <= b
            return (a <= s and e <= b) or (s <= a and b <= e)
        if not any(loses(*k) for k in kept):
            kept.append((s, e, i))
    return sorted(kept)


NOTICES = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "GNU GPLv3 or later", "LGPL-2.1", "All rights reserved.",
           "This work is licensed under the GNU General Public License, version 3.", "Redistribution and use in source and binary forms, with or without modification, are permitted",
           "either version 2 of the License, or (at your option) any later version", "public domain", "see the license file", "Creative Commons Attribution-ShareAlike 4.0 International License", "Copyright (c) 2019",
           "SPDX-License-Identifier: MIT", "to endorse or promote products", "mit freundlichen Grüßen", "commit", "© 2020"]


def test_rules_and_suppression():
    tool = licenses.scanner()
    assert len(tool.rules) > 200
    dice = random.Random(4)
    for _ in range(300):
        text = " ".join(dice.choice(NOTICES) if dice.random() < .7 else "of it" for _ in range(dice.randint(0, 12)))
        line, _ = licenses.reduced(text)
        assert [(d.start, d.end, d.rule) for d in tool.kept(tool.detections(line))] == brute_detections(tool.rules, line)


def test_every_rule_can_be_met():
    # A pattern can only match where its keyword stands: the keyword's own words must pass the gate.
    tool = licenses.scanner()
    for i, rule in enumerate(tool.rules):
        assert i in tool.gated(rule.keyword.removesuffix("*")), rule


@pytest.mark.parametrize("text, labels", [
    (NOTICES[0], ["apache-2.0"]), (NOTICES[1], ["mit"]), (NOTICES[2], ["cc-by-nc-4.0"]), (NOTICES[3], ["gpl-3.0"]), (NOTICES[4], ["lgpl-2.1"]), (NOTICES[5], ["reserved"]),
    (NOTICES[6], ["gpl-3.0"]), (NOTICES[7], ["bsd"]), (NOTICES[9], ["public-domain"]), (NOTICES[11], ["cc-by-sa"]), (NOTICES[13], ["mit"]), (NOTICES[15], []), ("a commit of bsd games", []),
])
def test_labels_of_notices(text, labels):
    assert [f[0] for f in licenses.scanner().scan(text)[2]] == labels


def test_license_scan(spark):
    rows = [(i, t, "old", 1.5) for i, t in enumerate(ODD + NOTICES)] * 2 + [(None, "CC BY", "old", 1.5), (77, "word " * 200_000 + "cc by", "old", 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string, weight double")
    got = licenses.scan(df)
    assert got.columns == ["doc_id", "text", "weight", "n_words", "base_places", "found", "score"]
    rows_got = got.collect()
    assert len(rows_got) == len(rows)
    for r in rows_got:
        assert (r.n_words, [(b.label, b.first_word) for b in r.base_places]) == brute_base(r.text)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.base_places or r.found)
    long = next(r for r in rows_got if r.doc_id == 77)
    assert long.n_words == 200_002 and [tuple(b) for b in long.base_places] == [("cc-by", 200_000)]
    assert licenses.scan(df.limit(0)).count() == 0
