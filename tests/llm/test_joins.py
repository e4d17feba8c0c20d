"""Near duplicates, passages, repeated strings, searches and the pipeline against brute force."""

import hashlib
import random
import sys
import time
import types
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import common, dealing, ngram_join, passages, suffix_dedup, topk, tree_index
from tracelake.llm.common import sift
from tracelake.llm.components import components
from tracelake.llm.shingles import shingle_set


def prose(dice, n, alphabet="aeiorstn"):
    return ["".join(dice.choice(alphabet) for _ in range(dice.randint(2, 6))) for _ in range(n)]


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    dice = random.Random(4)
    pairs = [(dice.randint(0, 200), dice.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots({n for p in pairs for n in p}, pairs)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(sets, pairs)
    return sorted((i, len(s), root[i]) for i, s in sets.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_finds_every_link(spark, seed):
    dice = random.Random(seed)
    bases = [prose(dice, dice.randint(20, 120)) for _ in range(6)]
    hot = prose(dice, 100)
    rows = []
    for i in range(160):
        words = list(hot if i % 3 == 0 else dice.choice(bases))
        for _ in range(dice.choice([0, 0, 1, 2, 3, 5])):
            at = dice.randrange(len(words))
            words[at:at + dice.randint(0, 2)] = prose(dice, dice.randint(0, 2))
        rows.append((i, (" " if i % 2 else "\t").join(words)))
    rows += [(900 + i, t) for i, t in enumerate([None, "", " \n", "one", "One", "two words", "a b c d e", "a b c d", "x " * 3000, rows[0][1].upper(), "eÉ f"])]
    got = ngram_join.link(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int"))
    assert sorted(map(tuple, got.collect())) == brute_links(rows)


def test_ngram_join_blocks_of_one_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    dice = random.Random(9)
    base = prose(dice, 80)
    rows = []
    for i in range(90):
        words = list(base)
        for at in dice.sample(range(80), dice.randint(0, 5)):
            words[at] = prose(dice, 1)[0]
        rows.append((i, " ".join(words)))
    assert sorted(map(tuple, ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_links(rows)


def test_ngram_join_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (7, None), (None, None), (None, "alone here"), (8, "k l m n o p q r s t"), (None, "k l m n o p q r s t u")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.link(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 1), (7, 0, 7), (None, 0, None), (None, 1, None), (8, 6, 8), (None, 7, 8)], key=repr)
    assert ngram_join.link(df.limit(0)).count() == 0


def test_prefix_asks_for_more_where_shingles_are_frequent():
    found = np.arange(1, 101, dtype=np.uint64)
    plain, asks = ngram_join.prefix(found, np.zeros(0, np.uint64), np.zeros(0, np.int64), 75, 100)
    assert (len(plain), asks) == (26, 1)
    longer, more = ngram_join.prefix(found, found, np.full(100, 1000), 75, 100)
    assert more > 1 and len(longer) == 26 + more - 1


def brute_repeats(rows, k):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        seen.update(b[a:a + k] for a in range(len(b) - k + 1))
    out = []
    for i, b in raws:
        mask = bytearray(len(b))
        for a in range(len(b) - k + 1):
            if seen[b[a:a + k]] > 1:
                mask[a:a + k] = b"\1" * k
        kept = bytes(x for x, m in zip(b, mask) if not m)
        out.append((i, len(b), sum(mask), sum(1 for j, m in enumerate(mask) if m and not (j and mask[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_cover_is_perfect():
    for p in (2, 3, 5, 7, 13):
        v, found = suffix_dedup.cover(p)
        assert v == p * p + p + 1 and len(found) == p + 1 and {(a - b) % v for a in found for b in found} == set(range(v))


@pytest.mark.parametrize("k, p", [(40, 5), (31, 5), (60, 7)])
def test_suffix_dedup(spark, k, p):
    dice = random.Random(k)
    base = ["".join(dice.choice("abcdeé ") for _ in range(dice.randint(30, 400))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(dice.randint(0, 4)):
            b = dice.choice(base)
            a = dice.randint(0, len(b))
            text += b[a:dice.randint(a, len(b))] if dice.random() < .7 else "".join(dice.choice("abcdeé ") for _ in range(dice.randint(0, 120)))
        rows.append((i, text if dice.random() < .95 else None))
    rows += rows[:3] + [(99, "ab" * 300), (98, "x" * 500), (97, ""), (None, "y" * k), (96, "z" * (k - 1))]
    df = spark.createDataFrame([(*r, b"") for r in rows], "doc_id long, text string, kept binary")
    got = suffix_dedup.dedup(df, k, p).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows, k)
    assert suffix_dedup.dedup(df.limit(0), k, p).count() == 0


def test_passages(spark):
    dice = random.Random(6)
    shared, edited = prose(dice, 60), prose(dice, 80)
    near = list(edited)
    near[40] = "changed"
    rows = [(i, " ".join(prose(dice, 100))) for i in range(20)]
    rows += [(20 + i, " ".join(prose(dice, 30) + shared + prose(dice, 30))) for i in range(12)]
    rows += [(40, " ".join(prose(dice, 5) + edited)), (41, " ".join(near + prose(dice, 9))), (42, " ".join(shared[:49])), (50, None), (51, ""), (52, " ")]
    rows += [(60, " ".join(shared + prose(dice, 70) + shared)), (60, "other text of the same id"), (None, " ".join(prose(dice, 10)))]
    df = spark.createDataFrame([(*r, "c") for r in rows] * 2, "doc_id long, text string, uid2 string")
    got = passages.find(passages.identified(df)).collect()
    hit = defaultdict(set)
    for r in got:
        hit[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
        assert r.kept_doc_id in range(20, 32) or (r.doc_id, r.kept_doc_id) in ((41, 40), (60, 60))
    assert set(hit) == {*range(21, 32), 41, 60}
    assert all(hit[i] == set(range(30, 90)) for i in range(21, 32)) and set(range(130, 190)) <= hit[60] and set(range(60)) <= hit[60]
    assert hit[41] >= set(range(0, 80)) - set(range(36, 45))
    cut = passages.remove(df).collect()
    assert len(cut) == len(rows) * 2
    texts = {r.doc_id: r.text for r in cut if r.doc_id != 60}
    assert " ".join(shared) in texts[20] and all(not set(shared[5:9]) <= set(texts[i].split()) for i in range(21, 32))
    assert all(texts[i] == t for i, t in rows if i in range(20) or i in (40, 42, 50, 51, 52))
    assert passages.find(passages.identified(df.limit(0))).count() == 0


def test_passages_of_the_stated_similarity_are_all_found(spark):
    dice = random.Random(12)
    rows, want = [], {75: set(), 80: set(), 85: set()}
    for i in range(3000):
        base = prose(dice, 50)
        near = list(base)
        for _ in range(2):
            at = dice.choice([dice.randint(0, 4), dice.randint(45, 49), dice.randrange(50)])
            near[at:at + 1] = prose(dice, 1)
        rows += [(i, " ".join(prose(dice, 10) + base + prose(dice, 10))), (10000 + i, " ".join(prose(dice, 9) + near + prose(dice, 11)))]
        y, x = (passages.fingerprints(passages.words(t)[0], 5) for _, t in rows[-2:])
        # Texts of different pairs have nothing in common.
        level = max((level for level in want if passages.matches(x, y, -1, 46, level, 100)), default=None)
        if level:
            want[level].add((10000 + i, i))
    got = {(r.doc_id, r.kept_doc_id) for r in passages.find(passages.identified(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for level, pairs in want.items():
        print(f"similarity from {level}: {len(pairs & got)} of {len(pairs)} found")
    assert all(want.values()) and set().union(*want.values()) == got


@pytest.mark.parametrize("common", [20, 30, 40])
def test_passages_around_a_frequent_line(spark, common):
    dice = random.Random(common)
    line = prose(dice, common)
    rows = [(i, " ".join(prose(dice, 40) + line + prose(dice, 40))) for i in range(400)]
    for i in range(40):
        left = dice.randint(0, 50 - common)
        twice = prose(dice, left) + line + prose(dice, 50 - common - left)
        rows += [(5000 + 10 * dice.randint(0, 90) + k * 1000, " ".join(prose(dice, 40) + twice + prose(dice, 40))) for k in (0, 1)]
    # Ids are dealt anew so that no copy stands beside its original.
    ids = dice.sample(range(len(rows)), len(rows))
    rows = [(n, t) for n, (_, t) in zip(ids, rows)]
    found = {r.doc_id for r in passages.find(passages.identified(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found == {max(rows[400 + 2 * i][0], rows[401 + 2 * i][0]) for i in range(40)}


def pairs_found(spark, rows):
    return {(r.doc_id, r.kept_doc_id) for r in passages.find(passages.identified(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}


def test_passages_made_of_frequent_lines(spark):
    dice = random.Random(31)
    lines, rows = [prose(dice, 24), prose(dice, 23)], []
    for i in range(40):
        for k in (0, 1):
            own = [f"a{i}", f"b{i}", f"c{i}k{k}"]
            rows.append((i + 100 * k, " ".join(prose(dice, 20) + lines[0] + own + lines[1] + prose(dice, 20))))
    assert pairs_found(spark, rows) == {(i + 100, i) for i in range(40)}


def test_passages_whose_edits_break_one_shingle_each(spark):
    dice = random.Random(32)
    rows = []
    for i in range(1000):
        parts, last = [(prose(dice, 5), prose(dice, 1)) for _ in range(6)], prose(dice, 2)
        for k in (0, 1):
            text = [w for own, again in parts for w in own + again * (4 - k)] + last
            rows.append((i + 1000 * k, " ".join(prose(dice, 20) + text + prose(dice, 20))))
    assert pairs_found(spark, rows) == {(i + 1000, i) for i in range(1000)}


def test_compact_windows_cover_every_long_subsequence():
    dice = np.random.default_rng(1)
    for n in (0, 4, 5, 40):
        values = dice.integers(0, 20, n).astype(np.uint64) << np.uint64(40)
        found = list(zip(*passages.compact_windows(values, 5)))
        for i in range(n):
            for j in range(i + 4, n):
                c = i + int(values[i:j + 1].argmin())
                assert sum(l <= i <= m <= j <= r for l, m, r in found) == 1 and any(m == c and l <= i and j <= r for l, m, r in found)


def vectors(spark, count=700, d=6, seed=1):
    dice = np.random.default_rng(seed)
    data = dice.normal(size=(count, d)).round(3)
    data[count // 3: 2 * count // 3] = data[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(1000, None), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] * d), (1060, [float("inf")] * d), (1100, [0.0] * d), (1200, [1.0]), (None, rows[0][1]), (5, rows[5][1])]
    return spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, score string"), np.array([np.float32(r[1]) for r in rows], np.float64)


def test_top_k_is_exact(spark):
    df, data = vectors(spark)
    got = sorted(map(tuple, topk.top_k(df, k=7, every=20).collect()))
    data = np.vstack([data, np.zeros((1, 6))])
    ids = np.append(np.arange(700), 1100)
    whole = np.floor(64 * data)
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = whole @ whole[q]
        order = [j for j in np.lexsort((ids, -scores)) if j != q][:7]
        want += [(int(ids[q]), n + 1, int(ids[j]), int(scores[j])) for n, j in enumerate(order)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    few = topk.top_k(df.where("vec_id < 3"), k=7, every=1).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(q, n) for q in range(3) for n in (1, 2)]
    assert topk.products(np.full((1, 2), 2.0 ** 40), np.full((1, 2), 2.0 ** 15 + 1)).tolist() == [[2 * 2 ** 40 * (2 ** 15 + 1)]]


def test_tree_search_recall(spark):
    df, data = vectors(spark, 3000, 8, 5)
    df = df.where("vec_id < 1000 or vec_id > 1250 or size(embedding) = 8")
    got = defaultdict(list)
    for r in tree_index.search(df, k=5, every=50, leaf_rows=20, sample_rows=1500).collect():
        got[r.query_id].append(r)
    hit = 0
    for q in range(0, 3000, 50):
        distance = np.sqrt(((data - data[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(3000), distance)) if j != q][:5]
        hit += len({int(j) for j in order} & {r.vec_id for r in got[q]})
        rows = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows == sorted(rows, key=lambda r: (r.score, r.vec_id))
        assert all(abs(r.score - distance[r.vec_id]) < 1e-12 for r in rows)
    assert hit >= 0.9 * 5 * 60
    assert tree_index.search(df.limit(0)).count() == 0
    assert tree_index.search(df.where("vec_id = 0 or vec_id = 1"), every=1).count() == 2


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "passages", "surrogates", "packing"]
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        if name == "near duplicates":
            root = {r[0]: r[2] for r in brute_links([(r.doc_id, r.text) for r in docs.collect()])}
            assert {r.doc_id for r in kept.collect()} == set(root.values())
        else:
            assert kept.count() == docs.count()
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_shingle_words():
    assert len(shingle_set("A b\x0bc\td E")) == 1 and (shingle_set("A b c d E") == shingle_set("a\nB C\x0cD e")).all()
    assert len(shingle_set("É b")) == 1 and (shingle_set("É b") != shingle_set("é b")).all() and len(shingle_set(None)) == 0


def test_other_columns_stay_whatever_their_names(spark):
    dice = random.Random(12)
    shared = " ".join(prose(dice, 90))
    rows = [(i, f"{' '.join(prose(dice, 40))} {shared} {' '.join(prose(dice, 40))}", 7, "c", 1.5, i) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int, cuts string, `odd name` double, kept_uid long")
    got = passages.remove(df)
    assert got.columns == df.columns
    found = sorted(map(tuple, got.collect()))
    assert [r[2:] for r in found] == [r[2:] for r in rows] and [shared in r[1] for r in found] == [True, False, False]
    df = df.toDF("doc_id", "text", "copied", "cut", "cut_spans", "text_key").withColumn("copies", F.lit(3)).withColumn("ranges", F.lit("r"))
    got = suffix_dedup.dedup(df, 60, 5)
    assert got.columns == [*df.columns, "kept", "n_bytes", "n_removed", "spans"]
    found = sorted(tuple(r)[:8] for r in got.collect())
    assert found == sorted((*r, 3, "r") for r in rows) and got.where("n_removed > 0").count() == 3


def test_one_document_of_each_group_stays(spark):
    dice = random.Random(21)
    bases = [prose(dice, 60) for _ in range(5)]
    near = lambda words: " ".join([*words[:30], *prose(dice, 1), *words[31:]])
    texts = [near(dice.choice(bases)) for _ in range(40)]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    rows += [(None, near(bases[0])), (None, "alone " * 9), (None, "alone " * 9), (7, "one " * 8), (7, "two " * 8), (50, " ".join(prose(dice, 30))), (3, ""), (3, ""), (None, None), (9, " ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = corpus_pipeline.different(spark, df, "")
    assert got.columns == df.columns
    # Brute force: rows by number, linked by their sets; of each group the smallest id stays.
    numbered = {i: r for i, r in enumerate(rows)}
    root = {i: c for i, _, c in brute_links([(i, t) for i, (_, t) in numbered.items()])}
    groups, want = defaultdict(list), []
    for i, (doc, text) in numbered.items():
        if (text or "").split():
            groups[root[i]].append((doc is None, doc or 0, i))
        else:
            want.append((doc, text))
    ids = sorted((min(g)[1] if not min(g)[0] else -1) for g in groups.values())
    kept = [tuple(r)[:2] for r in got.collect()]
    assert sorted(r[0] if r[0] is not None else -1 for r in kept if (r[1] or "").split()) == ids
    assert sorted((r for r in kept if not (r[1] or "").split()), key=repr) == sorted(want, key=repr)


def test_ngram_join_verifies_few_pairs_of_a_group(spark, monkeypatch):
    dice = random.Random(9)
    rows = []
    for _ in range(3):
        base = prose(dice, 80)
        for _ in range(70):
            words = list(base)
            for at in dice.sample(range(80), dice.randint(1, 2)):
                words[at] = prose(dice, 1)[0]
            rows.append((len(rows), " ".join(words)))
    counts, verified = [], ngram_join.verified

    def counted(pairs, *others):
        counts.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(ngram_join, "verified", counted)
    assert sorted(map(tuple, ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_links(rows)
    assert sum(counts) < 7 * len(rows)


def test_pipeline_stages_send_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(name)))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("last", lambda spark, docs, sf_dir: docs)])
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < seen[0] <= 2500 and spark.conf.get(name) == before


def test_texts_take_one_worker_a_task(spark):
    """A sieve and what is made of its rows run in one Python worker (before: two in a chain, each with tables of its own)."""
    docs = spark.createDataFrame([(i, f"{i % 7} " + "a b c d e f g h " * 9) for i in range(40)], "key long, text string")
    keys = docs.where("key < 9").select("key")
    sets = sift(docs, "key", keys, ngram_join.whole_sets(5), ngram_join.SETS)
    seeds = passages.seeds(46, 5, 3, 3)
    rows = docs.selectExpr("key AS doc_id", "key AS uid", "text")
    posted = ngram_join.several(rows, seeds, passages.SEEDS)
    for one in (sets, posted):
        assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sets.select("class").distinct().count() == 7
    plain = rows.mapInArrow(seeds, passages.SEEDS)
    held = plain.groupBy("shingle").count().where("count > 1").select("shingle")
    assert sorted(map(tuple, posted.join(held, "shingle", "left_semi").collect())) == sorted(map(tuple, plain.join(held, "shingle", "left_semi").collect()))
    assert posted.count() >= plain.join(held, "shingle", "left_semi").count() > 0


def test_worker_tables_of_other_stages_go(monkeypatch):
    holder = types.ModuleType("own")
    monkeypatch.setitem(sys.modules, common._OWN, holder)
    monkeypatch.setattr(common, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(stageId=lambda: stage)))
    stage, built = 1, []
    make = lambda name: common.worker_table(name, lambda: built.append(name) or name)
    assert [make("a"), make("b"), make("a")] == ["a", "b", "a"] and built == ["a", "b"]
    stage = 2
    assert make("b") == "b" and sorted(holder.tables) == ["a", "b"]
    assert make("c") == "c" and sorted(holder.tables) == ["b", "c"]
    assert make("a") == "a" and built == ["a", "b", "c", "a"]


def test_pipeline_stages_write_in_small_batches(spark, monkeypatch):
    """A stage that is called by itself sends its texts in small batches too."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df: seen.append(int(spark.conf.get(name))) or df)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus_pipeline.good(spark, docs, "/root/testdata/sf0.001")
    corpus_pipeline.own_passages(spark, docs.limit(5), "/root/testdata/sf0.001")
    assert len(seen) == 2 and max(seen) <= 2500 and spark.conf.get(name) == before


def test_pairs_behind_one_another_match_as_single_ones():
    """Pairs checked many at a time give the near copies that each gives alone; others cost no call of their own."""
    dice, sides, alone = np.random.default_rng(3), ([], [], []), []
    for _ in range(400):
        x = dice.integers(0, 10 ** int(dice.integers(1, 6)), int(dice.integers(0, 180))).astype(np.uint64)
        offset = int(dice.integers(-15, 15))
        y = np.append(x[max(0, offset):], dice.integers(0, 50, int(dice.integers(0, 40))).astype(np.uint64))
        y = np.delete(y, dice.integers(0, len(y), int(dice.integers(0, 12)))) if len(y) else y
        for side, value in zip(sides, (x, y, offset)):
            side.append(value)
        alone.append(passages.matches(x, y, offset, 46, 75, 100))
    n, m = (np.array([len(v) for v in side]) for side in sides[:2])
    same, place = passages.aligned(np.concatenate(sides[0]), n, np.concatenate(sides[1]), m, np.array(sides[2]))
    found, ends = [i for i in passages.hopeful(same, n, 46, 75, 100).tolist() if m[i] >= 46], np.cumsum(n)
    assert 20 < len(found) < 300 and found == [i for i, a in enumerate(alone) if a]
    for i in found:
        part = slice(ends[i] - n[i], ends[i])
        assert passages.copies(same[part], place[part], 46, 75, 100) == alone[i]


def test_ngram_join_compares_whole_lists_by_sets(spark, monkeypatch):
    dice = random.Random(41)
    base, rows = prose(dice, 90), []
    for i in range(300):
        words = list(base)
        for at in dice.sample(range(90), dice.randint(2, 3)):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    counts, verified = [], ngram_join.verified

    def counted(pairs, *others):
        counts.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(ngram_join, "verified", counted)
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    assert sorted(map(tuple, ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_links(rows)
    assert sum(counts) < 10 * len(rows)


def test_shuffle_files_go_when_a_table_is_stored(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(name, None)
    rows = common.stored(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).agg(F.collect_list("id").alias("l")).repartition(7, "k"))
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(name, None) == setting and rows.count() == 50


def test_ngram_join_makes_rows_of_shared_shingles_only(spark, monkeypatch):
    """However full a sieve of fixed size would be, no shingle of a single prefix becomes a row."""
    dice = random.Random(51)
    rows = [(i, " ".join(prose(dice, 120))) for i in range(200)]
    rows += [(200 + i, " ".join(rows[i][1].split()[:115])) for i in range(20)]
    counts, stored = [], ngram_join.stored

    def counted(df, **others):
        out = stored(df, **others)
        if {"shingle", "class"} <= set(out.columns) and "bits" not in out.columns:
            counts.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    monkeypatch.setattr(ngram_join, "SIEVE", 17)
    assert sorted(map(tuple, ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_links(rows)
    assert counts and 20 <= max(counts) < 20 * 100


def test_records_dealt_in_parts(spark, monkeypatch):
    """Every record comes back, all of one key in one segment, whatever a task gathers at once."""
    monkeypatch.setattr(dealing, "GATHERED", 100)
    rows = spark.range(5000).selectExpr("id", "id % 700 AS key")
    kinds = [np.int64, np.int64, np.uint16]

    def made(batches):
        for batch in batches:
            number, key = (batch.column(i).to_numpy() for i in (0, 1))
            yield key.astype(np.uint64) << np.uint64(52), -number, key, key

    def then(found):
        for i, (number, key, short) in enumerate(found):
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(key), pa.array(short.astype(np.int64)), pa.array(np.full(len(key), i))], names=["n", "key", "short", "part"])

    dealt = rows.mapInArrow(dealing.parts(made, kinds, 9), dealing.PARTS)
    got = dealing.grouped(dealt, kinds, then, "n long, key long, short long, part long").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((-r.n, r.key, r.short) for r in got) == [(i, i % 700, i % 700) for i in range(5000)]
    assert len({(r.key, r.task, r.part) for r in got}) == 700 and [dealing.segments(n) for n in (0, 1 << 28, 1 << 30, 1 << 40)] == [8, 9, 11, 16]


def test_passages_of_repeated_words_are_not_all_compared(spark, monkeypatch):
    """Words that repeat in many texts are compared only where a copy is possible; a copy made of them is found."""
    rows = []
    for i in range(150):
        rows.append((i, " ".join([f"a{i}"] * 25 + ["the"] * (20 + i % 9) + [f"b{i}"] * 25 + ["of"] * (20 + i % 8) + [f"c{i}"] * 25)))
    for i in range(4):
        rows += [(1000 + 10 * k + i, " ".join([f"d{i}k{k}"] * 20 + ["the"] * (21 + i) + [f"e{i}"] * 8 + ["of"] * 21 + [f"f{i}k{k}"] * 20)) for k in (0, 1)]
    counts, stored = [], passages.stored

    def counted(df, **others):
        out = stored(df, **others)
        if "kept_low" in out.columns:
            counts.append(out.count())
        return out

    monkeypatch.setattr(passages, "stored", counted)
    assert pairs_found(spark, rows) >= {(1010 + i, 1000 + i) for i in range(4)}
    assert 0 < sum(counts) < 40 * len(rows)


def test_long_grams_by_sums():
    codes = np.random.default_rng(2).integers(0, 3, 3000).astype(np.uint64)
    got, want = passages.rolled(codes, 6), passages.fingerprints(codes, 6)
    assert len(got) == len(want) and len(set(got.tolist())) == len(set(want.tolist())) == len(set(zip(got.tolist(), want.tolist())))


def test_places_that_cover_a_repeated_shingle():
    """A place may match shingles at offsets up to 8 away, so one place covers 33 of a text that moves, whatever stands before it."""
    codes = np.random.default_rng(8).integers(0, 1 << 62, 400).astype(np.uint64)
    codes[[0, 399]], codes[[30, 31, 32, 90]] = codes[5], codes[30]
    texts, none = np.ones(400, np.int64), np.zeros(400, bool)
    found, asks, need, _, _, cover, has, _ = passages.asked(codes, np.array([0]), np.array([393]), none, texts, 46, 6, 6)
    assert found.tolist() == list(range(400)) and asks.any() and need[asks].max() <= 1
    assert cover[399] == cover[100] == 33 and cover[0] == 17 + 5 + 16 and cover[30] == 17 + 1 + 1 + 17 + 16 and has[0] and not has[200]
