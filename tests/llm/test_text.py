"""Tokens, packing, pages, quality and surrogates against brute force and round trips."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import bpe, html_text, packing, quality, surrogates

ODD = [None, "", " ", "\n\t ", "a", "it's we'll  they'RE  ", "x" * 5000, "漢字 🙂 é́ �", "<|endoftext|> a<|endoftext|>", "1234567890 ½ ²",
       "  a 　b", "\x00\x1f", "éa" * 300]


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def automaton(vocabulary):
    return bpe.Automaton(bpe.definition(vocabulary), bpe.categories())


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_automaton_equals_library(automaton, library):
    dice = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(dice.choice("aabcdehinorst  '\n.é漢🙂019") for _ in range(dice.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(automaton.encode(text)) == want
        assert automaton.decode(automaton.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_automaton_accepts_only_its_own_tokenization(automaton):
    word = "tokenization"
    path = ids(automaton.encode(word))
    assert all(automaton._accepts(a, b) for a, b in zip(path, path[1:]))
    single = [automaton.first[b] for b in word.encode()]
    assert not all(automaton._accepts(a, b) for a, b in zip(single, single[1:]))


def test_encode_decode_rows(spark, vocabulary, library):
    rows = [(i, t, "clash", i) for i, t in enumerate(ODD)] * 2 + [(None, "null id", "clash", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens long")
    got = bpe.encode_decode(df, vocabulary).collect()
    assert len(got) == len(rows)
    for r in got:
        assert ids(bytes(r.packed_ids)) == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    twice = bpe.decode(bpe.encode(df, vocabulary), vocabulary).select("doc_id", "decoded").collect()
    assert sorted(map(repr, twice)) == sorted(repr(r) for r in bpe.encode_decode(df, vocabulary).select("doc_id", "decoded").collect())
    assert bpe.encode(df.limit(0), vocabulary).count() == 0


def test_packing_is_whole_and_gapless(spark, vocabulary, library):
    dice = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join("word" for _ in range(dice.randint(0, 300)))) for i in range(200)] + [(5, "same")] * 40 + [(None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, vocabulary, width=64, per_bucket=10).collect()
    per = {}
    for r in got:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in per.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert sum(r.length for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    whole = next(t for i, t in rows if i == 6)
    tokens = library.encode(whole, add_special_tokens=False).ids + [0]
    pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 6)
    assert pieces == [(a, len(tokens[a:a + 64]), zlib.crc32(struct.pack(f"<{len(tokens[a:a + 64])}I", *tokens[a:a + 64]))) for a in range(0, len(tokens), 64)]
    padding = sum(64 - sum(n for _, n in p) for p in per.values())
    assert padding <= 0.05 * sum(r.length for r in got)
    assert packing.pack(df.limit(0), vocabulary).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_every_length_once(seed):
    dice = random.Random(seed)
    histogram = {dice.randint(1, 100): dice.randint(1, 50) for _ in range(40)}
    used = {}
    for count, content in packing.patterns(histogram, 100):
        assert sum(content) <= 100 and count > 0
        for length in content:
            used[length] = used.get(length, 0) + count
    assert used == histogram


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site of the day</h1></header><nav><ul><li><a href=/>The</a></li></ul></nav><!-- ad --><div class="ad">Buy it in the shop of the town</div>
<article><h1>A  title &lt;here&gt;</h1><p>It is the <b>text</b> of the page,<br>and it is long enough for all of us to read.<p>Short.
<aside>not this</aside><form><label>Name</label><input></form><p>Another one that is of the same kind and is in the page for the test &am</article>
<div id="comments"><p>This is a comment of a reader and it is not in the text of the page at all</div><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    want = "A title <here>\nIt is the text of the page, and it is long enough for all of us to read.\nShort.\nAnother one that is of the same kind and is in the page for the test &am"
    rows = [(1, PAGE, "old"), (2, None, "old"), (3, "", "old"), (4, "<nav>only a menu</nav>", "old"), (5, "<div" * 2000, "old"), (6, "a < b & c", "x"), (1, PAGE, "old")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert got.columns == ["page_id", "html", "text"] and got.count() == 7
    found = {r.page_id: r.text for r in got.collect()}
    assert found[1] == want and found[2] == found[3] == found[4] == ""
    assert html_text.extract(got.limit(0)).count() == 0


def test_short_blocks_follow_neighbours():
    long = "<p>it is the text of the page and it is long enough for all of us to read in it</p>"
    assert html_text.main_text(f"<div>{long}<p>Short.</p>{long}</div>").split("\n")[1] == "Short."
    assert html_text.main_text('<p><a href="x">one link</a> <a href="y">two links</a></p>' + long).count("link") == 0


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "</p>" * 200_000, "<article>" * 100_000 + "</b>" * 100_000, "<nav>" * 100_000 + "x</nav>", "<p><a href=x>" * 100_000, "<!--" * 200_000, "<" * 300_000])
def test_hostile_pages_take_linear_time(page):
    started = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - started < 8


def test_pages_without_article_are_decided_by_their_blocks():
    long = "it is the text of the page and it is long enough for all of us to read in it, and of the kind that is in a paper"
    page = f"<body><ul><li><a href=/a>Home</a></li><li><a href=/b>News of the day</a></li></ul><div>{long}</div><div>Short one.</div><div>{long}</div><div><a href=/c>More</a> | <a href=/d>Less</a></div></body>"
    assert html_text.main_text(page) == f"{long}\nShort one.\n{long}"


def labelled(spark, n=400):
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("aeionrst") for _ in range(dice.randint(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(dice.randint(5, 80))]
        good = i % 3 > 0
        rows.append((i, " ".join(words) if good else " | ".join(words) if i % 2 else " ".join(w for w in words for _ in range(4)), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_on_held_out_rows(spark):
    data = labelled(spark)
    model = quality.fit(data.select("doc_id", "text"), data.select("doc_id", "quality"), sample=200)
    got = quality.score(data, model).where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert np.mean([(r.score >= quality.CUT) == bool(r.quality) for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_edges(spark):
    odd = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ODD)] + [(None, None, 1.0)], "doc_id long, text string, score double")
    for labels in ([], [(1, 1)], [(1, 1), (2, 1), (3, None), (None, 0)]):
        model = quality.fit(odd, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.score(odd, model).collect()
        assert len(got) == len(ODD) + 1 and len({r.score for r in got}) == 1
    twice = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))] + [(5, 0)], "doc_id long, quality int")
    assert quality.fit(odd, twice).weight.any()
    assert quality.score(odd.limit(0), model).count() == 0


PRIVATE = [
    (1, "Mr. John Smith, +1 (527) 555-9774, John.Smith@Mail8.example.com; 83.64.220.33 4777 4316 8656 2174 4111111111111111."),
    (2, 'john.smith@mail8.example.com +1-527-555-9774 Mrs Anna Weiß token = "e16f5c922b2ec7cb62cb5233697f63cf17fc1954" password=4a7d6039222173ea63'),
    (3, None), (4, ""), (5, "clean 12 3.14 2024-01-02 v1.2.3.4.5 a@b"), (5, "clean 12 3.14 2024-01-02 v1.2.3.4.5 a@b"), (6, "83.64.220.33."), (None, "083-64-2203 x"),
]


def test_surrogates(spark):
    df = spark.createDataFrame([(*r, "kept", "x") for r in PRIVATE], "doc_id long, text string, kinds string, match string")
    got = surrogates.replace(df, "k").collect()
    assert len(got) == len(PRIVATE) and all(r.match == "x" for r in got)
    one, two, six = (next(r for r in got if r.doc_id == i) for i in (1, 2, 6))
    for r in got:
        for secret in ("Smith", "9774", "83.64.220.33", "8656", "4111111111111111", "e16f5c", "4a7d60", "Anna"):
            assert secret not in (r.text or "")
    mail = re.search(r"[\w.]+@[\w.]+\.com", one.text).group()
    assert mail in two.text and six.text[:-1] in one.text
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", one.text).groups()
    assert "+1-" + "-".join(phone) in two.text
    card = re.search(r"4\d{15}", one.text).group()
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{40}"', two.text) and re.search(r"password=[0-9a-f]{18}$", two.text)
    assert any(f"Mr. {g} " in one.text for g in surrogates.GIVEN["m", "latin"]) and any(f"Mrs {g} " in two.text for g in surrogates.GIVEN["f", "latin"])
    assert [r.text for r in got if r.doc_id == 5] == [PRIVATE[4][1]] * 2 and (one.n_entities, two.n_entities) == (6, 5)
    assert next(r for r in got if r.doc_id == 3).text is None
    other = {r.text for r in surrogates.replace(df, "another key").collect()}
    assert one.text not in other
    assert surrogates.replace(df.limit(0), "k").count() == 0


def test_surrogates_stay_distinct_in_a_narrow_format(spark):
    texts = [(i, f"{i % 10}.{i // 10 % 10}.1.1 and Mr {chr(65 + i % 26)}{'abcdefghij'[i // 26]}x") for i in range(100)]
    got = surrogates.replace(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()
    ips = {r.text.split(" and ")[0] for r in got}
    names = {r.text.split(" and Mr ")[1] for r in got}
    assert len(ips) == 100 and len(names) == 100
    assert not ips & {t.split(" and ")[0] for _, t in texts}


def test_surrogate_names_widen_with_the_attempts(spark, monkeypatch):
    # With 2 family names there are 2, 4 and 8 forms of a surname, so 40 need parts that later attempts add.
    monkeypatch.setattr(surrogates, "FAMILY", {k: v[:2] for k, v in surrogates.FAMILY.items()})
    rows = spark.range(400).crossJoin(spark.createDataFrame([(a,) for a in (0, 3, 5, 8, 12)], "attempt int"))
    rows = rows.withColumn("normal", F.concat(F.lit("x"), F.col("id").cast("string")))
    made = surrogates.surrogate("k", F.lit("name"), F.col("normal"), F.lit("Mr "), F.col("attempt"))
    rows = rows.groupBy("attempt").agg(F.countDistinct(made).alias("n"))
    forms = {r.attempt: r.n for r in rows.collect()}
    assert (forms[0], forms[3], forms[5]) == (2, 4, 8) and 40 < forms[8] <= 64 and forms[12] > 200


def test_digests_of_the_query(spark, library):
    from tracelake.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op5_bpe"](spark, folder).collect():
        tokens = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(tokens) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(tokens)}I", *tokens)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(tokens, skip_special_tokens=False).encode()).hexdigest()


def test_words_met_again_are_encoded_once(vocabulary, automaton, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 100)
    words = bpe.Library(bpe.definition(vocabulary), bpe.categories())
    made, path = [], words._path
    monkeypatch.setattr(words, "_path", lambda raw: made.append(raw) or path(raw))
    texts = [f"often w{chr(97 + i % 26) * (1 + i // 26)}é" for i in range(300)] + ODD
    assert [words.encode(t or "") for t in texts] == [automaton.encode(t or "") for t in texts]
    assert made.count(b"often") == 1 and len(words) + len(words.older) <= 100
