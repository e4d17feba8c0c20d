"""Hand-built rows for the cases that are easy to get wrong."""

import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.functions import blobs, jsons, paths, rules, secrets, textfold, times, urls
from tracelake.operators import bursts, compare, hits, joins, messages, ordered, ranges, scan
from tracelake.sources import textlogs


def values(spark, rows, column, schema="v string"):
    data = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in data.select(column.alias("out")).collect()]


@pytest.mark.parametrize("raw,expected", [
    (None, (0, "", False)), ("", (0, "", False)), ("junk", (0, "", False)), ("0", (0, "s", False)), ("-5", (-5, "s", True)),
    ("0.5", (0, "s", True)), ("99999999999", (99999999999, "s", True)), ("100000000000", (100000000, "ms", True)),
    ("99999999999999", (99999999999, "ms", True)), ("100000000000000", (100000000, "us", True)),
    ("2024-01-02", (1704153600, "iso", True)), ("2024-01-02T03:04:05Z", (1704164645, "iso", True)),
    ("2024-01-02 03:04:05", (1704164645, "iso", True)), ("2024-01-02T03:04:05+02:00", (1704157445, "iso", True)),
    ("2024/01/02", (0, "", False)), ("2024", (2024, "s", True)), ("1e3", (1000, "s", True)), ("12d", (0, "", False))])
def test_epoch_seconds(spark, raw, expected):
    got = values(spark, [raw], times.epoch_seconds(F.col("v")))[0]
    assert tuple(got) == expected


def test_spans_and_texts(spark):
    spans = values(spark, [-1, 0, 59, 3600, 86399, 86401, 90061], times.span_human(F.col("v")), "v long")
    assert spans == ["0 s", "0 s", "59 s", "1 h", "23 h 59 min 59 s", "1 d", "1 d 1 h 1 min"]
    assert values(spark, [0, None, 1, -1], times.utc_text(F.col("v")), "v long") == ["", "", "1970-01-01T00:00:01Z", "1969-12-31T23:59:59Z"]
    switch = values(spark, [1774745999, 1774746000, 1792889999, 1792890000], times.local_text(F.col("v")), "v long")
    assert switch == ["2026-03-29 01:59:59", "2026-03-29 03:00:00", "2026-10-25 02:59:59", "2026-10-25 02:00:00"]


def test_package_of(spark):
    cases = {"/data/com.a/x": "com.a", "/data": "data", "/system/app/com.b-1/y": "com.b", "/system/app": "", "/app/com.c-x-2/z": "com.c-x",
             "/misc/q": "misc", "/": "", "accounts.db": "", "//data//com.d": "com.d"}
    assert values(spark, list(cases), paths.package_of(F.col("v"))) == list(cases.values())


def test_names_and_modes(spark):
    assert values(spark, [0o100644, 0o040755, 0o140777, 0o104711, 0o041777, 0o120777, 0], paths.mode_text(F.col("v")), "v long") == [
        "r/rrw-r--r--", "d/drwxr-xr-x", "s/hrwxrwxrwx", "r/rrws--x--x", "d/drwxrwxrwt", "l/lrwxrwxrwx", "-/----------"]
    df = spark.createDataFrame([("/a/b",), ("/a_b",), ("/a b",), ("..",), ("",)], "path string")
    names = {r.path: r.name for r in paths.unique_names(df).collect()}
    assert len(set(names.values())) == 5 and names[".."].startswith("root--") and names["/a/b"].startswith("a_b--")


def test_masking(spark):
    assert values(spark, ["", "abcd", "abcdefghij"], secrets.mask(F.col("v"))) == ["", "abcd (4)", "…ghij (10)"]
    phones = values(spark, ["+48 600 700 800", "12345", "600700800 x"], secrets.mask_phone(F.col("v")))
    assert phones == ["…0800", "12…45 (5)", "…0800"]


def test_json_objects_and_lookup(spark):
    text = '{css} {"a": {"b": 1}} x {"q": "}{\\""} {"a": {"b": 1}} { bad {"in": 1} } {"open": "'
    assert values(spark, [text], jsons.json_objects(F.col("v"))) == [['{"a": {"b": 1}}', '{"q": "}{\\""}']]
    docs = ['{"x": {"id": 7}, "uid": null}', '{"l": [{"uid": "no"}]}', "[]", "bad", None, '{"a": {"b": {"fbid": "9"}}}']
    assert values(spark, docs, jsons.json_find(F.col("v"), ("uid", "fbid", "id"))) == ["7", "", "", "", "", "9"]


def test_deep_and_broken_documents(spark):
    deep = '{"a": ' * 100_000 + '[1, {"id": "x"}]' + "}" * 100_000
    docs = [deep, deep[:-1], deep + "}", "{}", "[]", " ", None, '{"uid": "", "in": {"uid": 5}}', '{"a": {"uid": ""}, "b": {"id": true}}', '{"name": "", "b": {"name": "n"}}']
    how = {"uid": (("uid", "fbid", "id"), False), "name": (("name",), True)}
    got = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, v string").select("i", jsons.json_lookup(F.col("v"), how).alias("f")).orderBy("i").collect()
    assert [tuple(r.f) for r in got] == [("ok", "", ""), ("broken", "", ""), ("broken", "", ""), ("ok", "", ""), ("ok", "", ""), ("empty", "", ""), ("empty", "", ""), ("ok", "", ""),
                                         ("ok", "True", ""), ("ok", "", "n")]
    fields = jsons.json_fields(spark.createDataFrame([(0, deep, 1), (1, "{", 2), (2, '{"a": [null, true, {"b": 1.5}], "": "é"}', 3)], "i int, v string, path int"), "v", ["i"]).collect()
    assert [(r.i, r.path[-6:] if r.path else r.path, r.key, r.value, r.kind, r.status) for r in fields] == [
        (0, "/a/a/a", "0", "1", "number", "ok"), (0, "/a/a/1", "id", "x", "text", "ok"), (1, None, None, None, None, "broken"),
        (2, "/a", "0", None, "null", "ok"), (2, "/a", "1", "true", "truth", "ok"), (2, "/a/2", "b", "1.5", "number", "ok"), (2, "", "", "é", "text", "ok")]


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\n\\u00e9", true, null, {}, []], "a": 2}', " [ ] ", '"s"', "-0", "NaN", '{"a"}', "[1,]", "[,]", "{,}", '{"a": 1,}', "[1 2]", "01", "]", "", '{"a": "\n"}', "1 1", '["\\x"]'])
def test_documents_by_stack_equal_the_usual_reader(text):
    try:
        want = jsons.json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            jsons.deep_loads(text)
    else:
        assert repr(jsons.deep_loads(text)) == repr(want)


def test_folding(spark):
    got = values(spark, ["Zażółć gęślą", "a—b…", "ß", "日本", "tab\there", "½ ﬁ"], textfold.to_ascii(F.col("v")))
    assert got == ["Zazolc gesla", "a--b...", "?", "??", "tab?here", "? fi"]


def test_url_parts(spark):
    got = values(spark, ["http://h/x?a=1&a=2&b=&c=%20z"], urls.query_map(F.col("v")))[0]
    assert got == {"a": "1", "c": " z"}
    hints = values(spark, ["https://m/x?id=5&lst=1:2:3"], urls.url_hints(F.col("v")))[0]
    assert hints == {"profile_id": "5", "viewer_lst": "1:2:3", "viewer_uid": "1", "author_uid": "2", "story_ts": "3"}


def test_rules(spark):
    assert values(spark, ["x", None, "99"], rules.code_label(F.col("v"), rules.OLDER_TYPES)) == ["missing", "missing", "uncatalogued"]
    assert values(spark, ["/x/netstats/klo", "/tombstone_1", "/q"], rules.category(F.col("v"))) == ["netstats", "tombstone", "other"]


def test_utf16_unaligned(spark):
    blob = b"\x01" + "com.one".encode("utf-16-le") + b"\xff" + "com.two".encode("utf-16-le") + "ab".encode("utf-16-le")
    assert values(spark, [blob], blobs.utf16_names(F.col("v")), "v binary") == [["com.one", "com.twoab"]]


def test_bursts_at_the_gap(spark):
    rows = [("a", t, "s") for t in (0, 300, 600, 901, -5, -310)] + [("b", 10, "z"), ("b", 10, "y")]
    df = spark.createDataFrame(rows, "k string, unix long, source string")
    got = sorted((r.k, r.start_unix, r.end_unix, r.events, r.first_source) for r in bursts.bursts(df, ["k"], 300).collect())
    assert got == [("a", -310, -310, 1, "s"), ("a", -5, 600, 4, "s"), ("a", 901, 901, 1, "s"), ("b", 10, 10, 2, "y")]


def brute_dedupe(rows, window):
    kept = []
    for device, unix, source, key, detail in sorted(rows):
        last = kept[-1] if kept else None
        if last and last[0] == device and last[2] == source and last[4] == detail and (not window or unix - last[1] <= window):
            last[1] = unix
        else:
            kept.append([device, unix, source, key, detail])
    return sorted((k[0], k[3], k[1]) for k in kept)


@pytest.mark.parametrize("window", [0, 3])
def test_chain_dedupe_against_brute_force(spark, window):
    rng = random.Random(window)
    rows = [(rng.randrange(2), rng.choice([5, rng.randrange(60)]), rng.choice("ab"), i, rng.choice("xy")) for i in range(400)]
    df = spark.createDataFrame(rows, "device int, unix long, source string, event_id int, detail string")
    got = sorted((r.device, r.event_id, r.last_unix) for r in ordered.chain_dedupe(df, ["device"], "event_id", window).collect())
    assert got == brute_dedupe(rows, window)


@pytest.mark.parametrize("width", [4, 16, 65536])
def test_runs_and_positions(spark, width):
    rng = random.Random(width)
    ids = sorted(set(rng.randrange(-50, 200) for _ in range(150)))
    df = spark.createDataFrame([(1, i) for i in ids], "v int, id long")
    expected, start = [], ids[0]
    for a, b in zip(ids, ids[1:] + [None]):
        if b != a + 1:
            expected.append((start, a - start + 1))
            start = b
    assert sorted((r["first"], r["count"]) for r in ranges.runs_of(df, ["v"], "id", width).collect()) == expected
    assert sorted((r.position, r.id) for r in ranges.positions(df, ["v"], "id", width).collect()) == list(enumerate(ids))
    picked = sorted(r.position for r in ranges.systematic_sample(df, ["v"], "id", 7).collect())
    assert picked == [int(i * len(ids) / 7) for i in range(7)]


@pytest.mark.parametrize("width", [7, 64, 1 << 16])
def test_nested_hits_against_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(r % 2, rng.randrange(300), "k%d" % rng.randrange(3), rng.randrange(1, 60), rng.random() < 0.3) for r in range(200)]
    rows = [tuple(r) for r in {(a, b, c): (a, b, c, d, e) for a, b, c, d, e in rows}.values()]
    expected = []
    for run in (0, 1):
        reach = -1
        for _, at, kind, length, cut in sorted(r for r in rows if r[0] == run):
            if at >= reach:
                expected.append((run, at, kind))
                reach = reach if cut else at + length
    df = spark.createDataFrame(rows, "run int, offset long, kind string, length long, truncated boolean")
    assert sorted((r.run, r.offset, r.kind) for r in hits.drop_nested(df, ["run"], width).collect()) == sorted(expected)


@pytest.mark.parametrize("size", [3, 24, 1000])
def test_signatures_across_block_edges(spark, size):
    rng = random.Random(size)
    magics = [(k, bytes.fromhex(m), shift) for k, m, shift, _ in scan.SIGNATURES]
    data = b"".join(rng.choice([m for _, m, _ in magics] + [b"xy", b"\x00" * 5]) for _ in range(60))
    want = sorted((k, at - shift) for k, m, shift in magics for at in range(len(data)) if data.startswith(m, at) and at >= shift
                  and at + len(m) <= ((at - shift) // size + 2) * size)
    blocks = [(1, i, data[i * size:(i + 1) * size]) for i in range(-(-len(data) // size))] + [(2, 0, data[:5])]
    got = scan.signature_hits(spark.createDataFrame(blocks, "run int, block long, data binary"), ["run", "block"], number="block").filter("run = 1").collect()
    assert sorted((r.kind, r.block * size + r.start) for r in got) == want


@pytest.mark.parametrize("size", [3, 5, 64])
def test_chunk_search_across_edges(spark, size):
    data = b"aaabaaacaaa" * 7
    df = spark.createDataFrame([("k", data)], "key string, content binary")
    expected = [i for i in range(len(data)) if data[i:i + 3] == b"aaa"]
    hits = scan.search_chunks(scan.chunk_rows(df, "key", "content", size), "key", b"aaa", size)
    assert sorted(r.offset for r in hits.collect()) == expected
    part = scan.search_chunks(scan.chunk_rows(df, "key", "content", size), "key", b"aaa", size, 10, 40)
    assert sorted(r.offset for r in part.collect()) == [i for i in expected if i >= 10 and i + 3 <= 40]


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(size):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", bytes(size)) + chunk(b"IEND", b"")


PNG = png(200000)


def gz(data):
    packer = zlib.compressobj(wbits=31)
    return packer.compress(data) + packer.flush()


def zip_bytes():
    import io
    import zipfile
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("a.txt", "hello")
    return out.getvalue()


def test_row_relation(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a"], ["a", "n"]), (["x"], ["a", "n"]), (["a", None], ["a", None]), (["a", "q"], ["a", "b"])],
                               "a array<string>, b array<string>")
    got = [(r[0].status, r[0].column) for r in df.select(compare.row_relation(F.col("a"), F.col("b"))).collect()]
    assert got == [("agree", None), ("schema_evolved", None), ("mismatch", None), ("agree", None), ("mismatch", 1)]


def test_offsets_with_competing_owners(spark):
    ext = spark.createDataFrame([("/a", 1, 10, 0, 3), ("/b", 2, 11, 5, 5000)], "path string, rank int, physical long, logical long, count long")
    asked = spark.createDataFrame([(10 * 16 + 3,), (11 * 16,), (5000 * 16 + 1,), (9,)], "offset long")
    got = {r.offset: (r.path, r.file_offset, r.owners) for r in ranges.offset_owner(asked, ext, 16).collect()}
    assert got == {163: ("/a", 3, 1), 176: ("/a", 16, 2), 80001: ("/b", (5 + 4989) * 16 + 1, 1), 9: (None, None, 0)}


def test_absent_unreadable_and_zero_stay_apart(spark):
    rows = spark.createDataFrame([("f", "t")], "file string, table string")
    expected = spark.createDataFrame([("f", "t"), ("f", "gone"), ("f", "bad")], "file string, table string")
    got = {r.table: (r.rows, r.status) for r in messages.table_counts(rows, expected, expected.filter("table = 'bad'"), ["file", "table"]).collect()}
    assert got == {"t": (1, "PRESENT"), "gone": (-1, "ABSENT"), "bad": (None, "UNREADABLE")}


def test_first_key_wins_in_store_order(spark):
    rows = spark.createDataFrame([("db", 0, 2, "net", None, "b1", "x"), ("conf", 1, 1, "net", "late", None, None), ("db", 0, 3, "net", "early", "restore", "y")],
                                 "store string, store_rank int, row_id long, ssid string, psk string, bssid string, account string")
    got = joins.merge_credentials(rows).collect()[0]
    assert (got.psk, got.sources, got.access_points, got.account, got.has_both) == ("early", "conf,db", 1, "y", True)


def fold(rows):
    """Kept hits of one run, one after the other."""
    kept, reach = [], -1
    for at, kind, length, cut in sorted(rows):
        if at >= reach:
            kept.append((at, kind, length, cut))
            reach = reach if cut else at + length
    return kept


def test_one_island_is_split(spark):
    # Every hit overlaps the next one, so all hits are one island; a few are as long as many slices.
    rng = random.Random(3)
    rows = [(i * 3, "k", rng.choice([2, 5, 9, 40]) if rng.random() < .98 else 4000, rng.random() < .05) for i in range(6000)]
    rows += [(9, "a", 1, False), (9, "a", 1, False), (9, "a", 0, False), (30, None, 5, False)][:3]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "offset long, kind string, length long, truncated boolean, _row int, land string")
    got = hits.drop_nested(df, [], 100)
    assert got.columns == df.columns
    assert sorted((r.offset, r.kind, r.length, r.truncated) for r in got.collect()) == fold(rows)
    assert hits.drop_nested(df.limit(0), []).count() == 0


@pytest.mark.parametrize("width", [1, 16, 1 << 16])
def test_metadata_sweep_against_sets(spark, width):
    rng = random.Random(width)
    interval = lambda n: [(rng.choice(["a", "b"]), rng.randrange(0, 200), rng.randrange(0, 12)) for _ in range(n)]
    free, meta = interval(30), interval(20) + [("c", 5, 5)]
    want = []
    for d in "abc":
        blocks = lambda side: {b for k, f, n in side if k == d for b in range(f, f + n)}
        both, lasts = blocks(free) & blocks(meta), {f + n - 1 for k, f, n in meta if k == d and n}
        want.append((d, len(both), len(both & lasts), len(both - lasts)))
    schema = "device string, first long, count long"
    got = ranges.metadata_overlap(spark.createDataFrame(free, schema), spark.createDataFrame(meta, schema), ["device"], width)
    assert sorted(map(tuple, got.collect())) == want


def test_metadata_sweep_of_huge_intervals(spark):
    wide = lambda first: spark.createDataFrame([(first, 10 ** 12)], "first long, count long")
    assert tuple(ranges.metadata_overlap(wide(0), wide(7)).first()) == (10 ** 12 - 7, 0, 10 ** 12 - 7)
    assert tuple(ranges.metadata_overlap(wide(8), wide(7)).first()) == (10 ** 12 - 1, 1, 10 ** 12 - 2)


def two_devices(spark):
    """The same inode, offsets and blocks on two devices, with different owners."""
    extents = spark.createDataFrame([("a", "/a", 1, 5, 100, 0, 10), ("b", "/b", 1, 5, 100, 0, 4), ("b", "/c", 2, 6, 104, 0, 4)],
                                    "device string, path string, rank int, inode long, physical long, logical long, count long")
    asked = spark.createDataFrame([("a", 1, 105 * 4096 + 7), ("b", 1, 105 * 4096 + 7), ("b", 2, 10 ** 15)], "device string, id int, offset long")
    return extents, asked


def test_owners_stay_on_their_device(spark):
    extents, asked = two_devices(spark)
    got = {(r.device, r.id): (r.path, r.file_offset, r.owners) for r in ranges.offset_owner(asked, extents, 4096, ["device"]).collect()}
    assert got == {("a", 1): ("/a", 5 * 4096 + 7, 1), ("b", 1): ("/c", 4096 + 7, 1), ("b", 2): (None, None, 0)}
    q = spark.createDataFrame([("a", 5, 4096), ("b", 5, 4096), ("b", 5, 5 * 4096)], "device string, inode long, file_offset long")
    assert sorted((r.device, r.file_offset, r.image_offset) for r in ranges.image_offsets(q, extents, 4096, ["device"]).collect()) == [
        ("a", 4096, 101 * 4096), ("b", 4096, 101 * 4096), ("b", 5 * 4096, None)]


def test_recovery_and_metadata_stay_on_their_device(spark):
    extents, _ = two_devices(spark)
    runs = spark.createDataFrame([("a", 100, 10), ("b", 200, 10)], "device string, first long, count long")
    items = spark.createDataFrame([("a", 5), ("b", 5)], "device string, inode long")
    got = {r.device: r.verdict for r in ranges.recoverability(items, extents, runs, "inode", ["device"]).collect()}
    assert got == {"a": "all free", "b": "all reused"}
    free = spark.createDataFrame([("a", 109), ("b", 109), ("b", 209)], "device string, block long")
    assert [tuple(r) for r in ranges.metadata_overlap(free, runs, ["device"]).orderBy("device").collect()] == [("a", 1, 1, 0), ("b", 1, 1, 0)]


def test_dense_chunk_has_no_all_pairs(spark):
    left = spark.range(500).selectExpr("id AS k", "id * 2 AS first", "1L AS count")
    right = spark.range(500).selectExpr("id * 2 AS first", "1L AS count")
    got = ranges.overlap_blocks(left, right, ["k"])
    assert got.count() == 500 and got.agg(F.sum("blocks")).first()[0] == 500


def test_one_file_per_name_meets_a_dump(spark):
    files = spark.createDataFrame([("a", "cache.db", "/x", 10, 1), ("a", "cache.db", "/y", 30, 2), ("b", "cache.db", "/z", 20, 3)], "device string, name string, path string, mtime long, size long")
    dumps = spark.createDataFrame([("a", "cache.db", "p", "1", "s", "v"), ("b", "cache.db", "q", "2", "", "")], "device string, name string, process string, pid string, signal string, build string")
    got = sorted(map(tuple, joins.crashes_in_window(files, dumps, ["device"]).collect()))
    assert [(*r[:3], r[3][17:19], *r[4:]) for r in got] == [("a", "cache.db", "/y", "30", 2, "p", "1", "s", "v"), ("b", "cache.db", "/z", "20", 3, "q", "2", "", "")]


def test_webkit_stamp_just_below_a_second(spark):
    assert values(spark, [13350000000999999], times.webkit_unix(F.col("v")), "v long") == [13350000000 - 11644473600]


def test_hits_leave_the_worker_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(scan, "HITS", 3)
    texts = ["aaaa bcd aa", None, "", "aa" * 40, "żaa aaż", "none"]
    df = spark.createDataFrame([(i, t, i / 2) for i, t in enumerate(texts)], "id int, t string, half double").coalesce(1)
    places = [(i, at) for i, t in enumerate(texts) for at in range(len(t or "")) if t.startswith("aa", at)]
    assert sorted((r.id, r.offset) for r in scan.search_text(df, "t", "aa", ["id", "half"]).collect()) == places
    got = scan.contexts(df, "t", "aa", ["id", "half"], 2).collect()
    assert sorted((r.id, r.half, r.offset, r.context) for r in got) == [
        (i, i / 2, at, texts[i][max(at - 2, 0):max(at - 2, 0) + 6].replace("aa", "??")) for i, at in places]
    want = sorted((i, m.start(), m.group()) for i, t in enumerate(texts) for m in re.finditer("a|$", t or ""))
    assert sorted(map(tuple, scan.regex_search(df, "t", "a|$", ["id"]).collect())) == want


def test_block_rows_shuffle_marks_and_pairs_only(spark):
    text = "\n".join(["plain words"] * 500 + [" ctrl = x", "network={", "\t# a=b", "  more words", '  ssid="n=1"', " } ", "tail"] + ["other words"] * 500)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    rows = textlogs.block_rows(df, "t", ["id"])
    assert sorted(map(tuple, rows.collect())) == [(1, -1, "ctrl", "x"), (1, 501, "ssid", "n=1")]
    kept = textlogs.file_lines(df, "t", ["id"], ["network=", "}", "="])
    assert [r.pos for r in kept.orderBy("pos").collect()] == [500, 501, 502, 504, 505]
    assert textlogs.file_lines(df, "t", ["id"]).count() == 1008
