"""Files on disk: exports read back, database files, body files, streams."""


import pytest
from pyspark.sql import functions as F

from tracelake.plans import verification as PV
from tracelake.sinks import exports
from tracelake.sources import binaries, bodyfile, documents, textlogs
from tracelake.streaming import live
from tracelake.verify import checks, report

SF = "/root/testdata/sf0.001"


def test_body_file_round_trip(spark, tmp_path):
    rows = [(5, "/a|b", 0o100644, 1, 2, 3, 10, 11, 12, 13), (6, "/bad\nname", 0o100644, 1, 2, 3, 1, 1, 1, 1)]
    files = spark.createDataFrame(rows, "inode long, path string, mode long, uid long, gid long, size long, atime long, mtime long, ctime long, crtime long")
    refused = exports.write_body(files, str(tmp_path / "body"))
    assert [r.path for r in refused.collect()] == ["/bad\nname"]
    back = bodyfile.read_body(spark, str(tmp_path / "body")).collect()
    assert [(r.name, r.inode, r.mode, r.crtime) for r in back] == [("/a|b", "5", "r/rrw-r--r--", 13)]


def test_exports_are_masked(spark, tmp_path):
    df = spark.createDataFrame([(1, "topsecretvalue", bytearray(b"\x01\xff"))], "id int, pw string, raw binary")
    exports.to_csv(df, str(tmp_path / "c"), {"pw": "password"})
    exports.to_json(df, str(tmp_path / "j"), {"pw": "password"})
    csv = spark.read.option("header", True).csv(str(tmp_path / "c")).collect()[0]
    js = spark.read.json(str(tmp_path / "j")).collect()[0]
    assert (csv.pw, csv.raw) == (js.pw, js.raw) == ("…ue (14)", "01ff")


def test_findings_keep_earlier_runs(spark, tmp_path):
    path = str(tmp_path / "f")
    make = lambda run, n: spark.createDataFrame([(run, i) for i in range(n)], "run_id string, n int")
    exports.save_findings(make("a", 3), path)
    exports.save_findings(make("b", 2), path)
    exports.save_findings(make("a", 1), path)
    assert {r.run_id: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"a": 1, "b": 2}


def test_binary_manifest(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    read = binaries.read_binaries(spark, str(tmp_path), "*.bin")
    files = read.select(F.regexp_extract("path", "[^/]*$", 0).alias("path"), F.col("length").alias("declared_size"), "content")
    wanted = binaries.with_companions(spark.createDataFrame([("x.bin",)], "path string"))
    got = {r.path: (r.status, r.sha256) for r in binaries.manifest(wanted, files, 10).collect()}
    assert got["x.bin"] == ("PRESENT", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    assert got["x.bin-wal"] == ("ABSENT", None)


def test_prefs_read_large_and_refuse_broken(spark):
    big = "<map>" + " " * (6 << 20) + '<int name="i" value="7"/></map>'
    df = spark.createDataFrame([("big", big), ("bad", "<map><string>"), ("ok", '<map><long name="l" value="4294967296"/></map>')], "f string, x string")
    got = sorted((r.f, r.type, r.value) for r in documents.prefs_rows(df, "x", ["f"]).collect())
    assert got == [("bad", "error", "not well formed"), ("big", "int", "7"), ("ok", "long", "4294967296")]


def test_blocks_and_notes(spark):
    text = 'update=1\nnetwork={\n ssid="a"\n #c=d\n}\nnetwork={\n}\nnetwork={\n ssid="never"\n'
    rows = textlogs.block_rows(spark.createDataFrame([(1, text)], "f int, t string"), "t", ["f"]).collect()
    assert sorted((r.block, r.key, r.value) for r in rows) == [(-1, "update", "1"), (1, "ssid", "a")]


def test_counts_of_a_scan_come_from_the_pass_that_writes(spark, tmp_path):
    from tracelake.operators import inventory as I
    from tracelake.plans.inventories import CUT
    from tracelake.plans.standins import inventory
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = inventory(spark, SF)
    files = rows.mapInArrow(count, rows.schema)
    got = I.write_recent(files, CUT, str(tmp_path / "recent")).first().asDict()
    assert reads.value == got["files"] == rows.count()
    want = I.file_scan(rows, CUT).first()
    assert all(got[k] == want[k] for k in ("files", "epoch", "installer", "coherent", "recent", "recent_bytes"))
    assert spark.read.parquet(str(tmp_path / "recent")).count() == got["recent"] == I.recent_files(rows, CUT).count()


def test_large_files_by_ranges(spark, tmp_path):
    import hashlib
    import os
    import random

    from tracelake.operators.scan import search_chunks
    # Larger than a cell may be (2 GB), but with holes: the file system keeps little of it.
    big, small, none = tmp_path / "big.bin", tmp_path / "small.bin", tmp_path / "none.bin"
    needle = b"needle-needle"
    places = sorted({0, (1 << 20) - 5, 3 * (1 << 20) - 12, (1 << 31) + 77, (1 << 31) + 77 + 7, 2_200_000_000 - len(needle)})
    with open(big, "wb") as f:
        for at in places:
            f.seek(at)
            f.write(needle)
    data = bytes(random.Random(1).choices(b"nedl-", k=300_000)) + needle
    small.write_bytes(data)
    none.write_bytes(b"")
    chunks = binaries.read_ranges(spark, str(tmp_path))
    assert chunks.rdd.getNumPartitions() > 16
    hits = search_chunks(chunks.select("path", "chunk", "data"), "path", needle).collect()
    found = lambda path: sorted(r.offset for r in hits if r.path.endswith(path.name))
    with open(big, "rb") as f:
        f.seek(1 << 31)
        tail = f.read()
    want = [(1 << 31) + i for i in range(200) if tail.startswith(needle, i)]
    assert [o for o in found(big) if 1 << 31 <= o < (1 << 31) + 200] == want and {0, (1 << 20) - 5, 3 * (1 << 20) - 12, 2_200_000_000 - len(needle)} <= set(found(big))
    brute, at = [], data.find(needle)
    while at >= 0:
        brute.append(at)
        at = data.find(needle, at + 1)
    assert found(small) == brute and found(none) == []
    wanted = spark.createDataFrame([(f"file://{big}", os.path.getsize(big)), (f"file://{small}", 10 ** 9), (f"file://{tmp_path}/x", 1), (f"file://{none}", 0)], "path string, declared_size long")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.bytes, r.sha256, r.over_limit) for r in binaries.large_manifest(wanted, 1000).collect()}
    digest = hashlib.sha256()
    with open(big, "rb") as f:
        while block := f.read(1 << 24):
            digest.update(block)
    assert got == {"big.bin": ("PRESENT", 2_200_000_000, digest.hexdigest(), True), "small.bin": ("TRUNCATED", len(data), None, True), "x": ("ABSENT", None, None, None),
                   "none.bin": ("PRESENT", 0, hashlib.sha256(b"").hexdigest(), False)}


@pytest.mark.parametrize("size, span, overlap", [(4, 8, 0), (5, 20, 3), (64, 64, 2)])
def test_ranges_cover_a_file_once(spark, tmp_path, size, span, overlap):
    (tmp_path / "f.bin").write_bytes(data := bytes(range(61)))
    rows = sorted(binaries.read_ranges(spark, f"{tmp_path}/f.bin", size, overlap, partition_bytes=span).collect(), key=lambda r: r.chunk)
    assert [bytes(r.data) for r in rows] == [data[i:i + size + overlap] for i in range(0, 61, size)] and {r.length for r in rows} == {61}


def crash_fold(lines):
    """Occurrences per header line, one line after the other."""
    out, group = {}, None
    for i, line in enumerate(lines):
        key, _, value = line.partition(": ")
        if key == "package name":
            group = i
            out[group] = [value, 0, ""]
        elif key == "happen time" and group is not None:
            out[group][1] += 1
            out[group][2] = max(out[group][2], value)
    return sorted(tuple(v) for v in out.values())


def test_one_long_log_over_many_tasks(spark, tmp_path):
    # Few headers: most splits have none and take theirs from a split far before.
    lines = ["happen time: before any header"] + [
        f"package name: com.p{i}" if i % 700_001 == 5 else f"happen time: {i % 9973:05d}" if i % 5 == 0 else "free text" for i in range(5_000_000)]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        read = textlogs.read_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 20 and read.select("split").distinct().count() > 20
        rows = textlogs.crash_history(read, None, ["file"]).collect()
        assert sorted((r.package, r.occurrences, r.last_time) for r in rows) == crash_fold(lines)
        last = textlogs.numbered(read.filter("split >= 0"), ["file"]).agg(F.max("pos"), F.count_distinct("pos")).first()
        assert tuple(last) == (5_000_000, 5_000_001)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [2, 3, 1 << 16])
def test_splits_of_a_text_change_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(textlogs, "LINES", size)
    text = 'update=1\nnetwork={\n ssid="a"\n #c=d\n psk=1\n}\nx=2\nnetwork={\n}\nnetwork={\n k=1\nnetwork={\n k=2\n}\nnetwork={\n ssid="never"\n'
    df = spark.createDataFrame([(1, text)], "f int, t string")
    assert sorted((r.block, r.key, r.value) for r in textlogs.block_rows(df, "t", ["f"]).collect()) == [(-1, "update", "1"), (-1, "x", "2"), (1, "psk", "1"), (1, "ssid", "a"), (11, "k", "2")]
    notes = "kernel reboot: a\nx\nx\nx\nrecord time_stamp: 1\nx\nrecord time_stamp: 2\nkernel reboot: b\nkernel reboot: c\nx\nx\nrecord time_stamp: 3"
    got = textlogs.carry_note(spark.createDataFrame([(1, notes)], "f int, t string"), "t", ["f"]).collect()
    assert sorted((r.local, r.note) for r in got) == [("1", "a"), ("2", ""), ("3", "c")]
    said = "Fix? no\nFix?\nfirst\n\n\nOptimize? yes\nsecond\nexit=1"
    got = textlogs.checker_messages(spark.createDataFrame([(1, said)], "f int, t string"), "t", ["f"]).collect()
    assert sorted(r.message for r in got) == ["Fix? no  [Fix?]", "first  [Optimize? yes]", "second"]


def test_checks_and_markdown(spark):
    results = checks.check_results(PV.asserted(spark, SF))
    assert {r.check_id: r.passed for r in results.collect()}["timeline.odd"] is False
    assert checks.split_path("by_type.'com.google'.0") == ["by_type", "com.google", "0"]
    text = report.markdown("Report", PV.verdict_rows(spark, SF))
    assert text.startswith("# Report\n") and text.count("\n|") == 12


@pytest.fixture()
def event_stream(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    schema = batch.schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("user"), F.col("event_type").alias("source"),
                      F.col("event_type").alias("kind"), F.col("props").alias("detail"))


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q.sparkSession.table(name) if hasattr(q, "sparkSession") else stream.sparkSession.table(name)


def test_live_bursts_match_batch(spark, event_stream):
    drain(live.live_bursts(event_stream, ["user"], 3600), "live_bursts", "complete" if False else "append")
    live_rows = spark.table("live_bursts").count()
    from tracelake.operators.bursts import bursts
    t = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("user"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("unix"), F.col("event_type").alias("source"))
    whole = bursts(t, ["user"], 3600).count()
    assert 0 < live_rows <= whole


def test_live_dedupe_and_scan(spark, event_stream):
    drain(live.live_dedupe(event_stream, "365 days"), "live_dedupe")
    distinct = spark.read.parquet(f"{SF}/events.parquet").select("event_type", "props").distinct().count()
    assert spark.table("live_dedupe").count() == distinct
    drain(live.live_last_per_source(event_stream), "live_last")
    assert spark.table("live_last").select("source").distinct().count() == 5
    texts = spark.readStream.schema(spark.read.parquet(f"{SF}/documents.parquet").schema).option("pathGlobFilter", "documents.parquet").parquet(SF)
    drain(live.live_secret_scan(texts, "text", ["doc_id"]), "live_scan")
    assert spark.table("live_scan").filter("shown not like '%…%'").count() == 0


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def updates(stream, folder, seen):
    def take(batch, _):
        for r in batch.collect():
            seen[r.device, r.source] = (r.ts, r.event_id, r.kind)

    q = stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_live_newest_equals_the_batch_answer_over_a_restart(spark, tmp_path, rocks):
    from tracelake.operators.timeline import last_per_source
    t = spark.read.parquet(f"{SF}/events.parquet").select(
        "event_id", (F.col("event_id") % 2).alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), F.col("event_type").alias("kind"), F.col("props").alias("detail"))
    rows = t.withColumn("ts", F.date_trunc("hour", "ts"))
    source, seen = tmp_path / "in", {}
    # The newer half comes first, so the second run brings only late rows and ties; null times are passed over.
    parts = [rows.filter("event_id % 3 > 0"), rows.filter("event_id % 3 = 0"), rows.limit(5).withColumn("ts", F.lit(None).cast("timestamp"))]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        updates(live.live_newest(stream, ["device", "source"], keep=["kind"]), tmp_path / "state", seen)
    batch = last_per_source(rows.withColumn("unix", F.unix_seconds("ts")), "event_id", ["device"])
    want = {(r.device, r.source): (r.unix, r.kind) for r in batch.collect()}
    tie = {(r.device, r.source): r.event_id for r in rows.groupBy("device", "source").agg(F.max_by(F.col("event_id"), F.struct("ts", -F.col("event_id"))).alias("event_id")).collect()}
    assert {k: (int(v[0].timestamp()), v[2]) for k, v in seen.items()} == want and {k: v[1] for k, v in seen.items()} == tie


def test_live_newest_forgets_quiet_keys(spark, tmp_path, rocks):
    import datetime as dt
    schema = "event_id long, device string, ts timestamp, source string, kind string"
    day = lambda n: dt.datetime(2024, 1, n)
    batches = [[(1, "a", day(1), "s", "x"), (2, "b", day(1), "s", "x")], [(3, "b", day(20), "s", "y")], [(4, "b", day(21), "s", "z")], [(5, "a", day(21), "s", "again"), (6, "a", day(2), "s", "late")]]
    seen = {}
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        updates(live.live_newest(stream, ["device", "source"], keep=["kind"], late="1 day", forget_ms=5 * 86_400_000), tmp_path / "state", seen)
    assert {k: v[1:] for k, v in seen.items()} == {("a", "s"): (5, "again"), ("b", "s"): (4, "z")}
    with pytest.raises(ValueError):
        live.live_newest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["device"], late="1 day")
