"""Bucketed tables of many devices: per-device work without an exchange."""

import uuid

import pytest
from pyspark.sql import functions as F

from tracelake.operators import messages as M
from tracelake.operators import timeline as TL
from tracelake.operators.browser import visits_with_urls
from tracelake.sinks.fleet import drop_buckets, write_buckets


@pytest.fixture()
def names(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    db = f"fleet_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_path}'")
    yield [f"{db}.a", f"{db}.b"]
    drop_buckets(spark, f"{db}.a", f"{db}.b")
    spark.sql(f"DROP DATABASE {db}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_joins_and_groups_need_no_exchange(spark, names):
    # One device holds most rows: buckets by device and id spread it.
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("device"), (F.col("id") % 700).alias("url_id"), F.col("id").alias("visit_id"))
    addresses = spark.range(700).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("device"), "id").withColumn("url", F.concat_ws("/", "device", F.col("id").cast("string")))
    v = write_buckets(rows, names[0], ["device", "url_id"], 8)
    u = write_buckets(addresses.withColumnRenamed("id", "url_id"), names[1], ["device", "url_id"], 8, ["url_id"]).withColumnRenamed("url_id", "id")
    joined = visits_with_urls(v, u, ["device"])
    assert exchanges(joined) == 0
    assert joined.count() == 3000 and joined.where(~F.col("address").startswith(F.col("device"))).count() == 0
    sizes = [r["count"] for r in v.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 0.3 * sum(sizes)


def test_groups_by_device_need_no_exchange(spark, names):
    rows = spark.range(500).select((F.col("id") % 4).alias("device"), (F.col("id") * 7 % 100).alias("unix"), F.col("id").alias("event_id"), F.lit("s").alias("source"),
                                   F.lit("crash").alias("kind"), F.lit("").alias("detail"), F.lit("p").alias("package"))
    t = write_buckets(rows, names[0], ["device"], 4)
    for answer in (TL.counts_by_axis(t, ["device"]), TL.last_per_source(t, "event_id", ["device"]), TL.latest_event(t, "event_id", by=["device"]),
                   TL.per_service(t, "event_id", ["device"]), TL.timeline_tail(t, 3, "event_id", ["device"])):
        assert exchanges(answer) == 0 and answer.select("device").distinct().count() == 4


def test_people_stay_on_their_device(spark):
    threads = spark.createDataFrame([("a", "G:1", None), ("b", "G:1", None)], "device string, thread_key string, name string")
    members = spark.createDataFrame([("a", "G:1", "u"), ("b", "G:1", "u")], "device string, thread_key string, user_key string")
    users = spark.createDataFrame([("a", "u", "Ann"), ("b", "u", "Bob")], "device string, user_key string, name string")
    assert sorted((r.device, r.name) for r in M.name_threads(threads, members, users, ["device"]).collect()) == [("a", "Ann"), ("b", "Bob")]
