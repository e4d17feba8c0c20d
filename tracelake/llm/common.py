"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = "_tracelake_worker_tables"


def worker_table(key: Any, build: Callable[[], Any]) -> Any:
    """A read-only table built once per Python worker process and kept across tasks.

    Workers outlive the job that started them: when a table is built, those that only other stages used go.
    """
    holder = sys.modules.setdefault(_OWN, types.ModuleType(_OWN))
    tables = holder.__dict__.setdefault("tables", {})
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if key not in tables:
        for other in [k for k, (_, used) in tables.items() if used != stage]:
            del tables[other]
        tables[key] = (build(), stage)
    table = tables[key][0]
    tables[key] = (table, stage)
    return table


def carried(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function for tasks that gives ``value``, sent once to each executor.

    The value travels as cloudpickle bytes that hold this package's code too, so that workers which
    can't import the package read it like any other.
    """
    import tracelake
    cloudpickle.register_pickle_by_value(tracelake)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def hidden(df: DataFrame, used: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``used`` under names that clash with none, and the columns that restore the old names."""
    names = {c: c if c in used else f"__own{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a worker makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Rows that Spark sends to a Python worker at once while texts are read.
TEXTS = "2500"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting ``name`` is ``value`` inside; what it was before is put back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that are run inside send ``TEXTS`` rows at a time to Python, unless the session asks for fewer.

    Whole texts and sets are wide: Spark's own batches of 10 000 rows are held by the executor and by
    the worker at the same time. The session's setting is put back afterwards.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with setting(spark, name, before if 0 < int(before) <= int(TEXTS) else TEXTS):
        yield


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``.

    Only a session without that setting (tests on one machine) gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/t-{uuid.uuid4().hex}"
    atexit.register(drop_folder, spark, path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_folder``; quiet if the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone and with it the cluster's folder
        pass


def stored(df: DataFrame, *, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    Nothing reads the shuffles of the write again, so Spark deletes their files when it ends and not
    when the driver's garbage collector finds them.
    """
    path = shared_folder(df.sparkSession)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; what was made from them must be stored itself."""
    for table in tables:
        drop_folder(table.sparkSession, table._stored_at)


#: log2 of the bits of a sieve: its size (1 MB) does not depend on the data.
SIEVE_BITS = 23


def sift(df: DataFrame, key: str, keys: DataFrame, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """The rows of ``df`` whose long ``key`` may be in ``keys`` (one column); all that are in it stay.

    With ``then`` what this function of batches makes of them, as ``schema``, in the same worker.

    A bitmap of fixed size is filled from the keys in Spark and sent to the tasks, so that wide
    rows which a later join would drop are not shuffled for it. More keys only let more rows pass.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SIEVE_BITS))
    named = keys.toDF("key").select(slot("key").alias("slot"))
    words = named.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits"))
    table = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for row in words.collect():
        table[row["word"]] = row["bits"]
    sent = df.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            kept = (sent.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(kept.astype(bool)))

    if then is None:
        then, schema = iter, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(slot(key).alias("__slot"), "*").mapInArrow(lambda batches: then(run(batches)), schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
