"""Session settings and the two helpers that touch cluster state."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings every query relies on for right results.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}

# Settings a fresh session gets; an existing cluster session keeps its own.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tracelake", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SCALE_DEFAULTS, **REQUIRED, **(extra or {})}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what correctness needs and ship the package's task code by value."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    import tracelake
    cloudpickle.register_pickle_by_value(tracelake)
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate results: the one the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine (master ``local`` or ``local[...]``) with nothing configured, as in
    tests, gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)
