"""SparkSession defaults, and cutting of lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with this engine's defaults; any may be overridden."""
    return SparkSession.builder.master(master).appName("inkwell").config(map={**DEFAULTS, **conf}).getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches sent to Python workers small whatever the texts' lengths."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")):
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001  a setting that this Spark does not have
            pass


def own_dir(master: str) -> str:
    """A temporary folder, for local masters alone: on a cluster it would be another one on each machine."""
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="inkwell-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder of spark.checkpoint.dir (our own only where that is unset on a local master), so that a lost executor loses nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or own_dir(context.master))
    return df.checkpoint()
