"""Session defaults and the one way in which this library cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC on; ``conf`` overrides (``_`` stands for ``.``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; only where none is set and the driver runs all tasks itself
    (tests), a local one. On a cluster a folder of one machine would not survive it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder beside the checkpoints, on storage that all executors reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: computed once, kept in the shared folder, safe when executors are lost.

    The checkpoint's own second pass over the plan is avoided by persisting to disk while it is written.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over at least as many partitions as there are cores: a small table in one file would otherwise keep one
    core busy with the dear narrow steps behind it. Tables of many files or row groups are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if found >= cores else df.repartition(cores)
