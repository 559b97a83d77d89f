"""Session helpers: configuration, checkpoint folder and table loading."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Defaults of runs for which the caller names a local master; others get none of them.
_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def _submitted() -> SparkConf | None:
    """Settings that spark-submit or a shell gave; None where this process starts Spark
    itself, without any."""
    if not any(os.environ.get(k) for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_SUBMIT_ARGS")) and SparkContext._active_spark_context is None:
        return None
    SparkContext._ensure_initialized()  # they are known to the JVM alone
    return SparkConf()


def get_spark(master: str | None = None, app: str = "scriptorium", **conf: str) -> SparkSession:
    """The session.  ``conf`` is set as given; local defaults only if ``master`` names a
    local one, and only where nothing was submitted for a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local["):
        given = _submitted()
        for k, v in _LOCAL_CONF.items():
            if k not in conf and not (given is not None and given.contains(k)):
                builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    On a cluster the setting names a folder every executor can reach and it is
    used as is.  Only when it is unset (local tests) a scratch folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="scriptorium-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` (by all columns, if none) over the shuffle partitions: a scan
    of few splits would leave all that is made of its rows in as few tasks.  The count is
    named, so that partitions of small rows are not put together before they grow."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or df.columns))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` under ``sf_dir``, as the scan splits it."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
