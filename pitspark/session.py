"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Results depend on these two: instants are compared in UTC, and bad arithmetic
# or casts must raise unless an operator asks for a NULL with try_*.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Plan quality only; a cluster may already set its own values.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to an existing session."""
    for key, value in {**SEMANTIC_CONF, **PLAN_CONF}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, name: str = "pitspark") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", os.environ.get("PITSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SEMANTIC_CONF, **PLAN_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables: the session's ``spark.checkpoint.dir``.

    Where it is unset and one machine does all the work, one folder is made and set for the whole session, and goes
    when Python ends. Executors elsewhere could not read it, so other masters must set it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext._jsc.sc().isLocal():
        folder = tempfile.mkdtemp(prefix="pitspark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
        return f"file://{folder}"
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def reliable_checkpoint(df):
    """Cut lineage through the shared checkpoint folder (survives executor loss)."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)
