"""Session settings shared by all plans."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoints that no frame uses any more are deleted; a cluster's own settings should say the same.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int = 8, partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
    for key, value in (DEFAULTS | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that they need no install."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    name = f"{package.name}-{os.getpid()}.zip"
    if any(name in path for path in context._python_includes):
        return
    target = Path(tempfile.mkdtemp(prefix=f"{package.name}-"), name)
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir where it is set.

    A folder of this machine is chosen only for a local master, where driver and
    executors are one process; any other master without the setting is an error.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="scriptorium-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def cut(df):
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scan_partitions(spark: SparkSession) -> int:
    """How many partitions a narrow Python stage should have to keep all cores busy."""
    return max(spark.sparkContext.defaultParallelism, 1) * 2
