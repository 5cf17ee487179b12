"""Session helpers shared by every operator: table reading and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root`` (a file or a folder)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a local one only in local mode.

    A session that names none while running on a cluster is an error: a folder of one
    machine would not survive the loss of an executor.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "gridspark-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over the cluster's slots where it has fewer partitions than those.

    Only an input of a few files comes that way, so what is moved is small; a large scan has
    more partitions than slots and stays as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df._jdf.queryExecution().toRdd().getNumPartitions() < slots else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Spark distributes the archive itself, so executors need neither an installation nor a path.
    """
    context = spark.sparkContext
    if getattr(context, "_gridspark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="gridspark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it as long as the application lives
    archive = os.path.join(folder, "gridspark_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("gridspark", os.path.relpath(full, here)))
    context.addPyFile(archive)
    context._gridspark_shipped = True
