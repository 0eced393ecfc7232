"""Session helpers: tuned builder, shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, name: str = "riskloom", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on.

    Shuffle partitions are left to the cluster (AQE coalesces them); callers
    pass ``spark.sql.shuffle.partitions`` for local runs.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Keyed streaming state needs a store that spills to disk.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of a generated method beyond which the JVM never compiles but only interprets it.
COMPILED_BYTES = 8000
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Wide projections that run meanwhile are generated in methods small enough to be compiled."""
    before = spark.conf.get(HUGE_METHOD, None)
    spark.conf.set(HUGE_METHOD, COMPILED_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(HUGE_METHOD)
        else:
            spark.conf.set(HUGE_METHOD, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, because all its tasks share one machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="riskloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers once per application, so that its functions can be imported there."""
    context = spark.sparkContext
    if getattr(context, "_riskloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(SparkFiles.getRootDirectory(), "riskloom-package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._riskloom_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a cached copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame in a folder of its own, for those that :func:`discard` it."""
    path = f"{shared_folder(df.sparkSession)}/riskloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written frame that no plan reads any more."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
