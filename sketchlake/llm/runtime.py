"""Session plumbing shared by the corpus operators: code shipping and cutting lineage.

Nothing here looks at data. The operators only ever use the session they are
given, so the same code runs in local tests and on a cluster.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_sketchlake_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="ship"), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)
    context._sketchlake_shipped = True


def checkpoint(frame: DataFrame) -> DataFrame:
    """The frame read back from the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the cluster's ``spark.checkpoint.dir``; only where that is
    unset (single-machine tests) a temporary one is made.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.getConf().get("spark.checkpoint.dir") and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def store(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder as Parquet and read back; for rows with whole texts."""
    path = f"{shared_folder(frame.sparkSession)}/{uuid.uuid4().hex}.parquet"
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle and checkpoint files that no frame refers to any more.

    Spark deletes them when the driver collects its garbage, which a driver with
    little to do does seldom; after a large shuffle it is worth asking for.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable) -> Callable:
    """A batch function that hands freed memory back when its task ends; workers are reused, and what allocators hold on to adds up."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def frequency_floor(counts: DataFrame, name: str, limit: int) -> int:
    """The smallest power of two such that at most ``limit`` rows have a count of at least that; what comes to the driver is a row per power."""
    power = F.floor(F.log2(F.col(name).cast("double") + 0.5)).cast("int")  # the half keeps rounding from a power's own edge
    rows = counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()
    held = floor = 0
    for p, n in sorted(rows, reverse=True):
        held += n
        if held > limit:
            return floor or 1 << (p + 1)
        floor = 1 << p
    return 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
