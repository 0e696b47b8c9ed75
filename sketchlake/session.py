"""Sessions, lineage, and the package's code on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "sketchlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join splitting; further settings override.

    Shuffle partitions are left to adaptive coalescing from a generous start, so one setting
    serves a laptop and a cluster.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: what spark.checkpoint.dir names, a temporary one where that is unset on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.getConf().get("spark.checkpoint.dir") and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def checkpoint(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut, in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per context; every operator with Python functions calls it."""
    context = spark.sparkContext
    if getattr(context, "_sketchlake_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="ship"), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)
    context._sketchlake_shipped = True
