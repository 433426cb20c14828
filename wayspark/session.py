"""Session settings, the shared work folder, lineage cuts and the view store."""
from __future__ import annotations

import pathlib
import re
import shutil
import sys
import tempfile
from collections.abc import Callable
from functools import lru_cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# UTC keeps day buckets (floor(t / 86400)) and parsed timestamps consistent.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "wayspark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=None)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="wayspark-")


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only for a session of one machine that names none (tests)."""
    application = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = shared if shared else _local_folder(application)
    return f"{base.rstrip('/')}/wayspark-{application}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession) + "/checkpoints")
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@lru_cache(maxsize=None)
def _archive(application: str) -> str:
    root = pathlib.Path(__file__).resolve().parent
    target = f"{tempfile.mkdtemp(prefix='wayspark-code-')}/wayspark"
    return shutil.make_archive(target, "zip", root.parent, root.name)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make the package available in Python workers, once per application: as a file, and by value for
    the runners of stateful streams, which do not see added files."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        cloudpickle.register_pickle_by_value(sys.modules[__package__])
        spark.sparkContext.addPyFile(_archive(application))
        _shipped.add(application)


class ViewStore:
    """Writes each derived view once as a table, so that every later query starts from a
    pruned, pushed-down scan instead of recomputing the chain behind it."""

    _written: dict[tuple[str, str], str] = {}

    def __init__(self, spark: SparkSession, scope: str):
        self.spark, self.scope = spark, scope
        ship_code(spark)

    def view(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, f"{self.scope}/{name}")
        if key not in self._written:
            folder = "".join(c if c.isalnum() else "_" for c in self.scope)
            path = f"{work_dir(self.spark)}/views/{folder}/{name}"
            build().write.mode("overwrite").parquet(path)
            self._written[key] = path
        return self.spark.read.parquet(self._written[key])
