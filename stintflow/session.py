"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def build_session(master: str = "local[*]", app: str = "stintflow", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; a cluster passes its own master and sizes."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where driver and executors are one process, as in tests, an unset folder is replaced by a
    temporary one, which goes when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="stintflow-")
        atexit.register(shutil.rmtree, _LOCAL["folder"], ignore_errors=True)
    return _LOCAL["folder"]


_SCOPES: list["Scope"] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    if _SCOPES:
        _SCOPES[-1].paths.append(path)
    return path


class Scope:
    """What :func:`passing_tables` watches: the scratch paths made so far, and those that outlive it."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """A table of :func:`cut_lineage` that is read after the scope."""
        kept = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
        self.paths = [p for p in self.paths if os.path.basename(p) not in kept]
        return df


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Scope]:
    """Scratch tables made inside are deleted at the end, after a failure too, but for those that are kept."""
    scope = Scope()
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.remove(scope)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in map(hadoop, scope.paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the table.

    Later readers prune its columns and know its size, lineage ends at the files, and the table outlives
    the executors that wrote it.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut_lineage` that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(folder).startswith("table-"):
            path = hadoop(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
