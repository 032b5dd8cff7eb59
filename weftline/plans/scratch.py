"""Intermediate tables in the folder that the cluster shares.

``Scratch.keep`` writes a DataFrame as Parquet below ``spark.checkpoint.dir``
and reads it back.  That cuts the lineage (a lost executor costs a re-read, not
a recomputation of everything above), gives the optimizer real sizes, and puts
a plain scan on both sides of the joins that follow, which is what adaptive
execution needs in order to split skewed partitions.

``Scratch.drop`` deletes tables that later ones have replaced, and ``discarded``
all folders that were opened while a result was made and written.  What a result
still reads stays until the driver ends, which deletes the run's folder.
"""

from __future__ import annotations

import contextvars
import gc
import re
import tempfile
import threading
import time
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a single machine) a folder below the
    system's temporary folder is used; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.gettempdir()}/weftline-shared"
    sc.setCheckpointDir(folder)
    return folder


#: Rows in an Arrow batch while intermediate tables are written: texts are long, and each task holds some batches.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Garbage collections between two phases, and seconds after each.
COLLECTIONS, PAUSE = 3, 0.3
_lock = threading.Lock()
_writing: dict[str, list] = {}  # by session: writes that are going on, and the setting before them


def _small_batches(spark: SparkSession, more: int) -> None:
    """Small Arrow batches from the first of some writes at once to the end of the last."""
    name = str(id(spark))
    with _lock:
        if more > 0:
            if name not in _writing:
                _writing[name] = [0, before := spark.conf.get(_ARROW)]
                spark.conf.set(_ARROW, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
            _writing[name][0] += 1
        else:
            _writing[name][0] -= 1
            if not _writing[name][0]:
                spark.conf.set(_ARROW, _writing.pop(name)[1])


_opened: contextvars.ContextVar[list | None] = contextvars.ContextVar("opened", default=None)


@contextmanager
def discarded() -> Iterator[None]:
    """Delete at the end every folder that is opened meanwhile; what they held must have been written elsewhere."""
    opened: list[Scratch] = []
    token = _opened.set(opened)
    try:
        yield
    finally:
        _opened.reset(token)
        for scratch in opened:
            scratch.delete()


class Scratch:
    """A folder of intermediate tables for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        path = self._path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        if (opened := _opened.get()) is not None:
            opened.append(self)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads what was written."""
        at = self.path(name)
        _small_batches(self.spark, 1)
        try:
            df.write.parquet(at)
        finally:
            _small_batches(self.spark, -1)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.paths[id(out)] = out, at
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables of this run that nothing reads any more."""
        for df in kept:
            self._delete(self.paths.pop(id(df))[1])

    def delete(self) -> None:
        """Delete the folder and all its tables."""
        self.paths.clear()
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def settle(self) -> None:
        """Let Spark drop the shuffle files of phases whose output is written.

        Its cleaner removes a shuffle once the driver's garbage collector has
        seen that nothing refers to it any more.  What the cleaner drops after
        one collection may itself refer to a shuffle, so one isn't enough, and
        the cleaner, a thread of its own, needs a moment after each.
        """
        gc.collect()
        for _ in range(COLLECTIONS):
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(PAUSE)
