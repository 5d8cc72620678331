"""Intermediate tables in the shared checkpoint folder.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``, which the
driver and all executors share, so a lost executor never loses a step's result.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of texts in an Arrow batch, at most.
BATCH_ROWS = 500


def base_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only where none is set and all runs in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='folio-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Holds Arrow batches of the session to ``BATCH_ROWS``: texts may be long, and both the JVM and the worker hold a whole batch."""
    if int(spark.conf.get(_BATCH)) <= 0 or int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


_open: list = []


@atexit.register
def close_all() -> None:
    """Deletes what is left of all tables; results that read them are then gone."""
    while _open:
        scratch = _open.pop()
        if scratch.spark._jvm is not None and scratch.spark._jsc.sc().isStopped() is False:
            scratch.close()


class Scratch:
    """Tables of one operator run. ``keep`` writes one; ``drop`` deletes those no longer needed.

    A result reads its last tables when it is used, so these stay until ``close``
    or the end of the driver's process.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{base_dir(spark)}/folio-{tag}-{uuid.uuid4().hex}"
        self.made: dict[str, int] = {}
        _open.append(self)
        bounded_batches(spark)

    def keep(self, df: DataFrame, name: str, rows: int | None = None, per_file: int = 500_000) -> DataFrame:
        """``rows`` is a bound on the number of rows, if one is known: a small table is one file."""
        if rows is not None:
            df = df.coalesce(-(-max(rows, 1) // per_file))
        self.made[name] = self.made.get(name, -1) + 1
        path = f"{self.root}/{name}-{self.made[name]}"
        before = self.spark.conf.get(_CLEANUP, "false")
        try:
            # the written table replaces the plan, so its shuffle files can go at once
            self.spark.conf.set(_CLEANUP, "true")
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes the latest written version of each name."""
        for name in names:
            self._delete(f"{self.root}/{name}-{self.made[name]}")

    def drop_before(self, name: str) -> None:
        """Deletes the version before the latest one."""
        if self.made.get(name, 0) > 0:
            self._delete(f"{self.root}/{name}-{self.made[name] - 1}")

    def only(self, *names: str) -> None:
        """Deletes all but the latest versions of these names."""
        for name, latest in self.made.items():
            for version in range(latest + 1):
                if name not in names or version < latest:
                    self._delete(f"{self.root}/{name}-{version}")

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
