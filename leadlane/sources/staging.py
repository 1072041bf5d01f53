"""Intermediate tables in the folder that all machines of the cluster share.

Results that are read several times, or whose rows carry positions, are written here once and read back, so
that a lost executor costs a re-read and not a recomputation with other positions.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_dirs: dict[str, str] = {}

# Tables of at most this many rows of a few numbers each, some 40 bytes, are broadcast: 20 MB at most.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="leadlane-")
    return _local_dirs[context.applicationId]


def file_system(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_bytes(spark: SparkSession, path: str) -> int | None:
    """Total size of a file, folder or glob; None if there is nothing."""
    hadoop_path, files = file_system(spark, path)
    found = files.globStatus(hadoop_path)
    return sum(files.getContentSummary(f.getPath()).getLength() for f in found) if found else None


def finished_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders of a glob that a Spark job has written to the end."""
    hadoop_path, files = file_system(spark, f"{pattern}/_SUCCESS")
    return [f.getPath().getParent().getName() for f in files.globStatus(hadoop_path) or ()]


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path, files = file_system(spark, path)
    files.delete(hadoop_path, True)


class Workspace:
    """A sub-folder of the shared folder for the intermediate tables of one run.

    With a ``key``, which stands for all that the tables depend on, an interrupted run leaves its tables, and the next
    one with that key reads those that were written to the end instead of writing them again, up to the first that was
    not. Only one run with a key may be at work at a time.
    """

    def __init__(self, spark: SparkSession, key: str | None = None):
        self.spark = spark
        self.key = key
        self.root = f"{shared_dir(spark)}/leadlane-{key or uuid.uuid4().hex}"
        self._tables = 0
        self._resuming = key is not None
        if key is None:
            atexit.register(self._clear_at_exit)

    def _next_path(self, name: str) -> str:
        self._tables += 1
        return f"{self.root}/{self._tables:02d}-{name}"

    def _has(self, path: str) -> bool:
        """Whether an earlier run has written this table; after the first that it has not, later ones do not count."""
        self._resuming = self._resuming and bool(finished_folders(self.spark, path))
        return self._resuming

    def stage(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write a table and return it as a scan of what was written."""
        path = self._next_path(name)
        if not self._has(path):
            writer = df.write.partitionBy(partition_by) if partition_by else df.write
            writer.mode("overwrite" if self.key else "errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stage_counted(self, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """The same with aggregates of the rows, which the write itself observes."""
        seen = Observation()
        counted = df.observe(seen, *[c.alias(n) for n, c in counts.items()])
        if not self.key:
            return self.stage(counted, name), seen.get
        # The counts are written after the table, so a table without its counts is not finished.
        path = self._next_path(name)
        if not self._has(f"{path}-counts"):
            counted.write.mode("overwrite").parquet(path)
            rows = self.spark.createDataFrame([*seen.get.items()], "name string, n long")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{path}-counts")
        found = self.spark.read.schema("name string, n long").parquet(f"{path}-counts").collect()  # one row per counter
        return self.spark.read.schema(df.schema).parquet(path), {r["name"]: r["n"] for r in found}

    def bytes_of(self, staged: DataFrame) -> int:
        """Size of the files of a staged table."""
        files = staged.inputFiles()
        return (path_bytes(self.spark, files[0].rsplit("/", 1)[0]) or 0) if files else 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, error: type | None, *_) -> None:
        if error is None or not self.key:
            self.clear()

    def clear(self) -> None:
        """Delete the tables of this run; DataFrames that read them can no longer be used."""
        delete_path(self.spark, self.root)
        atexit.unregister(self._clear_at_exit)

    def _clear_at_exit(self) -> None:
        """Tables that nobody cleared go with the process, if its session still runs."""
        with contextlib.suppress(Exception):
            if not self.spark.sparkContext._jsc.sc().isStopped():
                self.clear()


def workspace_of(df: DataFrame, workspace: Workspace | None) -> Workspace:
    return workspace or Workspace(df.sparkSession)
