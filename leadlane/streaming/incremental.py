"""Leads that keep arriving: a file stream with exact deduplication over everything received so far.

Cleaning and scoring of a row need nothing but the row, so they run once, in the micro-batch that brings it.
Which record of a group is kept can still change with any later row. A winner is a minimum, and a minimum of
minima is the overall minimum, so each batch only adds its own rows and its own winners; nothing written
before is touched. A batch that is retried after a failure replaces its own folders, so it counts once.

Winners form a log-structured table. The winners of ``MERGE_EVERY`` neighbouring batches are merged into a run of the
next level, those of as many runs into one of the level above, and so on, so a reader opens a number of folders that
grows with the logarithm of the number of batches. The largest run is not merged again to be read: only its keys that
later runs touch are decided anew.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlane import rules
from leadlane.operators.clean import clean_rows
from leadlane.operators.dedup import best_per_key, look_up_winners
from leadlane.operators.scoring import score_parts
from leadlane.plans.qualify import LeadRun
from leadlane.sources.lead_csv import read_leads_csv
from leadlane.sources.staging import Workspace, delete_path, finished_folders

RAW_SCHEMA = T.StructType(
    [T.StructField("source_row", T.LongType())] + [T.StructField(c, T.StringType()) for c in rules.COLUMNS]
)
KEY = "lead_id_canonical"
# Runs of a level that make one of the next.
MERGE_EVERY = 8
# Files of a batch, where the caller does not say.
FEWEST_FILES = 4
FILES_PER_CORE = 2
# Fixed by Spark's source for whole files.
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _merge_winners(runs: DataFrame) -> DataFrame:
    """One row per key: the winner of its winners, and all its rows."""
    return runs.groupBy("win_key").agg(F.min("winner").alias("winner"), F.sum("group_rows").alias("group_rows"))


def _level_and_run(name: str) -> tuple[int, int]:
    level, run = name.split("-")
    return int(level), int(run)


class LeadStream:
    """Rows and winners of a stream under one folder that all executors can reach.

    A row is known by its file and its number in it. A batch counts from the moment its marker is written, which
    comes last, so readers never see rows without their winners.
    """

    def __init__(self, spark: SparkSession, folder: str, merge_every: int = MERGE_EVERY):
        self.spark = spark
        self.merge_every = merge_every
        self.rows_path = f"{folder}/rows"
        self.winners_path = f"{folder}/winners"
        self.published_path = f"{folder}/published"
        self.merged_path = f"{folder}/merged"
        self.checkpoint_path = f"{folder}/checkpoint"

    def add_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Clean and score the rows of one micro-batch, write them with the winners among them, then publish both."""
        marker = f"{self.published_path}/batch={batch_id}"
        self._withdraw(batch_id)
        if "source_file" not in batch.columns:
            batch = batch.withColumn("source_file", F.lit(""))
        folder = f"{self.rows_path}/batch={batch_id}"
        score_parts(clean_rows(batch)).write.mode("overwrite").parquet(folder)
        written = self.spark.read.parquet(folder)
        best = best_per_key(written.filter("reason IS NULL"), KEY, rules.COMPLETENESS_FIELDS)
        best.write.mode("overwrite").parquet(f"{self.winners_path}/batch={batch_id}")
        self.spark.range(1).write.mode("overwrite").parquet(marker)
        self.merge(batch_id)

    def _withdraw(self, batch_id: int) -> None:
        """A batch that comes again counts no longer, nor do the runs that hold it, from the largest on."""
        for name in sorted(finished_folders(self.spark, f"{self.merged_path}/*"), key=_level_and_run, reverse=True):
            level, run = _level_and_run(name)
            if batch_id in self._batches_of(level, run):
                delete_path(self.spark, f"{self.merged_path}/{name}")
        delete_path(self.spark, f"{self.published_path}/batch={batch_id}")

    def _batches_of(self, level: int, run: int) -> range:
        width = self.merge_every**level
        return range(run * width, (run + 1) * width)

    def _folder_of(self, level: int, run: int) -> str:
        return f"{self.merged_path}/{level}-{run}" if level else f"{self.winners_path}/batch={run}"

    def merge(self, batch_id: int) -> None:
        """Write the runs that a batch completes. A run counts once its folder is finished; until then, its parts do."""
        merged, published = self.merged_runs(), set(self.published())
        level, run = 1, batch_id // self.merge_every
        while published.issuperset(self._batches_of(level, run)):
            if (level, run) not in merged:
                parts = range(run * self.merge_every, (run + 1) * self.merge_every)
                held = self._read_runs([(level - 1, part) for part in parts])
                _merge_winners(held).write.mode("overwrite").parquet(self._folder_of(level, run))
            level, run = level + 1, run // self.merge_every

    def merged_runs(self) -> set[tuple[int, int]]:
        """Level and number of the runs that are finished."""
        return {_level_and_run(name) for name in finished_folders(self.spark, f"{self.merged_path}/*")}

    def runs(self, batches: list[int]) -> list[tuple[int, int]]:
        """The fewest runs (batches are those of level 0) that hold exactly these batches, largest first."""
        left, chosen = set(batches), []
        for level, run in sorted(self.merged_runs(), reverse=True):
            inside = self._batches_of(level, run)
            if left.issuperset(inside):
                chosen.append((level, run))
                left.difference_update(inside)
        return chosen + [(0, b) for b in sorted(left)]

    def _read_runs(self, runs: list[tuple[int, int]]) -> DataFrame:
        columns = ("win_key", "winner", "group_rows")
        return self.spark.read.parquet(*[self._folder_of(*r) for r in runs]).select(*columns)

    def add_exports(self, files: DataFrame, batch_id: int) -> None:
        """One micro-batch of CSV exports, given by their paths."""
        paths = [unquote(r["path"]) for r in files.select("path").collect()]  # as many as a trigger may bring
        with Workspace(self.spark) as workspace:
            raw = read_leads_csv(self.spark, paths, workspace=workspace)
            self.add_batch(raw.drop("source_row").withColumnRenamed("file_row", "source_row"), batch_id)

    def writer(self, raw: DataFrame):
        """The stream writer of a streaming DataFrame of raw leads."""
        return raw.writeStream.foreachBatch(self.add_batch).option("checkpointLocation", self.checkpoint_path)

    def read_inbox(self, inbox: str, files_per_batch: int) -> DataFrame:
        reader = self.spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(inbox).withColumn("source_file", F.col("_metadata.file_path"))

    def _files(self, files_per_batch: int | None) -> int:
        return files_per_batch or max(FEWEST_FILES, FILES_PER_CORE * self.spark.sparkContext.defaultParallelism)

    def drain(self, inbox: str, files_per_batch: int | None = None) -> None:
        """Process everything in a folder of Parquet files of raw leads that is not yet processed, then stop.

        By default a batch has files for every core, so that none waits while a few read.
        """
        files_per_batch = self._files(files_per_batch)
        self.writer(self.read_inbox(inbox, files_per_batch)).trigger(availableNow=True).start().awaitTermination()

    def drain_exports(self, inbox: str, files_per_batch: int | None = None) -> None:
        """The same for a folder of CSV exports, which only ever gets new files."""
        # Contents are not selected, so this reads no more than the listing.
        found = self.spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("maxFilesPerTrigger", self._files(files_per_batch)).load(inbox)
        stream = found.select("path").writeStream.foreachBatch(self.add_exports)
        stream.option("checkpointLocation", f"{self.checkpoint_path}-exports").trigger(availableNow=True).start().awaitTermination()

    def published(self) -> list[int]:
        """Numbers of the batches that count."""
        return sorted(int(name.split("=")[1]) for name in finished_folders(self.spark, f"{self.published_path}/batch=*"))

    def rows(self, batches: list[int]) -> DataFrame:
        """Rows of published batches; other folders are not read."""
        return self.spark.read.option("basePath", self.rows_path).parquet(*[f"{self.rows_path}/batch={b}" for b in batches]).drop("batch")

    def winners(self, batches: list[int]) -> DataFrame:
        """Winner and size of every group with more than one row, over the batches.

        Groups of the largest run that no later run touches are read as they are: its single rows never leave the scan.
        """
        first, *later = self.runs(batches)
        largest, several = self._read_runs([first]), F.col("group_rows") > 1
        if not later:
            return largest.filter(several)
        newer = self._read_runs(later)
        touched = newer.select("win_key").distinct()
        again = _merge_winners(largest.join(touched, "win_key", "left_semi").unionAll(newer))
        return largest.filter(several).join(touched, "win_key", "left_anti").unionAll(again.filter(several))

    def current(
        self,
        contact_now: float = rules.CONTACT_NOW_THRESHOLD,
        nurture: float = rules.NURTURE_THRESHOLD,
    ) -> LeadRun:
        """The run over all rows published so far, equal to one batch run over the same rows.

        Before the first batch it is empty. ``ROW-n`` ids and ``source_row`` count within a file here.
        """
        batches = self.published()
        if batches:
            rows, won = self.rows(batches), self.winners(batches)
        else:
            none = self.spark.createDataFrame([], RAW_SCHEMA).withColumn("source_file", F.lit(""))
            rows = score_parts(clean_rows(none))
            won = best_per_key(rows, KEY, rules.COMPLETENESS_FIELDS)
        resolved = look_up_winners(rows, won, F.when(F.col("reason").isNull(), F.col(KEY)))
        decided = resolved.withColumn("reason", F.coalesce("reason", F.when(~F.col("is_primary"), rules.DUPLICATE)))
        return LeadRun(decided, decided.filter("reason IS NULL"), contact_now, nurture)
