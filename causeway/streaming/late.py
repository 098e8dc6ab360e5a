"""Campaigns whose files arrive late.

A campaign's rows may come in several micro-batches.  Each batch adds its
mergeable statistics (counts, sums and squares per fold and cell) to a table
partitioned by activity and batch; the effects of the activities it touched are
then computed from all their statistics and replace their earlier rows.  So a
second delivery updates a campaign's result, earlier rows aren't read again,
and a retried batch replaces its own partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from causeway.config import EffectConfig
from causeway.operators.folds import assign_folds
from causeway.operators.joins import caches, join_null_safe, keep
from causeway.operators.mergeable import effect_stats, effects_from_stats, merge_stats
from causeway.session import ensure_checkpoint_dir

GROUP = ["activity_id"]


def _replace(rows: DataFrame, path: str, *parts: str) -> None:
    """Writes rows, replacing the partitions they fall in."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def late_batch_writer(cell: Column, cfg: EffectConfig, stats_path: str, results_path: str,
                      y_scale: int | None = None) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function; rows need activity_id, id, t, y and what ``cell`` reads."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        with caches(batch.sparkSession):
            stats = keep(effect_stats(assign_folds(batch, cfg.n_splits, cfg.seed), cell, GROUP, y_scale=y_scale))
            _replace(stats.withColumn("batch_id", F.lit(batch_id)), stats_path, "activity_id", "batch_id")
            touched = stats.select(*GROUP).distinct()
            schema = batch.sparkSession.read.parquet(stats_path).withColumn(
                "activity_id", F.col("activity_id").cast("string")).schema
            every = batch.sparkSession.read.schema(schema).parquet(stats_path)
            mine = keep(merge_stats(join_null_safe(every, touched, GROUP, how="inner"), GROUP))
            _replace(effects_from_stats(mine, cfg, GROUP, y_scale=y_scale), results_path, "activity_id")
    return run


def start_late_stream(spark: SparkSession, folder: str, schema: StructType, cell: Column, stats_path: str,
                      results_path: str, cfg: EffectConfig = EffectConfig(), name: str = "late",
                      y_scale: int | None = None, available_now: bool = True,
                      files_per_trigger: int | None = None) -> StreamingQuery:
    """Reads ``folder/<activity>/<files>``: the folder a file lies in names its campaign."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(folder).withColumn(
        "activity_id", F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)))
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    writer = (stream.writeStream.foreachBatch(late_batch_writer(cell, cfg, stats_path, results_path, y_scale))
              .option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
