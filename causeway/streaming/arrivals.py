"""Campaign files analysed as they arrive (Structured Streaming).

A folder receives one panel file per campaign.  ``start_campaign_stream``
reads it as a file stream; every micro-batch holds the rows of newly
arrived files, tagged with their file name as ``activity_id``, and is
analysed by the grouped campaign plan — all campaigns of the batch in one
job — then the result records and the treated rows' uplift are written to
sinks partitioned by activity and batch.  The stream's checkpoint lives under
the session's shared checkpoint folder, so a restarted job resumes where it
stopped; a batch that is retried replaces its own partitions.  A campaign
whose files arrive in several batches has one result per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from causeway.operators.joins import caches
from causeway.plans.campaign import CampaignSpec, campaign_analysis, result_record
from causeway.session import ensure_checkpoint_dir
from causeway.sources.sinks import write_result_records, write_user_uplift


def campaign_batch_writer(cell: Column, spec: CampaignSpec, results_path: str,
                          uplift_path: str) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        with caches(batch.sparkSession):
            res, uplift = campaign_analysis(batch, cell, spec, ["activity_id"])
            write_result_records(result_record(res, spec).withColumn("batch_id", F.lit(batch_id)), results_path)
            write_user_uplift(uplift.withColumn("batch_id", F.lit(batch_id)), uplift_path)
    return run


def start_campaign_stream(spark: SparkSession, folder: str, schema: StructType, cell: Column,
                          results_path: str, uplift_path: str, spec: CampaignSpec | None = None,
                          name: str = "campaigns", available_now: bool = True,
                          files_per_trigger: int | None = None) -> StreamingQuery:
    spec = spec or CampaignSpec(activity_id=None)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(folder).withColumn(
        "activity_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    writer = (stream.writeStream.foreachBatch(campaign_batch_writer(cell, spec, results_path, uplift_path))
              .option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
