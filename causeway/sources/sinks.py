"""Result sinks: report rows appended per activity, the nested result record
and the per-user uplift table, all partitioned by activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_reports(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append long-form report rows (activity_id, section, key, value).  Rows that
    carry a ``run_id`` replace those of the same activity and run, so a job that
    is run again writes once."""
    if "run_id" in report.columns:
        (report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("activity_id", "run_id").format(fmt).save(path))
    else:
        report.write.mode("append").partitionBy("activity_id").format(fmt).save(path)


def write_result_records(records: DataFrame, path: str) -> None:
    _write(records, path)


def write_user_uplift(uplift: DataFrame, path: str) -> None:
    _write(uplift, path)


def _write(rows: DataFrame, path: str) -> None:
    """Appends rows by activity.  Rows of a stream carry ``batch_id``: then only
    the partitions of that batch are replaced, so a retried batch writes once."""
    if "batch_id" in rows.columns:
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("activity_uuid", "batch_id").parquet(path))
    else:
        rows.write.mode("append").partitionBy("activity_uuid").parquet(path)


def long_form(result: DataFrame, keys: list[str], section: str) -> DataFrame:
    """Every numeric column of a result row as (key, value) rows."""
    nums = [c for c, t in result.dtypes if c not in keys and t in ("double", "bigint", "int", "float")]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in nums])
    return result.select(*keys, F.lit(section).alias("section"), F.explode(pairs).alias("_kv")) \
        .select(*keys, "section", "_kv.key", "_kv.value")
