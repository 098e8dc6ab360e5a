"""File sources: CSV with an explicit schema, recoding, folder scan with a
name filter, and the long-form report sink."""

import tempfile

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from causeway.sources import files, sinks
from causeway.sources.panels import panel_customer
from conftest import SF001


def test_csv_schema_and_recode(spark):
    folder = tempfile.mkdtemp(prefix="causeway-csv-")
    p = panel_customer(spark, SF001).select("id", "t", "y", "before_amt", "seg")
    p.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/campaign_a")
    schema = StructType([StructField("id", LongType()), StructField("t", IntegerType()),
                         StructField("y", DoubleType()), StructField("before_amt", DoubleType()),
                         StructField("seg", StringType())])
    df = files.read_campaign_csv(spark, f"{folder}/campaign_a", schema)
    assert df.count() == p.count()
    rec = files.recode(df, log1p_cols=("before_amt",))
    got = rec.agg(F.sum("before_amt")).first()[0]
    want = p.agg(F.sum(F.log1p("before_amt"))).first()[0]
    assert abs(got - want) < 1e-6 * max(1.0, abs(want))


def test_folder_scan_tags_activity(spark):
    df = files.scan_campaign_files(spark, SF001, token="nation")
    assert df.select("activity_id").distinct().collect()[0][0] == "nation"
    assert df.count() == 25


def test_campaign_folders_of_part_files(spark):
    folder = tempfile.mkdtemp(prefix="causeway-folders-")
    for name, n in (("spring_a", 30), ("spring_b", 20), ("autumn", 10)):
        spark.range(n).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}")
    got = files.scan_campaign_files(spark, folder, token="spring", part=-2).groupBy("activity_id").count().collect()
    assert {r["activity_id"]: r["count"] for r in got} == {"spring_a": 30, "spring_b": 20}


def test_retried_batch_writes_once(spark):
    out = tempfile.mkdtemp(prefix="causeway-batches-")
    row = spark.createDataFrame([("a", 1.0)], "activity_uuid string, est double")
    for batch in (0, 0, 1):
        sinks.write_result_records(row.withColumn("batch_id", F.lit(batch)), out)
    assert spark.read.parquet(out).count() == 2


def test_report_sink_appends(spark):
    out = tempfile.mkdtemp(prefix="causeway-report-")
    row = spark.createDataFrame([("a1", 3.0, 4)], "activity_id string, est double, n bigint")
    lf = sinks.long_form(row, ["activity_id"], "result")
    sinks.append_reports(lf, out)
    sinks.append_reports(lf, out)
    back = spark.read.parquet(out)
    assert back.count() == 4 and set(r["key"] for r in back.collect()) == {"est", "n"}
