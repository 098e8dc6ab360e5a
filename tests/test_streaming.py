"""Campaign files dropped in a folder are analysed by the file stream, one
result record per file, the same as the batch plan gives."""

import tempfile

from pyspark.sql import functions as F

from causeway.plans.campaign import CampaignSpec, campaign_analysis
from causeway.sources.panels import customer_cell, panel_customer
from causeway.streaming.arrivals import start_campaign_stream
from conftest import SF01


def test_stream_matches_batch(spark):
    folder = tempfile.mkdtemp(prefix="causeway-arrivals-")
    out = tempfile.mkdtemp(prefix="causeway-sinks-")
    panel = panel_customer(spark, SF01)
    for seg in ("BUILDING", "MACHINERY"):
        panel.where(F.col("seg") == seg).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{seg}")
    # the stream reads the files themselves (one file per campaign)
    import glob
    import shutil

    flat = tempfile.mkdtemp(prefix="causeway-flat-")
    for seg in ("BUILDING", "MACHINERY"):
        f = glob.glob(f"{folder}/{seg}/*.parquet")[0]
        shutil.copy(f, f"{flat}/{seg}.parquet")
    spec = CampaignSpec(activity_id=None, created_at="2026-01-01T00:00:00Z")
    q = start_campaign_stream(spark, flat, panel.schema, customer_cell(), f"{out}/results",
                              f"{out}/uplift", spec, name="t1")
    q.awaitTermination(600)
    res = spark.read.parquet(f"{out}/results").select("activity_uuid", "ate_point").toPandas()
    assert sorted(res.activity_uuid) == ["BUILDING", "MACHINERY"]
    batch, _ = campaign_analysis(panel.where(F.col("seg") == "BUILDING").withColumn("activity_id", F.lit("BUILDING")),
                                 customer_cell(), spec, ["activity_id"])
    want = batch.first()["ate_point"]
    got = res.set_index("activity_uuid").loc["BUILDING", "ate_point"]
    assert abs(want - got) < 1e-6 * max(1.0, abs(want))
