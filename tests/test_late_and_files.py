"""Late files of a campaign, CSV rejects, sources with fallback, panel checks, band and gate."""

import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from causeway.config import EffectConfig
from causeway.operators import clean, distill, estimate
from causeway.operators.mergeable import effect_stats, effects_from_stats, merge_stats
from causeway.operators.nuisance.strata import strata_nuisance
from causeway.plans.common import customer_folds
from causeway.sources import files, sinks
from causeway.sources.panels import customer_cell, panel_customer
from causeway.streaming.late import late_batch_writer, start_late_stream
from conftest import SF001, SF01

CFG = EffectConfig()


def whole_effects(panel, cfg=CFG):
    """(estimand → row) of the row-level estimators."""
    nuis = strata_nuisance(panel, customer_cell(), cfg)
    return {e: estimate.effect_table(nuis, e, cfg).first() for e in estimate.ESTIMANDS}


def same(a, b):
    return all(np.isclose(a[c], b[c], rtol=1e-8) for c in ("n", "n_treated", "n_control", "est", "se", "ci_lo", "ci_hi"))


@pytest.mark.parametrize("cfg", [CFG, EffectConfig(weight_clip=0.9, ps_clip=(0.2, 0.8))])
def test_statistics_give_the_row_level_effects(spark, cfg):
    panel = customer_folds(spark, SF01).withColumn("y", F.when(F.col("id") % 11 > 0, F.col("y")))   # some outcomes are missing
    parts = [effect_stats(panel.where(F.col("id") % 4 == i), customer_cell()) for i in range(4)]
    merged = merge_stats(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    got = {r.estimand: r for r in effects_from_stats(merged, cfg).collect()}
    want = whole_effects(panel, cfg)
    assert all(same(got[e], want[e]) for e in want)
    assert effects_from_stats(merged.limit(0), cfg).count() == 0


def test_three_deliveries_update_one_result(spark, tmp_path):
    """A campaign split over three batches gives the batch result; another comes once."""
    panel = panel_customer(spark, SF01)
    for i in range(3):
        part = panel.where((F.col("seg") == "BUILDING") & (F.col("id") % 3 == i))
        part.coalesce(1).write.parquet(f"{tmp_path}/out/{i}")
    panel.where(F.col("seg") == "MACHINERY").coalesce(1).write.parquet(f"{tmp_path}/out/m")
    folder = tmp_path / "in"
    for name, src, dst in (("0", "0", "spring sale"), ("m", "m", "autumn"), ("1", "1", "spring sale"), ("2", "2", "spring sale")):
        target = folder / dst
        target.mkdir(parents=True, exist_ok=True)
        shutil.copy(next((tmp_path / "out" / src).glob("*.parquet")), target / f"{name}.parquet")
        q = start_late_stream(spark, str(folder), panel.schema, customer_cell(), f"{tmp_path}/stats", f"{tmp_path}/effects",
                              name=f"late-{tmp_path.name}")
        q.awaitTermination(600)
        assert q.exception() is None
    got = {(r.activity_id, r.estimand): r for r in spark.read.parquet(f"{tmp_path}/effects").collect()}
    assert {a for a, _ in got} == {"spring sale", "autumn"} and len(got) == 6
    for activity, seg in (("spring sale", "BUILDING"), ("autumn", "MACHINERY")):
        want = whole_effects(customer_folds(spark, SF01).where(F.col("seg") == seg))
        assert all(same(got[activity, e], want[e]) for e in want)
    # the stream's statistics came in three batches, and a batch that is run again changes nothing
    assert spark.read.parquet(f"{tmp_path}/stats").where("activity_id = 'spring sale'").select("batch_id").distinct().count() == 3


def test_a_batch_run_again_counts_once_and_null_activities_stay(spark, tmp_path):
    panel = panel_customer(spark, SF001).withColumn("activity_id", F.when(F.col("region") > 0, F.lit("a")))
    run = late_batch_writer(customer_cell(), CFG, f"{tmp_path}/stats", f"{tmp_path}/effects")
    half = panel.where("id % 2 = 0")
    for batch, rows in ((0, half), (0, half), (1, panel.where("id % 2 = 1")), (2, panel.limit(0))):
        run(rows, batch)
    got = {r.activity_id: r.n for r in spark.read.parquet(f"{tmp_path}/effects").where("estimand = 'ATE'").collect()}
    assert got == {None: panel.where("region = 0").count(), "a": panel.where("region > 0").count()}


SCHEMA = StructType([StructField("id", LongType()), StructField("t", IntegerType()), StructField("y", DoubleType()),
                     StructField("seg", StringType())])


def test_broken_csv_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t,y,seg\n1,0,2.5,x\n2,one,2.5,x\n3,1,,y\n4,1,3.5\n5,1,NaN,z\n6,0,1.0,x,extra\n")
    (tmp_path / "b c.csv").write_text("id,t,y,seg\n7,0,oops,x\n")
    good, rejects = files.read_csv_split(spark, str(tmp_path), SCHEMA)
    assert sorted(r.id for r in good.collect()) == [1, 3, 5]
    assert {r.id: r.y for r in good.collect()}[3] is None
    assert sorted((r.file, r.line) for r in rejects.collect()) == [
        ("a.csv", "2,one,2.5,x"), ("a.csv", "4,1,3.5"), ("a.csv", "6,0,1.0,x,extra"), ("b c.csv", "7,0,oops,x")]
    assert sorted((r.file, r.n_rejected) for r in files.reject_counts(rejects).collect()) == [("a.csv", 3), ("b c.csv", 1)]
    assert files.read_campaign_csv(spark, str(tmp_path), SCHEMA).count() == 3


def test_first_available_source(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,t,y,seg\n1,0,2.5,x\n")
    spark.createDataFrame([(9, 1, 1.0, "p", 0)], "id long, t int, y double, seg string, more int").write.parquet(f"{tmp_path}/p")
    get = lambda *s: [r.id for r in files.first_available(spark, s, SCHEMA).collect()]
    assert get(("csv", f"{tmp_path}/none.csv"), ("parquet", f"{tmp_path}/p")) == [9]
    assert get(("csv", f"{tmp_path}/x.csv"), ("parquet", f"{tmp_path}/p")) == [1]
    with pytest.raises(FileNotFoundError, match="none.csv.*no_such"):
        files.first_available(spark, [("csv", f"{tmp_path}/none.csv"), ("table", "no_such")], SCHEMA)


def test_panels_are_checked(spark):
    ok = spark.createDataFrame([(1, 0, 1.0), (2, 1, None)], "id long, t int, y double")
    assert files.validate_panel(ok) is ok
    bad = spark.createDataFrame([(1, 2, 1.0), (1, None, float("nan")), (None, 1, 1.0)], "id long, t int, y double")
    with pytest.raises(ValueError, match="t_invalid.*id_repeated"):
        files.validate_panel(bad)
    row = files.panel_faults(bad).first().asDict()
    assert row == {"n": 3, "t_null": 1, "t_invalid": 1, "y_null": 0, "y_not_finite": 1, "id_null": 1, "id_repeated": 1}
    assert files.panel_faults(bad.limit(0)).first()["n"] == 0


def test_reports_of_a_run_are_written_once(spark):
    out = tempfile.mkdtemp(prefix="causeway-report-")
    row = spark.createDataFrame([("a1", "k", 3.0)], "activity_id string, key string, value double")
    for run in ("r1", "r1", "r2"):
        sinks.append_reports(row.withColumn("run_id", F.lit(run)), out)
    assert spark.read.parquet(out).count() == 2


def test_band_falls_back_by_group(spark):
    rows = [("wide", i, i % 2, 0.5) for i in range(200)] + [("few", 1000 + i, i % 2, 0.5 if i < 10 else 0.95) for i in range(200)] + \
           [("base", 2000 + i, i % 2, 0.5 if i < 70 else 0.15 if i < 90 else 0.99) for i in range(200)] + \
           [(None, 3000 + i, 1, 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id long, t int, e double")
    got = {r.g: r["count"] for r in clean.banded(df, (0.2, 0.8), 5, group=["g"]).groupBy("g").count().collect()}
    assert got == {"wide": 200, "few": 200, "base": 90, None: 200}
    assert clean.banded(df.where("g = 'base'"), (0.2, 0.8), 5).count() == 90


def test_metrics_behind_the_gate(spark):
    df = spark.createDataFrame([("a", i, 1.0, 1.0 if i < 40 else None) for i in range(50)] + [(None, i, 1.0, None) for i in range(50)],
                               "g string, id long, psi double, tau double")
    m = df.groupBy("g").agg(F.count("*").alias("n"), F.avg("psi").alias("nauuc"))
    got = {r.g: r for r in clean.gated(m, df, 5, group=["g"]).collect()}
    assert got["a"].nauuc == 1 and got["a"].note is None and got[None].nauuc is None and got[None].note and got[None].n == 50
    assert clean.gated(m.where("g IS NULL").drop("g"), df.where("g IS NULL"), 5, zero=True).first()["nauuc"] == 0


def test_policy_ratio_counts_every_k(spark):
    """A k whose teacher value is negative, and one whose value is 0, count in the mean."""
    psi = [-4.0] * 10 + [4.0] * 10 + [1.0] * 10 + [0.0] * 70
    df = spark.createDataFrame([(i, p, float(-i), float(i)) for i, p in enumerate(psi)], "id long, psi double, tau double, st double")
    r = distill.composite_table(df, "tau", "st").first()
    # teacher: -40, 0, 10; student (the reverse): 0, 0, 0
    assert (r.policy_teacher_10, r.policy_teacher_20, r.policy_teacher_30) == (-40, 0, 10)
    assert r.policy_ratio == 0 and r.spearman == -1 and not r.passed
    r = distill.composite_table(df.withColumn("st", F.col("tau")), "tau", "st").first()
    assert np.isclose(r.policy_ratio, (1 + 0 + 1) / 3)


def test_nothing_is_lost_where_a_summary_is_empty(spark):
    """A column without a value, a band without rows, a table without rows."""
    from causeway.operators import adjust, ranking

    df = spark.createDataFrame([(i, None, 0.5, float(i)) for i in range(10)], "id long, x double, e double, psi double")
    assert clean.impute_median(df, "x").where("x IS NULL").count() == 10
    got = {(r.lo, r.hi): r for r in adjust.trim_sensitivity(df, [(0.1, 0.9), (0.6, 0.7), (0.5, 0.5)]).collect()}
    assert {k: r.n_kept for k, r in got.items()} == {(0.1, 0.9): 10, (0.6, 0.7): 0, (0.5, 0.5): 10}
    assert got[0.6, 0.7].est is None and np.isclose(got[0.1, 0.9].est, 4.5) and np.isclose(got[0.1, 0.9].psi_p95, 8.55)
    assert np.isclose(got[0.1, 0.9].se, np.std(range(10), ddof=1) / 10 ** 0.5)
    row = ranking.nauuc(df.withColumn("tau", F.col("psi")).limit(0)).first()
    assert row.n == 0 and row.nauuc is None
