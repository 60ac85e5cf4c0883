"""End-to-end API: profile and recommend with result tables written as a run."""

import pytest

from shelfspark.plans import pipeline as PL
from shelfspark.sources import results as R


def test_model_options_and_unknown_variant():
    opts = PL.model_options()
    assert [o["name"] for o in opts["personalized"] if o["default"]] == ["als_neural_hybrid"]
    assert [o["name"] for o in opts["fbt"] if o["default"]] == ["apriori_lift"]
    assert [o["name"] for o in opts["popular"] if o["default"]] == ["recency_weighted"]
    with pytest.raises(ValueError, match="unknown personalized variant"):
        PL.resolve_variant("personalized", "nope")


def test_profile_outputs(m1):
    out = PL.profile(m1)
    assert out["warnings"] == []
    assert out["summary"].first()["n_transactions"] == 6
    assert {r["table"] for r in out["optional_files_present"].where("present").collect()} == {
        "returns", "search_logs", "promotions"}


def test_recommend_writes_a_run(spark, tmp_path, m1):
    base = str(tmp_path / "runs")
    out = PL.recommend(m1, personalized="content_based", fbt="cooccurrence", popular_variant="trending_velocity",
                       k=10, out_base=base, run_id="run1")
    assert out["run_id"] == "run1"
    pers = R.read_result(spark, base, "personalized", "run1")
    assert pers.count() == 4 and set(pers.columns) >= {"customer_id", "rank", "product_id", "score", "run_id"}
    assert R.read_result(spark, base, "fbt", "run1").count() == 4
    assert R.read_result(spark, base, "popular", "run1").where("list_key = 'overall'").count() == 3
    metrics = spark.read.parquet(base + "/run_metrics")
    assert metrics.where("run_id = 'run1'").count() == 12  # 2 lists × 2 k × 3 metrics
    latest = R.latest_run(metrics).first()
    assert latest["run_id"] == "run1"
