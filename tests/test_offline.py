"""The offline phases end to end, and training on their features."""

from rigsense import schema as S
from rigsense.operators.scale import work_dir
from rigsense.plans import offline, training
from rigsense.sources import views


def test_phases_and_training(spark, sf_dir):
    out = offline.prepare(views.raw_text(spark, sf_dir))
    cleaned, features = out["cleaned"].count(), out["features"].count()
    report = {(r["metric"], r["item"]): r["value"] for r in out["preprocess_report"].collect()}
    assert report[("output_rows", "")] == cleaned == features > 900
    assert all(report[("missing_values_after_preprocessing", c)] == 0 for c in S.PLAUSIBLE_RANGES)
    assert out["correlations"].count() == len(S.EDA_COLUMNS) ** 2 and out["tradeoffs"].count() == 3
    for name in ("quality_report", "kpi_summary", "anomalies", "feature_summary"):
        assert not out[name].isEmpty()

    result = training.train_and_compare(
        out["features"], {"logistic_regression": lambda: training.logistic(float(features)), "random_forest": lambda: training.forest(5, 4)})
    assert result["train_rows"] + result["valid_rows"] == features
    path = work_dir(spark, "model")
    training.save_model(result, out["features"], path, views.AS_OF)
    model, meta = training.load_model(spark, path)
    assert meta["model_name"] == result["best"] and meta["cooling_power_ratio"] > 0
    scored = training.with_score(model, out["features"].drop("asic_clock_mhz"))
    assert scored.filter("risk_score between 0 and 1").count() == features
