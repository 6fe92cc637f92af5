"""The offline phases chained: ingest, clean, KPIs, statistics, features, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.operators import analytics, evaluate, kpi, policy, quality, scoring
from rigsense.operators.features import feature_set, feature_summary
from rigsense.operators.scale import materialize


def prepare(raw: DataFrame, ordinal: str = "src_ord") -> dict[str, DataFrame]:
    """Cleaned rows, KPI rows and features, each written once, with their reports."""
    quality.require_schema(raw)
    cleaned = materialize(quality.preprocess(raw, ordinal), "cleaned")
    with_kpi = materialize(kpi.true_efficiency(cleaned), "kpi")
    features = materialize(feature_set(with_kpi), "features")
    return {
        "quality_report": quality.quality_report(raw),
        "preprocess_report": quality.preprocess_report(raw, cleaned, ordinal),
        "cleaned": cleaned, "kpi": with_kpi, "features": features,
        "kpi_summary": kpi.kpi_summary(with_kpi),
        "correlations": analytics.correlation_matrix(with_kpi),
        "tradeoffs": analytics.tradeoff_summary(with_kpi),
        "anomalies": analytics.anomaly_multi_signal(with_kpi),
        "feature_summary": feature_summary(features),
    }


def evaluation_summary(scored: DataFrame, threshold: float = 0.5, top: int = 10) -> DataFrame:
    """Everything the evaluation reports, in one row of nested columns.

    ``scored`` has a risk score, a label and the context columns of the risk outputs.
    """
    outputs = scoring.risk_outputs(scored, threshold)
    sweep = evaluate.threshold_sweep(scored)
    flagged = evaluate.flagged_miners(scored, threshold)
    best = flagged.limit(top).agg(F.sort_array(F.collect_list(F.struct(  # at most `top` rows
        "priority_score", "miner_id", "max_risk_score", "flagged_rows", "critical_rows")), False).alias("v"))
    parts = {
        "metrics": evaluate.metrics_at_threshold(scored, threshold),
        "conservative_threshold": evaluate.conservative_threshold(sweep),
        "classification_report": evaluate.classification_report(scored, threshold).agg(
            F.collect_list(F.struct("class", "precision", "recall", "f1", "support")).alias("v")),
        "top_priority_miners": best,
        "flagged": flagged.agg(F.count(F.when(F.col("flagged_rows") > 0, F.lit(1))).alias("miners")),
        "priority_alerts": evaluate.priority_alerts(outputs, threshold).agg(F.count(F.lit(1)).alias("rows")),
        "policy_backtest": policy.backtest(scored),
    }
    row = scored.agg(
        F.count(F.lit(1)).alias("validation_rows"), F.avg(F.col(S.TARGET).cast("double")).alias("positive_label_rate"))
    return row.withColumns({
        name: part.select(F.struct(*part.columns).alias("v")).scalar() for name, part in parts.items()})
