"""Scoring, curves, thresholds, reports and model training."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.operators import evaluate as e
from rigsense.operators import features as f
from rigsense.operators import scoring as sc
from rigsense.operators.scale import materialize, work_dir
from rigsense.plans import offline
from rigsense.plans import training as tr
from rigsense.queries.registry import add, band, between, cte, d
from rigsense.sources import views as v

T = 0.45  # alert threshold of these queries

# --- scores and bands
add("risk_band", lambda s, p: v.predictions(s, p).select(
        "id", sc.risk_band(F.col("risk_score")).alias("offline"), sc.risk_band(F.col("risk_score"), S.BANDS_WORKER).alias("worker"),
        sc.risk_band(F.col("risk_score"), [(0.9, "severe"), (0.5, "watch")]).alias("custom")),
    f"SELECT id, {band('risk_score', S.BANDS_OFFLINE)} AS offline, {band('risk_score', S.BANDS_WORKER)} AS worker, "
    f"{band('risk_score', [(0.9, 'severe'), (0.5, 'watch')])} AS custom FROM predictions", ["predictions"])
add("risk_heuristic", lambda s, p: sc.risk_heuristic(v.kpi(s, p)).select("miner_id", "risk_score", "risk_band", "predicted_failure"),
    """SELECT miner_id, risk_score, risk_band, predicted_failure FROM (SELECT *, row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp" DESC, id DESC) AS rn
FROM risk) AS r WHERE rn = 1""", ["risk"], ["risk_score"])
_snap = (f"0.12e0 + 0.35e0 * ({between('(asic_temperature_c - 70e0) / 40e0', 0, 1.35)}) + 0.28e0 * ({between('power_instability_index', 0, 1)})"
         f" + 0.22e0 * ({between('-hashrate_deviation_pct / 45e0', 0, 1.25)}) + 0.10e0 * ({between('(asic_voltage_v - 12.5e0) / 1.8e0', 0, 1)})")
# Nine digits, so that half-way cases at the sixth stay with the comparison's own rounding.
add("risk_snapshot", lambda s, p: sc.risk_snapshot(v.kpi(s, p), 9).select("id", "risk_score", "risk_band", "predicted_failure"),
    f"SELECT id, r AS risk_score, {band('r', S.BANDS_OFFLINE)} AS risk_band, r >= 0.55e0 AS predicted_failure FROM (SELECT id, {between(_snap, 0.03, 0.99)} AS r FROM kpi) AS x",
    ["kpi"], ["risk_score"])


def _frame(s, p):
    """Scored rows with the temporal features that the rule flags look at."""
    return f.temporal_features(v.risk(s, p))


_part = 'OVER (PARTITION BY miner_id ORDER BY "timestamp", id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)'
_h1, _h12, _t4 = f"avg(asic_hashrate_ths) {_part.format(5)}", f"avg(asic_hashrate_ths) {_part.format(71)}", f"avg(true_efficiency_te) {_part.format(23)}"
cte("outputs", f"""SELECT *, CAST(CAST(flag_high_temp AS INTEGER) + CAST(flag_power_unstable AS INTEGER) + CAST(flag_hashrate_drop AS INTEGER) + CAST(flag_low_te AS INTEGER) AS BIGINT) AS alert_signal_count
FROM (SELECT * REPLACE ({band('risk_score', S.BANDS_OFFLINE)} AS risk_band, CAST(failure_within_horizon AS BIGINT) AS failure_within_horizon), CAST(risk_score >= {d(T)} AS BIGINT) AS predicted_failure_risk,
asic_temperature_c >= 95 AS flag_high_temp, power_instability_index >= 0.7e0 AS flag_power_unstable,
hashrate_degradation_pct_12h <= -8 AS flag_hashrate_drop, te_drift_pct_4h <= -8 AS flag_low_te FROM (SELECT *,
coalesce(({_h1} - {_h12}) / nullif({_h12}, 0) * 100e0, 0e0) AS hashrate_degradation_pct_12h,
coalesce((true_efficiency_te - {_t4}) / nullif({_t4}, 0) * 100e0, 0e0) AS te_drift_pct_4h FROM risk) AS w) AS z""", ["risk"])
_OUT = ["risk_score", "asic_temperature_c", "power_instability_index", "hashrate_degradation_pct_12h", "te_drift_pct_4h"]
_COLS = ", ".join(f'"{c}"' for c in sc.ALERT_COLUMNS)
add("risk_outputs", lambda s, p: sc.risk_outputs(_frame(s, p), T).select(*sc.ALERT_COLUMNS),
    f"SELECT {_COLS} FROM outputs", ["outputs"], _OUT)
add("risk_outputs_alerts", lambda s, p: sc.alert_examples(sc.risk_outputs(_frame(s, p), T)),
    f"""SELECT {_COLS} FROM outputs WHERE predicted_failure_risk = 1 OR alert_signal_count >= 2
ORDER BY risk_score DESC, alert_signal_count DESC, miner_id, "timestamp" LIMIT 250""", ["outputs"], _OUT)
_PRI = [c for c in sc.ALERT_COLUMNS if not c.startswith("flag_")]
add("priority_alerts", lambda s, p: e.priority_alerts(sc.risk_outputs(_frame(s, p), T), T),
    "SELECT " + ", ".join(f'"{c}"' for c in _PRI) + f""" FROM outputs WHERE (risk_score >= {d(T)} AND alert_signal_count >= 1) OR risk_score >= 0.8e0
ORDER BY risk_score DESC, alert_signal_count DESC, miner_id, "timestamp" LIMIT 400""", ["outputs"], _OUT)

# --- training inputs
add("time_split", lambda s, p: sc.time_split(v.kpi(s, p)).select("id", "is_train"),
    'SELECT id, epoch_us("timestamp") <= (SELECT quantile_cont(CAST(epoch_us("timestamp") AS DOUBLE), 0.8) FROM kpi) AS is_train FROM kpi', ["kpi"])
add("time_split_fallback", lambda s, p: sc.time_split(v.kpi(s, p).withColumn(
        "timestamp", F.when(F.col("id") % 3 == 0, F.col("timestamp")).otherwise(F.lit(v.AS_OF)))).select("id", "is_train"),
    """SELECT id, row_number() OVER (ORDER BY t, id) <= floor((SELECT count(*) FROM kpi) * 0.8e0) AS is_train
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN "timestamp" ELSE TIMESTAMP '2024-01-31 00:00:00' END AS t FROM kpi) AS k""", ["kpi"])
add("cooling_ratio", lambda s, p: sc.cooling_ratio(v.kpi(s, p)),
    "SELECT greatest(coalesce(median(cooling_power_w / nullif(asic_power_w, 0)), 0.24e0), 0e0) AS cooling_power_ratio FROM kpi", ["kpi"], ["cooling_power_ratio"])
add("class_weights", lambda s, p: sc.class_weights(v.kpi(s, p)),
    """SELECT n AS n_neg, m AS n_pos, (n + m) / (2e0 * n) AS weight_neg, (n + m) / (2e0 * m) AS weight_pos, greatest(1e0, n / CAST(greatest(m, 1) AS DOUBLE)) AS scale_pos_weight
FROM (SELECT count(CASE WHEN failure_within_horizon = 0 THEN 1 END) AS n, count(CASE WHEN failure_within_horizon = 1 THEN 1 END) AS m FROM kpi) AS c""",
    ["kpi"], ["weight_neg", "weight_pos", "scale_pos_weight"])

# --- curves and thresholds
cte("curve", """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (
SELECT risk_score AS threshold, count(CASE WHEN failure_within_horizon = 1 THEN 1 END) AS pos, count(CASE WHEN failure_within_horizon = 0 THEN 1 END) AS neg
FROM risk GROUP BY 1) AS c WINDOW w AS (ORDER BY threshold DESC)""", ["risk"])
cte("pr", """SELECT threshold, tp / CAST(tp + fp AS DOUBLE) AS "precision", tp / CAST(p AS DOUBLE) AS recall FROM curve
UNION ALL SELECT NULL, 1e0, 0e0""", ["curve"])
cte("roc", "SELECT threshold, fp / CAST(n AS DOUBLE) AS fpr, tp / CAST(p AS DOUBLE) AS tpr FROM curve UNION ALL SELECT NULL, 0e0, 0e0", ["curve"])
cte("auc", """SELECT (SELECT sum((tpr + ptpr) / 2 * (fpr - pfpr)) FROM (SELECT *, lag(tpr) OVER w AS ptpr, lag(fpr) OVER w AS pfpr FROM roc
WINDOW w AS (ORDER BY threshold DESC NULLS FIRST)) AS a) AS roc_auc, (SELECT sum(("precision" + pp) / 2 * (recall - pr)) FROM (SELECT *,
lag("precision") OVER w AS pp, lag(recall) OVER w AS pr FROM pr WINDOW w AS (ORDER BY threshold DESC NULLS FIRST)) AS b) AS pr_auc""", ["roc", "pr"])
cte("best", """SELECT threshold, "precision", recall, f1 FROM (SELECT *, 2 * "precision" * recall / ("precision" + recall + 1e-12) AS f1 FROM pr WHERE threshold IS NOT NULL) AS x
ORDER BY f1 DESC, threshold LIMIT 1""", ["pr"])
cte("best_shifted", """SELECT threshold, "precision", recall, f1 FROM (SELECT threshold, p2 AS "precision", r2 AS recall, 2 * p2 * r2 / (p2 + r2 + 1e-12) AS f1 FROM (
SELECT threshold, lag("precision") OVER w AS p2, lag(recall) OVER w AS r2 FROM pr WINDOW w AS (ORDER BY threshold DESC NULLS FIRST)) AS y WHERE threshold IS NOT NULL) AS x
ORDER BY f1 DESC, threshold LIMIT 1""", ["pr"])
add("pr_curve", lambda s, p: e.pr_curve(v.risk(s, p)), "SELECT * FROM pr", ["pr"], ["threshold", "precision", "recall"])
add("roc_curve", lambda s, p: e.roc_curve(v.risk(s, p)), "SELECT * FROM roc", ["roc"], ["threshold", "fpr", "tpr"])
add("roc_auc", lambda s, p: e.roc_auc(v.risk(s, p)), "SELECT roc_auc FROM auc", ["auc"], ["roc_auc"])
add("pr_auc", lambda s, p: e.pr_auc(v.risk(s, p)), "SELECT pr_auc FROM auc", ["auc"], ["pr_auc"])
_BEST = ["threshold", "precision", "recall", "f1"]
add("optimal_threshold", lambda s, p: e.optimal_threshold(v.risk(s, p)), "SELECT * FROM best", ["best"], _BEST)
add("optimal_threshold_shifted", lambda s, p: e.optimal_threshold(v.risk(s, p), shifted=True), "SELECT * FROM best_shifted", ["best_shifted"], _BEST)


def metrics(t: str, source: str, extra: str = "", group: str = "") -> str:
    """Confusion counts and metrics at threshold expression t over rows of ``source``."""
    return f"""SELECT {extra}threshold, (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) AS accuracy, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0e0) AS "precision",
coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0e0) AS recall, coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0e0) AS f1, tp, fp, tn, fn FROM (
SELECT {extra}CAST({t} AS DOUBLE) AS threshold, count(CASE WHEN risk_score >= {t} AND failure_within_horizon = 1 THEN 1 END) AS tp,
count(CASE WHEN risk_score >= {t} AND failure_within_horizon = 0 THEN 1 END) AS fp, count(CASE WHEN risk_score < {t} AND failure_within_horizon = 0 THEN 1 END) AS tn,
count(CASE WHEN risk_score < {t} AND failure_within_horizon = 1 THEN 1 END) AS fn FROM {source} GROUP BY {extra}threshold) AS c{group}"""


_AUC = "(SELECT roc_auc FROM auc) AS roc_auc, (SELECT pr_auc FROM auc) AS pr_auc"
_MET = ["threshold", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
cte("grid", "SELECT (20 + 5 * i) / 100e0 AS t FROM range(15) AS r(i)")
cte("sweep", "SELECT *, (tp + fp) / CAST(tp + fp + tn + fn AS DOUBLE) AS alert_rate FROM (" + metrics("t", "risk, grid") + ") AS m", ["risk", "grid"])
add("metrics_at_threshold", lambda s, p: e.metrics_at_threshold(v.risk(s, p), T),
    f"SELECT *, {_AUC} FROM ({metrics(d(T), 'risk')}) AS m", ["risk", "auc"], _MET)
add("model_evaluation", lambda s, p: e.model_evaluation(v.risk(s, p)).fillna(-1, ["tp", "fp", "tn", "fn"]),
    f"SELECT 'default_threshold_metrics' AS part, *, {_AUC} FROM ({metrics('0.5e0', 'risk')}) AS m UNION ALL "
    f"SELECT 'optimal_threshold_metrics', *, {_AUC} FROM ({metrics('t', '(SELECT risk.*, best.threshold AS t FROM risk, best) AS rb')}) AS m UNION ALL "
    'SELECT \'optimal_threshold\', threshold, NULL, "precision", recall, f1, -1, -1, -1, -1, NULL, NULL FROM best', ["risk", "auc", "best"], _MET)
cte("confusion", metrics(d(T), "risk"), ["risk"])
add("confusion_matrix", lambda s, p: e.confusion_matrix(v.risk(s, p), T),
    "SELECT CAST(0 AS BIGINT) AS actual, tn AS predicted_0, fp AS predicted_1 FROM confusion UNION ALL SELECT 1, fn, tp FROM confusion", ["confusion"])
add("threshold_sweep", lambda s, p: e.threshold_sweep(v.risk(s, p)), f"SELECT *, {_AUC} FROM sweep", ["sweep", "auc"], [*_MET, "alert_rate"])
cte("classes", """SELECT '0' AS c, coalesce(tn / CAST(nullif(tn + fn, 0) AS DOUBLE), 0) AS a, coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0) AS b,
coalesce(2 * tn / CAST(nullif(2 * tn + fp + fn, 0) AS DOUBLE), 0) AS f, tn + fp AS s FROM confusion UNION ALL
SELECT '1', coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0),
coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), tp + fn FROM confusion""", ["confusion"])
add("classification_report", lambda s, p: e.classification_report(v.risk(s, p), T),
    """SELECT c AS class, a AS "precision", b AS recall, f AS f1, s AS support FROM classes
UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, tp + fp + tn + fn FROM confusion
UNION ALL SELECT 'macro avg', avg(a), avg(b), avg(f), CAST(sum(s) AS BIGINT) FROM classes
UNION ALL SELECT 'weighted avg', sum(a * s) / sum(s), sum(b * s) / sum(s), sum(f * s) / sum(s), CAST(sum(s) AS BIGINT) FROM classes""",
    ["classes"], ["precision", "recall", "f1"])
for _name, _floor in [("conservative_threshold", 0.40), ("conservative_threshold_low", 0.02)]:
    add(_name, lambda s, p, x=_floor: e.conservative_threshold(e.threshold_sweep(v.risk(s, p)), x),
        f"""SELECT threshold, "precision", recall, f1, alert_rate FROM sweep ORDER BY CASE WHEN "precision" >= {d(_floor)} THEN 0 ELSE 1 END,
CASE WHEN "precision" >= {d(_floor)} THEN recall ELSE f1 END DESC, f1 DESC, threshold LIMIT 1""", ["sweep"], ["threshold", "precision", "recall", "f1", "alert_rate"])


def _by_mode(s, p):
    """The label here is frequent enough for every mode to have both classes."""
    return v.risk(s, p).withColumn(S.TARGET, F.when(F.col("id") % 4 == 0, F.lit(1)).otherwise(F.lit(0)))


add("mode_performance", lambda s, p: e.mode_performance(_by_mode(s, p), T),
    "SELECT operating_mode, \"precision\", recall, f1 FROM (" + metrics(d(T), "(SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS failure_within_horizon) FROM risk) AS r", "operating_mode, ")
    + ") AS m WHERE tp + fn > 0 AND fp + tn > 0", ["risk"], ["precision", "recall", "f1"])
_FLAG = ["max_risk_score", "mean_risk_score", "true_failure_rate", "flagged_rate", "priority_score"]
add("flagged_miners", lambda s, p: e.flagged_miners(v.risk(s, p), T),
    f"""SELECT *, flagged_rows / CAST(validation_rows AS DOUBLE) AS flagged_rate, 0.65e0 * max_risk_score + 0.35e0 * mean_risk_score AS priority_score FROM (
SELECT miner_id, max(risk_score) AS max_risk_score, avg(risk_score) AS mean_risk_score, count(CASE WHEN risk_score >= {d(T)} THEN 1 END) AS flagged_rows,
count(CASE WHEN risk_score >= 0.75e0 THEN 1 END) AS critical_rows, count(risk_score) AS validation_rows, avg(failure_within_horizon) AS true_failure_rate FROM risk GROUP BY 1) AS g""",
    ["risk"], _FLAG)
add("evaluation_summary", lambda s, p: offline.evaluation_summary(_frame(s, p), T).select(
    "validation_rows", "positive_label_rate", F.col("metrics.f1").alias("f1"), F.col("metrics.roc_auc").alias("roc_auc"),
    F.col("conservative_threshold.threshold").alias("conservative_threshold"), F.col("flagged.miners").alias("flagged_miners_count"),
    F.col("priority_alerts.rows").alias("priority_alert_rows"), F.to_json("top_priority_miners").alias("top_priority_miners"),
    F.to_json("classification_report").alias("classification_report"), F.to_json("policy_backtest").alias("policy_backtest")))

# --- models, of the operators' own sizes

def _labelled(s, p):
    """KPI rows labelled with a failure within the next twelve rows of the device."""
    rows = v.kpi(s, p).withColumn("failure_event", F.col(S.TARGET))
    return f.future_failure_label(rows, horizon_hours=2).drop("failure_event")


def _features(s, p):
    return materialize(f.feature_set(_labelled(s, p)), "features")


def _train_one(make):
    def run(s, p):
        train, valid = tr.split(_features(s, p))
        w = sc.class_weights(train).first()
        model = tr.fit(tr.with_weights(train, w), make(w["n_neg"] + w["n_pos"]))
        scored = materialize(tr.with_score(model, valid).select("miner_id", S.TARGET, "risk_score"), "scored")
        return e.metrics_at_threshold(scored, 0.5)

    return run


def _prepared(s, p):
    feats = _features(s, p)
    from pyspark.ml import Pipeline

    ready = Pipeline(stages=tr.prepare_stages(feats)).fit(feats).transform(feats)
    from pyspark.ml.functions import vector_to_array

    return ready.select("id", F.size(vector_to_array("features")).alias("width"), F.get(vector_to_array("features"), F.lit(5)).alias("temperature_scaled"))


add("ml_preprocess", _prepared)
add("train_logreg", _train_one(lambda n: tr.logistic(float(n))))
add("train_rf", _train_one(lambda n: tr.forest()))
add("train_gbt", _train_one(lambda n: tr.boosted()))


_RUNS: dict[tuple[str, str], tuple[str, DataFrame]] = {}  # (application, tables) -> artifact folder and decision


def _stored_run(s, p):
    """One training run over the tables, stored; selection, retraining and scoring read it."""
    key = (s.sparkContext.applicationId, p)
    if key not in _RUNS:
        path = work_dir(s, "artifact")
        _RUNS[key] = path, materialize(tr.retrain_job(_labelled(s, p), v.AS_OF, path, 31), "decision")
    return _RUNS[key]


add("model_select", lambda s, p: tr.model_select(tr.load_comparison(s, _stored_run(s, p)[0])))


def _importance(s, p):
    feats = _features(s, p)
    w = sc.class_weights(feats).first()
    return tr.feature_importance(tr.fit(tr.with_weights(feats, w), tr.forest()), s)


add("feature_importance", _importance)
add("retrain_guard", lambda s, p: tr.retrain_guard(v.kpi(s, p), v.AS_OF, 20),
    """SELECT *, CASE WHEN n_rows < 500 THEN 'not_enough_rows' WHEN n_miners < 10 THEN 'not_enough_miners' WHEN span_hours < 72 THEN 'time_span_too_short' ELSE 'ok' END AS reason,
n_rows >= 500 AND n_miners >= 10 AND span_hours >= 72 AS retrain FROM (SELECT count(*) AS n_rows, count(DISTINCT miner_id) AS n_miners,
(epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 3.6e9 AS span_hours FROM kpi WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-11 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00') AS g""",
    ["kpi"], ["span_hours"])


def _scored(s, p):
    rows = tr.score_model(_labelled(s, p), v.AS_OF - timedelta(hours=12), _stored_run(s, p)[0], lookback_hours=24 * 7)
    return rows.select("miner_id", "timestamp", "risk_score", "risk_band", "predicted_failure", "event_codes")


add("retrain_job", lambda s, p: _stored_run(s, p)[1])
add("score_model", _scored)
add("score_model_fallback", lambda s, p: tr.score_model(v.kpi(s, p), v.AS_OF, "/nonexistent/artifact").select("miner_id", "risk_score", "risk_band", "predicted_failure"),
    """SELECT miner_id, risk_score, risk_band, predicted_failure FROM (SELECT *, row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp" DESC, id DESC) AS rn
FROM risk) AS r WHERE rn = 1""", ["risk"], ["risk_score"])
