"""Evaluation of risk scores against labels.

Everything starts from one count table per distinct score, so the curves never sort rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.functions.exprs import count_where, lit_d, ratio
from rigsense.operators.scale import attach_row, fits_one_task, materialize, running_totals

# fixed values: thresholds of the sweep
SWEEP = [round(0.20 + 0.05 * i, 2) for i in range(15)]


def _zero(c: Column) -> Column:
    return F.coalesce(c, lit_d(0.0))


def score_counts(df: DataFrame, score: str = "risk_score", label: str = S.TARGET) -> DataFrame:
    """Positives and negatives per distinct score; a missing label counts as 0, a missing score as 0."""
    y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    return df.groupBy(F.coalesce(F.col(score), lit_d(0.0)).alias("threshold")).agg(
        count_where(y == 1).alias("pos"), count_where(y != 1).alias("neg"))


def curve(df: DataFrame, **kw) -> DataFrame:
    """Per distinct score, descending: cumulative tp/fp and the class totals.

    On large input the per-score counts are written once, so that totals, areas and thresholds
    do not scan the rows again.
    """
    counts = score_counts(df, **kw)
    if not fits_one_task(df):
        counts = materialize(counts, "scores")
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    out = running_totals(counts, "threshold", {"tp": "pos", "fp": "neg"}, descending=True)
    out, t = attach_row(out, totals)
    return out.select("threshold", "pos", "neg", "tp", "fp", t["p"].alias("p"), t["n"].alias("n"))


def _precision(tp: Column, fp: Column) -> Column:
    return ratio(tp.cast("double"), tp + fp)


def _recall(tp: Column) -> Column:
    """With no positives at all, recall is 1 everywhere."""
    return F.coalesce(ratio(tp.cast("double"), F.col("p")), lit_d(1.0))


def _f1(p: Column, r: Column) -> Column:
    return lit_d(2.0) * p * r / (p + r + lit_d(1e-12))


def pr_points(points: DataFrame) -> DataFrame:
    """Precision and recall at each score, plus the end point (recall 0, precision 1)."""
    body = points.select(
        F.col("threshold"), _precision(F.col("tp"), F.col("fp")).alias("precision"),
        _recall(F.col("tp")).alias("recall"))
    end = points.agg(F.max("threshold").alias("m")).select(
        F.lit(None).cast("double").alias("threshold"), lit_d(1.0).alias("precision"), lit_d(0.0).alias("recall"))
    return body.unionByName(end)


def pr_curve(df: DataFrame, **kw) -> DataFrame:
    return pr_points(curve(df, **kw))


def roc_curve(df: DataFrame, **kw) -> DataFrame:
    """False and true positive rate at each score, plus the origin."""
    points = curve(df, **kw)
    body = points.select(
        "threshold", ratio(F.col("fp").cast("double"), F.col("n")).alias("fpr"),
        ratio(F.col("tp").cast("double"), F.col("p")).alias("tpr"))
    origin = points.agg(F.max("threshold")).select(
        F.lit(None).cast("double").alias("threshold"), lit_d(0.0).alias("fpr"), lit_d(0.0).alias("tpr"))
    return body.unionByName(origin)


def _areas(points: DataFrame) -> DataFrame:
    """Both areas in one aggregate. A trapezoid needs the point before it, which is the same
    running total without the row's own counts, so no lag over the curve is needed."""
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    before = F.coalesce(_precision(tp0, fp0), lit_d(1.0))
    recall0 = F.when(tp0 + fp0 == 0, lit_d(0.0)).otherwise(_recall(tp0))
    pr = (_recall(tp) - recall0) * (_precision(tp, fp) + before) / lit_d(2.0)
    roc = F.col("neg") * (tp + tp0) / lit_d(2.0)
    return points.agg(
        F.sum(pr).alias("pr_auc"),
        ratio(F.sum(roc), F.max("p").cast("double") * F.max("n")).alias("roc_auc"))


def areas(df: DataFrame, **kw) -> DataFrame:
    return _areas(curve(df, **kw))


def roc_auc(df: DataFrame, **kw) -> DataFrame:
    """NULL when only one class is present."""
    return areas(df, **kw).select("roc_auc")


def pr_auc(df: DataFrame, **kw) -> DataFrame:
    """Trapezoids over the precision-recall points, end point included."""
    return areas(df, **kw).select("pr_auc")


def optimal_threshold(df: DataFrame, shifted: bool = False, **kw) -> DataFrame:
    """The score with the best F1, the lowest one on ties.

    ``shifted`` pairs each score with the precision and recall of the next higher score, as the
    reported model summaries do; its top score pairs with the end point.
    """
    return _optimal(curve(df, **kw), shifted)


def _optimal(points: DataFrame, shifted: bool) -> DataFrame:
    tp, fp = F.col("tp"), F.col("fp")
    if shifted:
        tp, fp = tp - F.col("pos"), fp - F.col("neg")
        none = tp + fp == 0
        p = F.when(none, lit_d(1.0)).otherwise(_precision(tp, fp))
        r = F.when(none, lit_d(0.0)).otherwise(_recall(tp))
    else:
        p, r = _precision(tp, fp), _recall(tp)
    best = points.select(F.struct(
        _f1(p, r).alias("f1"), (-F.col("threshold")).alias("low"), p.alias("p"), r.alias("r")
    ).alias("b")).agg(F.max("b").alias("b"))
    none = F.col("b").isNull()
    return best.select(
        F.when(none, lit_d(0.5)).otherwise(-F.col("b.low")).alias("threshold"),
        _zero(F.col("b.p")).alias("precision"), _zero(F.col("b.r")).alias("recall"),
        _zero(F.col("b.f1")).alias("f1"))


def confusion_at(df: DataFrame, threshold: Column | float, score: str = "risk_score", label: str = S.TARGET) -> DataFrame:
    t = threshold if isinstance(threshold, Column) else lit_d(threshold)
    hit = F.coalesce(F.col(score), lit_d(0.0)) >= t
    y = F.coalesce(F.col(label).cast("int"), F.lit(0)) == 1
    return df.agg(
        count_where(hit & y).alias("tp"), count_where(hit & ~y).alias("fp"),
        count_where(~hit & ~y).alias("tn"), count_where(~hit & y).alias("fn"))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from tp, fp, tn and fn; 0 on zero division."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "accuracy": _zero(ratio(tp + tn, tp + fp + tn + fn)),
        "precision": _zero(ratio(tp, tp + fp)),
        "recall": _zero(ratio(tp, tp + fn)),
        "f1": _zero(ratio(lit_d(2.0) * tp, lit_d(2.0) * tp + fp + fn)),
    })


def confusion_matrix(df: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """[[tn, fp], [fn, tp]] as (actual, predicted_0, predicted_1) rows."""
    return confusion_at(df, threshold, **kw).select(F.inline(F.array(
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")))))


METRICS = ["threshold", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "tp", "fp", "tn", "fn"]


def metrics_at_threshold(df: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    row = with_metrics(confusion_at(df, threshold, **kw)).withColumn("threshold", lit_d(threshold))
    row, a = attach_row(row, areas(df, **kw))
    return row.withColumns({"roc_auc": a["roc_auc"], "pr_auc": a["pr_auc"]}).select(*METRICS)


def _at_curve(points: DataFrame, thresholds: Sequence[Column]) -> DataFrame:
    """Metrics at given thresholds from the small per-score table, in one aggregate."""
    sums = points.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        *[F.sum(F.when(F.col("threshold") >= t, F.col("pos")).otherwise(0)).alias(f"tp{i}")
          for i, t in enumerate(thresholds)],
        *[F.sum(F.when(F.col("threshold") >= t, F.col("neg")).otherwise(0)).alias(f"fp{i}")
          for i, t in enumerate(thresholds)],
        *[F.max(t).alias(f"t{i}") for i, t in enumerate(thresholds)],
    )
    rows = sums.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("ord"), F.col(f"t{i}").alias("threshold"),
            F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
            (F.col("n") - F.col(f"fp{i}")).alias("tn"), (F.col("p") - F.col(f"tp{i}")).alias("fn"))
        for i in range(len(thresholds))
    ])))
    return with_metrics(rows)


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = tuple(SWEEP), **kw) -> DataFrame:
    """Metrics and alert rate at each threshold, lowest first."""
    points = curve(df, **kw)
    out, a = attach_row(_at_curve(points, [lit_d(t) for t in thresholds]), _areas(points))
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return out.withColumns({
        "roc_auc": a["roc_auc"], "pr_auc": a["pr_auc"],
        "alert_rate": ratio((F.col("tp") + F.col("fp")).cast("double"), total),
    }).select(*METRICS, "alert_rate").orderBy("threshold")


def model_evaluation(df: DataFrame, shifted: bool = False, **kw) -> DataFrame:
    """Metrics at 0.5, the optimal threshold, and metrics at the optimum."""
    points = curve(df, **kw)
    best = _optimal(points, shifted)
    tagged, b = attach_row(points, best)
    measured, a = attach_row(_at_curve(tagged, [lit_d(0.5), b["threshold"]]), _areas(points))
    part = F.when(F.col("ord") == 0, F.lit("default_threshold_metrics")).otherwise(
        F.lit("optimal_threshold_metrics"))
    measured = measured.withColumns({
        "part": part, "roc_auc": a["roc_auc"], "pr_auc": a["pr_auc"]}).select("part", *METRICS)
    return measured.unionByName(
        best.withColumn("part", F.lit("optimal_threshold")), allowMissingColumns=True)


def classification_report(df: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """Per-class rows, accuracy, macro and weighted averages."""
    c = confusion_at(df, threshold, **kw)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))

    def one(hit: Column, wrong: Column, missed: Column) -> dict[str, Column]:
        return {
            "precision": _zero(ratio(hit, hit + wrong)), "recall": _zero(ratio(hit, hit + missed)),
            "f1": _zero(ratio(lit_d(2.0) * hit, lit_d(2.0) * hit + wrong + missed)),
            "support": hit + missed,
        }

    neg, pos = one(tn, fn, fp), one(tp, fp, fn)
    n = tp + fp + tn + fn
    keys = ["precision", "recall", "f1"]
    rows = [
        ("0", neg), ("1", pos),
        ("accuracy", {**{k: ratio(tp + tn, n) for k in keys}, "support": n}),
        ("macro avg", {**{k: (neg[k] + pos[k]) / lit_d(2.0) for k in keys}, "support": n}),
        ("weighted avg", {
            **{k: ratio(neg[k] * neg["support"] + pos[k] * pos["support"], n) for k in keys}, "support": n}),
    ]
    return c.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("class"), *[v[k].alias(k) for k in keys],
                 v["support"].cast("long").alias("support"))
        for name, v in rows
    ])))


def conservative_threshold(sweep: DataFrame, precision: float = 0.40) -> DataFrame:
    """Among thresholds precise enough the one with most recall (then F1); if none is, the
    best F1. The lowest threshold wins remaining ties."""
    ok = F.col("precision") >= lit_d(precision)
    key = F.struct(
        F.when(ok, F.lit(1)).otherwise(F.lit(0)).alias("ok"),
        F.when(ok, F.col("recall")).otherwise(F.col("f1")).alias("first"),
        F.col("f1").alias("second"), (-F.col("threshold")).alias("low"))
    best = sweep.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1", "alert_rate"), key).alias("b"))
    return best.select("b.*")


def mode_performance(df: DataFrame, threshold: float = 0.5, score: str = "risk_score", label: str = S.TARGET) -> DataFrame:
    """Precision, recall and F1 per mode; modes with a single class are left out."""
    hit, y = F.col(score) >= lit_d(threshold), F.col(label) == 1
    out = df.filter(F.col("operating_mode").isin(S.OPERATING_MODES)).groupBy("operating_mode").agg(
        count_where(hit & y).alias("tp"), count_where(hit & ~y).alias("fp"),
        count_where(~hit & ~y).alias("tn"), count_where(~hit & y).alias("fn"))
    return with_metrics(out).filter("tp + fn > 0 and fp + tn > 0").select(
        "operating_mode", "precision", "recall", "f1")


def flagged_miners(df: DataFrame, threshold: float) -> DataFrame:
    """Risk per device, highest priority first."""
    s = F.col("risk_score")
    out = df.groupBy("miner_id").agg(
        F.max(s).alias("max_risk_score"), F.avg(s).alias("mean_risk_score"),
        count_where(s >= lit_d(threshold)).alias("flagged_rows"),
        count_where(s >= lit_d(0.75)).alias("critical_rows"),
        F.count(s).alias("validation_rows"), F.avg(F.col(S.TARGET).cast("double")).alias("true_failure_rate"),
    )
    return out.withColumns({
        "flagged_rate": ratio(F.col("flagged_rows").cast("double"), F.col("validation_rows")),
        "priority_score": lit_d(0.65) * F.col("max_risk_score") + lit_d(0.35) * F.col("mean_risk_score"),
    }).orderBy(F.col("priority_score").desc(), F.col("critical_rows").desc(), "miner_id")


def priority_alerts(outputs: DataFrame, threshold: float, n: int = 400) -> DataFrame:
    """Risky rows with a signal, or very risky rows; riskiest first."""
    s = F.col("risk_score")
    keep = ((s >= lit_d(threshold)) & (F.col("alert_signal_count") >= 1)) | (s >= lit_d(0.80))
    cols = ["timestamp", "miner_id", "operating_mode", "risk_score", "risk_band", S.TARGET,
            "predicted_failure_risk", "alert_signal_count", "asic_temperature_c", "power_instability_index",
            "hashrate_degradation_pct_12h", "te_drift_pct_4h"]
    return outputs.filter(keep).orderBy(
        s.desc(), F.col("alert_signal_count").desc(), "miner_id", "timestamp"
    ).limit(n).select(*[c for c in cols if c in outputs.columns])
