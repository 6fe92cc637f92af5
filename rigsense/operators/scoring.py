"""Risk scores, bands and rule flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.functions.exprs import clamp, flag, lit_d, ratio, round_half_even
from rigsense.operators.fleet import newest
from rigsense.operators.scale import exact_quantiles, running_totals


def risk_band(score: Column, bands: Sequence[tuple[float, str]] = tuple(S.BANDS_OFFLINE)) -> Column:
    out = F.when(F.lit(False), F.lit("low"))
    for lowest, name in bands:
        out = out.when(score >= lit_d(lowest), F.lit(name))
    return out.otherwise(F.lit("low"))


def heuristic_score() -> Column:
    """Weighted mix of temperature, low hashrate and instability; defaults for missing values."""
    temp = clamp(
        (F.coalesce(F.col("asic_temperature_c"), lit_d(70.0)) - lit_d(60.0)) / lit_d(40.0), 0.0, 1.0)
    rate = F.coalesce(F.col("asic_hashrate_ths"), lit_d(100.0))
    slow = F.when(rate < lit_d(50.0), lit_d(1.0)).when(rate < lit_d(80.0), lit_d(0.5)).otherwise(lit_d(0.0))
    instab = clamp(F.coalesce(F.col("power_instability_index"), lit_d(0.0)), 0.0, 1.0)
    return clamp(lit_d(0.5) * temp + lit_d(0.4) * slow + lit_d(0.1) * instab, 0.0, 1.0)


def score_rows(df: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Heuristic score of each row; band and flag look at the score before rounding."""
    raw = heuristic_score()
    return df.withColumns({
        "risk_score": round_half_even(raw, 4),
        "risk_band": risk_band(raw, S.BANDS_WORKER),
        "predicted_failure": raw >= lit_d(threshold),
    })


def risk_heuristic(kpi: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Score of each device's newest KPI row."""
    return score_rows(newest(kpi), threshold)


def risk_snapshot(df: DataFrame, digits: int = 6) -> DataFrame:
    """Weighted risk of a seeded snapshot row."""
    temp = clamp((F.col("asic_temperature_c") - lit_d(70.0)) / lit_d(40.0), 0.0, 1.35)
    instab = clamp(F.col("power_instability_index"), 0.0, 1.0)
    drop = clamp(-F.col("hashrate_deviation_pct") / lit_d(45.0), 0.0, 1.25)
    volt = clamp((F.col("asic_voltage_v") - lit_d(12.5)) / lit_d(1.8), 0.0, 1.0)
    raw = clamp(
        lit_d(0.12) + lit_d(0.35) * temp + lit_d(0.28) * instab + lit_d(0.22) * drop + lit_d(0.10) * volt,
        0.03, 0.99)
    return df.withColumns({
        "risk_score": F.round(raw, digits),
        "risk_band": risk_band(raw),
        "predicted_failure": raw >= lit_d(0.55),
    })


RULES = {
    "flag_high_temp": lambda: F.col("asic_temperature_c") >= lit_d(95.0),
    "flag_power_unstable": lambda: F.col("power_instability_index") >= lit_d(0.70),
    "flag_hashrate_drop": lambda: F.col("hashrate_degradation_pct_12h") <= lit_d(-8.0),
    "flag_low_te": lambda: F.col("te_drift_pct_4h") <= lit_d(-8.0),
}


def risk_outputs(scored: DataFrame, threshold: float) -> DataFrame:
    """Prediction, band and rule flags for rows that carry a ``risk_score``."""
    score = F.col("risk_score")
    out = scored.withColumns({
        "predicted_failure_risk": flag(score >= lit_d(threshold)),
        "risk_band": risk_band(score),
        "alert_threshold_used": lit_d(threshold),
        **{n: F.coalesce(rule(), F.lit(False)) for n, rule in RULES.items()},
    })
    return out.withColumn("alert_signal_count", sum((flag(F.col(n)) for n in RULES), F.lit(0)))


ALERT_COLUMNS = [
    "timestamp", "miner_id", "operating_mode", "risk_score", "risk_band", "predicted_failure_risk",
    S.TARGET, "asic_temperature_c", "power_instability_index", "hashrate_degradation_pct_12h",
    "te_drift_pct_4h", "alert_signal_count", *RULES,
]


def alert_examples(outputs: DataFrame, n: int = 250) -> DataFrame:
    """Predicted failures and rows with two or more signals, riskiest first."""
    return outputs.filter("predicted_failure_risk = 1 or alert_signal_count >= 2").orderBy(
        F.col("risk_score").desc(), F.col("alert_signal_count").desc(), "miner_id", "timestamp"
    ).limit(n).select(*ALERT_COLUMNS)


def cooling_ratio(df: DataFrame, default: float = S.COOLING_RATIO) -> DataFrame:
    """Median cooling share of power, not below zero."""
    if not {"cooling_power_w", "asic_power_w"} <= set(df.columns):
        return df.limit(0).agg(F.coalesce(F.max(lit_d(default)), lit_d(default)).alias("cooling_power_ratio"))
    share = ratio(F.col("cooling_power_w"), F.col("asic_power_w"))
    median = exact_quantiles(df, {"m": (share, 0.5)})
    return median.select(
        F.greatest(F.coalesce(F.col("m"), lit_d(default)), lit_d(0.0)).alias("cooling_power_ratio"))


def class_weights(df: DataFrame, label: str = S.TARGET) -> DataFrame:
    """Balanced weights n / (2 * class size) and the positive scale max(1, neg / pos)."""
    neg = F.count(F.when(F.col(label) == 0, F.lit(1)))
    pos = F.count(F.when(F.col(label) == 1, F.lit(1)))
    total = F.count(F.lit(1))
    return df.agg(
        neg.alias("n_neg"), pos.alias("n_pos"),
        ratio(total.cast("double"), lit_d(2.0) * neg).alias("weight_neg"),
        ratio(total.cast("double"), lit_d(2.0) * pos).alias("weight_pos"),
        F.greatest(lit_d(1.0), neg / F.greatest(pos, F.lit(1))).alias("scale_pos_weight"),
    )


def time_split(df: DataFrame, q: float = 0.80, tiebreak: str = "id") -> DataFrame:
    """Add ``is_train``: rows up to the q-quantile of time, which is fetched as one number so
    that the cut reaches the scan as a literal.

    When nothing lies after the cut, the split goes by position: rows before the last
    timestamp train, and rows at it follow in the order of ``tiebreak`` until q of all rows.
    """
    at = F.unix_micros("timestamp")
    cut = exact_quantiles(df, {"cut": (at, q)}).first()["cut"]
    last = df.agg(F.max(at)).first()[0]
    if cut is None or last > cut:
        return df.withColumn("is_train", at <= F.lit(cut).cast("double"))
    seen = df.agg(F.count(F.lit(1)), F.count(F.when(at < F.lit(last), F.lit(1)))).first()
    room = int(seen[0] * q) - seen[1]
    order = F.col(tiebreak) if tiebreak in df.columns else F.xxhash64("miner_id")
    tied = df.filter(at == F.lit(last)).withColumn("_key", order)
    ranked = running_totals(
        tied.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), "_key", {"_upto": "_n"})
    at_last = tied.join(ranked, "_key").withColumn("is_train", F.col("_upto") <= F.lit(room))
    return df.filter(at < F.lit(last)).withColumn("is_train", F.lit(True)).unionByName(
        at_last.select(*df.columns, "is_train"))
