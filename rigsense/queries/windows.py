"""Per-device window features, peers, labels and snapshots."""

from __future__ import annotations

from rigsense import schema as S
from rigsense.operators import features as f
from rigsense.queries.registry import add, at_least, cte
from rigsense.sources import views as v

_part = 'PARTITION BY miner_id ORDER BY "timestamp", id'


def _over(agg: str, n: int) -> str:
    return f"{agg} OVER ({_part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _diff(c: str) -> str:
    return f"coalesce({c} - lag({c}) OVER ({_part}), 0e0)"


cte("feature_input", "SELECT * REPLACE (coalesce(cooling_power_w, asic_power_w * 0.24e0) AS cooling_power_w) FROM kpi", ["kpi"])
TEMPORAL = {
    "temp_roll_mean_1h": _over("avg(asic_temperature_c)", 6), "temp_roll_max_1h": _over("max(asic_temperature_c)", 6),
    "temp_roll_std_1h": f"coalesce({_over('stddev_samp(asic_temperature_c)', 6)}, 0e0)",
    "temp_roll_mean_4h": _over("avg(asic_temperature_c)", 24), "temp_delta_10m": _diff("asic_temperature_c"),
    "power_instability_roll_mean_1h": _over("avg(power_instability_index)", 6),
    "power_instability_roll_std_4h": f"coalesce({_over('stddev_samp(power_instability_index)', 24)}, 0e0)",
    "power_delta_10m": _diff("asic_power_w"), "hashrate_roll_mean_1h": _over("avg(asic_hashrate_ths)", 6),
    "hashrate_roll_mean_12h": _over("avg(asic_hashrate_ths)", 72), "te_roll_mean_4h": _over("avg(true_efficiency_te)", 24),
    "te_delta_10m": _diff("true_efficiency_te"),
}
cte("temporal", "SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in TEMPORAL.items()) + " FROM feature_input", ["feature_input"])
ROW = {
    "hashrate_degradation_pct_12h": "coalesce((hashrate_roll_mean_1h - hashrate_roll_mean_12h) / nullif(hashrate_roll_mean_12h, 0) * 100e0, 0e0)",
    "te_drift_pct_4h": "coalesce((true_efficiency_te - te_roll_mean_4h) / nullif(te_roll_mean_4h, 0) * 100e0, 0e0)",
    "thermal_margin_to_95c": "95e0 - asic_temperature_c",
    "voltage_stress_index": at_least("(asic_voltage_v - 12.8e0) / 12.8e0", 0),
    "hashrate_residual": "asic_hashrate_ths - coalesce(expected_hashrate_ths, asic_hashrate_ths)",
    "chip_temp_imbalance": "coalesce(chip_temp_max, asic_temperature_c) - asic_temperature_c",
}
_peer = {m: f"coalesce(CASE WHEN h.n > 1 THEN h.{m} END, g.{m}, a.{m}, 0e0)" for m in f.PEER_METRICS}
PEER = {
    "mode_peer_hashrate_dev_pct": f"coalesce((t.asic_hashrate_ths - {_peer['asic_hashrate_ths']}) / nullif({_peer['asic_hashrate_ths']}, 0) * 100e0, 0e0)",
    "mode_peer_temp_dev_c": f"t.asic_temperature_c - {_peer['asic_temperature_c']}",
    "mode_peer_te_dev_pct": f"coalesce((t.true_efficiency_te - {_peer['true_efficiency_te']}) / nullif({_peer['true_efficiency_te']}, 0) * 100e0, 0e0)",
}
_means = ", ".join(f"avg({m}) AS {m}" for m in f.PEER_METRICS)
cte("features_open", f"""SELECT t.*, {', '.join(f'{e} AS {c}' for c, e in ROW.items())}, {', '.join(f'{e} AS {c}' for c, e in PEER.items())}
FROM temporal AS t LEFT JOIN (SELECT date_trunc('hour', "timestamp") AS hr, operating_mode AS m, count(*) AS n, {_means} FROM kpi GROUP BY 1, 2) AS h
ON date_trunc('hour', t."timestamp") = h.hr AND t.operating_mode = h.m
LEFT JOIN (SELECT operating_mode AS m, {_means} FROM kpi GROUP BY 1) AS g ON t.operating_mode = g.m, (SELECT {_means} FROM kpi) AS a""".replace(
    "95e0 - asic_temperature_c", "95e0 - t.asic_temperature_c").replace(
    "asic_hashrate_ths - coalesce(expected_hashrate_ths, asic_hashrate_ths)", "t.asic_hashrate_ths - coalesce(expected_hashrate_ths, t.asic_hashrate_ths)").replace(
    "coalesce(chip_temp_max, asic_temperature_c) - asic_temperature_c", "coalesce(chip_temp_max, t.asic_temperature_c) - t.asic_temperature_c").replace(
    "(true_efficiency_te - te_roll", "(t.true_efficiency_te - te_roll"), ["temporal", "kpi"])
cte("feature_set", "SELECT id, \"timestamp\", miner_id, operating_mode, failure_within_horizon, " + ", ".join(
    f"coalesce(x.{c}, m.{c}) AS {c}" for c in S.NUMERIC_FEATURES) + " FROM features_open AS x, (SELECT "
    + ", ".join(f"median({c}) AS {c}" for c in S.NUMERIC_FEATURES) + " FROM features_open) AS m", ["features_open"])

for _c in [*TEMPORAL, "hashrate_degradation_pct_12h", "te_drift_pct_4h"]:
    add(_c, lambda s, p, c=_c: f.temporal_features(f.ensure_inputs(v.kpi(s, p))).select("id", c),
        f"SELECT id, {_c} FROM features_open", ["features_open"], [_c])
for _c in PEER:
    add(_c, lambda s, p, c=_c: f.peer_features(f.ensure_inputs(v.kpi(s, p))).select("id", c),
        f"SELECT id, {_c} FROM features_open", ["features_open"], [_c])
for _c in [c for c in ROW if c not in ("hashrate_degradation_pct_12h", "te_drift_pct_4h")]:
    add(_c, lambda s, p, c=_c: f.row_features(f.ensure_inputs(v.kpi(s, p))).select("id", c),
        f"SELECT id, {_c} FROM features_open", ["features_open"], [_c])

_ALL = ["id", "timestamp", "miner_id", *S.NUMERIC_FEATURES, "operating_mode", S.TARGET]
_SQL_ALL = ", ".join(f'"{c}"' for c in _ALL if c != S.TARGET) + f", CAST({S.TARGET} AS BIGINT) AS {S.TARGET}"
add("feature_set", lambda s, p: f.feature_set(v.kpi(s, p)), f"SELECT {_SQL_ALL} FROM feature_set", ["feature_set"], S.NUMERIC_FEATURES)
add("feature_summary", lambda s, p: f.feature_summary(f.feature_set(v.kpi(s, p))),
    """SELECT count(*) AS row_count, count(DISTINCT miner_id) AS miners, CAST(33 AS BIGINT) AS feature_count, CAST(11 AS BIGINT) AS base_feature_count,
CAST(21 AS BIGINT) AS engineered_feature_count, CAST(1 AS BIGINT) AS categorical_feature_count, avg(failure_within_horizon) AS target_positive_rate,
min("timestamp") AS start_timestamp, max("timestamp") AS end_timestamp FROM kpi""", ["kpi"], ["target_positive_rate"])
_SNAP = ["timestamp", "miner_id", *S.NUMERIC_FEATURES, "operating_mode"]
add("serving_snapshot", lambda s, p: f.serving_snapshot(v.kpi(s, p), [*S.NUMERIC_FEATURES, "operating_mode", "fan_speed_rpm"]),
    "SELECT " + ", ".join(f'"{c}"' for c in _SNAP) + f", CAST(NULL AS DOUBLE) AS fan_speed_rpm, CAST({S.TARGET} AS BIGINT) AS {S.TARGET} FROM (SELECT *, row_number() OVER "
    '(PARTITION BY miner_id ORDER BY "timestamp" DESC, id DESC) AS rn FROM feature_set) AS r WHERE rn = 1', ["feature_set"], [*S.NUMERIC_FEATURES, "fan_speed_rpm"])
add("future_failure_label", lambda s, p: f.future_failure_label(v.telemetry(s, p), horizon_hours=2).select("id", S.TARGET),
    f"""SELECT id, CAST(coalesce(max(failure_event) OVER ({_part} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), 0) AS BIGINT) AS failure_within_horizon
FROM telemetry""", ["telemetry"])
add("future_failure_label_by_time", lambda s, p: f.future_failure_label(v.telemetry(s, p), horizon_hours=24, by_time=True).select("id", S.TARGET),
    """SELECT id, CAST(coalesce(max(failure_event) OVER (PARTITION BY miner_id ORDER BY epoch_us("timestamp")
RANGE BETWEEN 1 FOLLOWING AND 86400000000 FOLLOWING), 0) AS BIGINT) AS failure_within_horizon FROM telemetry""", ["telemetry"])
add("te_timeseries_selected", lambda s, p: f.te_timeseries(v.kpi(s, p)),
    """SELECT k.miner_id, "timestamp", true_efficiency_te, avg(true_efficiency_te) OVER (PARTITION BY k.miner_id ORDER BY "timestamp", id
ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS te_roll_mean, mean_te FROM kpi AS k JOIN (SELECT *, row_number() OVER (ORDER BY mean_te, miner_id) AS lo,
row_number() OVER (ORDER BY mean_te DESC, miner_id DESC) AS hi FROM (SELECT miner_id, avg(true_efficiency_te) AS mean_te FROM kpi GROUP BY 1) AS m) AS r
ON k.miner_id = r.miner_id AND (lo <= 2 OR hi <= 2)""", ["kpi"], ["true_efficiency_te", "te_roll_mean", "mean_te"])
