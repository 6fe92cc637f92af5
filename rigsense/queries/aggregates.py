"""Statistics, anomalies, rollups and chart data."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.operators import analytics as a
from rigsense.queries.registry import add, corr, cte
from rigsense.sources import views as v

START, END = datetime(2024, 1, 10), datetime(2024, 1, 20)
WINDOW = "\"timestamp\" BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"
cte("scoped", f"SELECT * FROM kpi WHERE {WINDOW}", ["kpi"])


def _scoped(s, p):
    return a.time_window(v.kpi(s, p), END, start=START)


add("time_window_filter", lambda s, p: a.time_window(v.kpi(s, p), END, hours=240).select("id", "timestamp", "miner_id"),
    'SELECT id, "timestamp", miner_id FROM scoped', ["scoped"])
add("correlation_matrix", lambda s, p: a.correlation_matrix(v.kpi(s, p)),
    " UNION ALL ".join(f'SELECT \'{x}\' AS "left", \'{y}\' AS "right", {corr(x, y)} AS r FROM kpi' for x in S.EDA_COLUMNS for y in S.EDA_COLUMNS),
    ["kpi"], ["r"])
_cells = [(x, y) for x in S.API_CORRELATION_COLUMNS for y in S.API_CORRELATION_COLUMNS]
add("correlation_api", lambda s, p: a.correlation_api(_scoped(s, p)),
    "SELECT " + ", ".join(f"round({corr(x, y)}, 3) AS corr__{x}__{y}" for x, y in _cells) + " FROM scoped", ["scoped"],
    [f"corr__{x}__{y}" for x, y in _cells])
_trade = [(c, st) for c in S.TRADEOFF_COLUMNS for st in ("mean", "median", "std")]
_fn = {"mean": "avg", "median": "median", "std": "stddev_samp"}
add("tradeoff_summary", lambda s, p: a.tradeoff_summary(v.kpi(s, p)),
    "SELECT operating_mode, " + ", ".join(f"round_even({_fn[st]}({c}), 4) AS {c}_{st}" for c, st in _trade) + " FROM kpi GROUP BY 1",
    ["kpi"], [f"{c}_{st}" for c, st in _trade])
_POINT = ["miner_id", "asic_hashrate_ths", "asic_temperature_c", "asic_power_w", "asic_clock_mhz", "asic_voltage_v", "true_efficiency_te", "operating_mode"]
cte("points", f"SELECT {', '.join(_POINT)} FROM scoped ORDER BY \"timestamp\" DESC, id LIMIT 2000", ["scoped"])
add("tradeoff_points", lambda s, p: a.tradeoff_points(_scoped(s, p)), "SELECT * FROM points", ["points"], _POINT[1:7])
add("tradeoff_series", lambda s, p: a.tradeoff_series(a.tradeoff_points(_scoped(s, p))),
    " UNION ALL ".join(f"SELECT '{c}' AS chart, coalesce(nullif(operating_mode, ''), 'normal') AS mode, {x} AS x, {y} AS y FROM points" for c, x, y in S.TRADEOFF_CHARTS),
    ["points"], ["x", "y"])

cte("flags", """SELECT kpi.*, coalesce(asic_temperature_c > 95 OR (asic_temperature_c - tm) / (ts + 1e-6) > 2.8e0, false) AS anomaly_temp,
coalesce(power_instability_index > 0.75e0, false) AS anomaly_power_instability, coalesce(hashrate_deviation_pct < -15, false) AS anomaly_hashrate_drop,
coalesce((asic_power_w - pm) / (ps + 1e-6) > 2.8e0, false) AS anomaly_power_spike, coalesce(true_efficiency_te < q, false) AS anomaly_low_te
FROM kpi, (SELECT avg(asic_temperature_c) AS tm, stddev_pop(asic_temperature_c) AS ts, avg(asic_power_w) AS pm, stddev_pop(asic_power_w) AS ps,
quantile_cont(true_efficiency_te, 0.1) AS q FROM kpi) AS st""", ["kpi"])
cte("counted", "SELECT *, CAST(" + " + ".join(f"CAST({f} AS INTEGER)" for f in a.FLAGS) + " AS BIGINT) AS anomaly_signal_count FROM flags", ["flags"])
_AN = ["asic_temperature_c", "asic_power_w", "asic_hashrate_ths", "power_instability_index", "hashrate_deviation_pct", "true_efficiency_te"]
add("anomaly_multi_signal", lambda s, p: a.anomaly_multi_signal(v.kpi(s, p)),
    f"""SELECT "timestamp", miner_id, operating_mode, {', '.join(_AN)}, CAST(failure_within_horizon AS BIGINT) AS failure_within_horizon,
anomaly_signal_count, {', '.join(a.FLAGS)} FROM counted WHERE anomaly_signal_count >= 2""", ["counted"], _AN)
add("top_anomaly_miners", lambda s, p: a.top_anomaly_miners(v.kpi(s, p)),
    "SELECT miner_id, count(*) AS anomalies FROM counted WHERE anomaly_signal_count >= 2 GROUP BY 1 ORDER BY anomalies DESC, miner_id LIMIT 10", ["counted"])
_pairs = [(f"{x}__{y}", corr(x, y)) for x, y in S.KEY_CORRELATIONS]
add("eda_summary", lambda s, p: a.eda_summary(v.kpi(s, p)),
    "SELECT count(*) AS rows_analyzed, count(DISTINCT miner_id) AS miners_analyzed, avg(failure_within_horizon) AS label_positive_rate, "
    "count(CASE WHEN anomaly_signal_count >= 2 THEN 1 END) AS anomaly_rows, count(CASE WHEN anomaly_signal_count >= 2 THEN 1 END) / CAST(count(*) AS DOUBLE) AS anomaly_rate, "
    + ", ".join(f"{e} AS {n}" for n, e in _pairs) + " FROM counted", ["counted"], ["label_positive_rate", "anomaly_rate", *[n for n, _ in _pairs]])
add("anomaly_zscore", lambda s, p: a.anomaly_zscore(_scoped(s, p)),
    "SELECT miner_id, \"timestamp\", field, value, round(z, 3) AS z_score, CASE WHEN z > 5 THEN 'critical' ELSE 'warning' END AS severity FROM ("
    + " UNION ALL ".join(f"""SELECT miner_id, "timestamp", '{c}' AS field, {c} AS value, abs(({c} - (SELECT avg({c}) FROM scoped)) /
nullif((SELECT stddev_pop({c}) FROM scoped), 0)) AS z FROM scoped""" for c in S.ZSCORE_COLUMNS)
    + ') AS u WHERE z > 3 ORDER BY z DESC, miner_id, "timestamp", field LIMIT 200', ["scoped"], ["value", "z_score"])
_EFF = ["avg_te", "avg_efficiency", "avg_hashrate"]
add("efficiency_distribution", lambda s, p: a.efficiency_distribution(_scoped(s, p)),
    """SELECT miner_id, avg(true_efficiency_te) AS avg_te, avg(efficiency_j_per_th) AS avg_efficiency, avg(asic_hashrate_ths) AS avg_hashrate
FROM scoped GROUP BY 1""", ["scoped"], _EFF)
add("hourly_rollup", lambda s, p: v.rollup(s, p), "SELECT * FROM rollup", ["rollup"], list(S.ROLLUP_SOURCES))
add("hourly_rollup_exact", lambda s, p: a.hourly_rollup(v.kpi(s, p), exact=True).groupBy("miner_id").agg(
        *[(F.sum(f"sum_{c}") / F.sum(f"n_{c}")).alias(f"mean_{c}") for c in ("asic_power_w", "asic_hashrate_ths")], F.sum("samples").alias("samples")),
    "SELECT miner_id, avg(asic_power_w) AS mean_asic_power_w, avg(asic_hashrate_ths) AS mean_asic_hashrate_ths, count(*) AS samples FROM kpi GROUP BY 1",
    ["kpi"], ["mean_asic_power_w", "mean_asic_hashrate_ths"])


def _routed(s, p):
    """The same report from the rollup (January 10-20) and, where it has no rows, from raw."""
    kpi, days = v.kpi(s, p), timedelta(days=10)
    rollup = v.rollup(s, p).filter(F.col("bucket") >= F.lit(START))
    with_rows = a.efficiency_distribution(a.route_source(kpi, rollup, START, END)).withColumn("origin", F.lit("rollup"))
    without = a.efficiency_distribution(a.route_source(kpi, rollup, START - days, START - timedelta(seconds=1))).withColumn("origin", F.lit("raw"))
    return with_rows.unionByName(without)


add("rollup_routing", _routed, """SELECT miner_id, avg(avg_true_efficiency_te) AS avg_te, avg(avg_efficiency_j_per_th) AS avg_efficiency,
avg(avg_hashrate) AS avg_hashrate, 'rollup' AS origin FROM rollup WHERE bucket BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1
UNION ALL SELECT miner_id, avg(true_efficiency_te), avg(efficiency_j_per_th), avg(asic_hashrate_ths), 'raw' FROM kpi
WHERE "timestamp" BETWEEN TIMESTAMP '2023-12-31 00:00:00' AND TIMESTAMP '2024-01-09 23:59:59' GROUP BY 1""", ["rollup", "kpi"], _EFF)
add("scatter_sample", lambda s, p: a.scatter_sample(v.kpi(s, p), ["miner_id", "timestamp"]).select(
    "miner_id", "timestamp", "asic_power_w", "asic_hashrate_ths", "operating_mode"))
_BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]
add("te_box_stats", lambda s, p: a.te_box_stats(v.kpi(s, p)),
    """SELECT operating_mode, q1, med AS median, q3, min(CASE WHEN te >= q1 - 1.5e0 * (q3 - q1) THEN te END) AS whisker_low,
max(CASE WHEN te <= q3 + 1.5e0 * (q3 - q1) THEN te END) AS whisker_high,
count(CASE WHEN te < q1 - 1.5e0 * (q3 - q1) OR te > q3 + 1.5e0 * (q3 - q1) THEN 1 END) AS outliers, count(te) AS n
FROM (SELECT operating_mode, true_efficiency_te AS te FROM kpi) AS k JOIN (SELECT operating_mode AS m, quantile_cont(true_efficiency_te, 0.25) AS q1,
median(true_efficiency_te) AS med, quantile_cont(true_efficiency_te, 0.75) AS q3 FROM kpi GROUP BY 1) AS g ON operating_mode = m
GROUP BY operating_mode, q1, med, q3""", ["kpi"], _BOX)
add("risk_histogram", lambda s, p: a.risk_histogram(v.risk(s, p)),
    """SELECT CAST(label AS BIGINT) AS label, CAST(bin AS BIGINT) AS bin, lo + bin * width AS bin_start, count(*) AS n,
count(*) / (max(total) * width) AS density FROM (SELECT failure_within_horizon AS label, lo, width, least(coalesce(CAST(floor((risk_score - lo) / nullif(width, 0)) AS INTEGER), 0), 34) AS bin,
count(*) OVER (PARTITION BY failure_within_horizon) AS total FROM risk, (SELECT min(risk_score) AS lo, (max(risk_score) - min(risk_score)) / 35e0 AS width FROM risk) AS r) AS b
GROUP BY label, bin, lo, width""", ["risk"], ["bin_start", "density"])
