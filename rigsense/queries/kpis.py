"""KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.operators import kpi as k
from rigsense.queries.registry import add, at_least, between, corr, cte, mode_factor, te_sql
from rigsense.sources import views as v

_total = at_least("asic_power_w + cooling_power_w", 1e-6)
_vs = f"1e0 + 0.6e0 * ({at_least('(asic_voltage_v - 12.5e0) / 12.5e0', 0)})"
_es = f"1e0 + 0.4e0 * ({at_least('(ambient_temperature_c - 25e0) / 10e0', 0)})"
cte("te_open", f"""SELECT *, base_eff_th_per_w / nullif({at_least('voltage_stress_factor * environment_stress_factor * mode_stress_factor', 1e-6)}, 0) AS te
FROM (SELECT *, asic_hashrate_ths / total_power_w AS base_eff_th_per_w FROM (SELECT *, {_total} AS total_power_w,
{_vs} AS voltage_stress_factor, {_es} AS environment_stress_factor, {mode_factor('operating_mode')} AS mode_stress_factor
FROM clean) AS a) AS b""", ["clean"])
cte("te_full", "SELECT * EXCLUDE (te), coalesce(te, (SELECT median(te) FROM te_open)) AS true_efficiency_te FROM te_open", ["te_open"])
_TE = ["total_power_w", "base_eff_th_per_w", "voltage_stress_factor", "environment_stress_factor", "mode_stress_factor", "true_efficiency_te"]
add("kpi_true_efficiency", lambda s, p: k.true_efficiency(v.clean(s, p)).select("id", "operating_mode", *_TE),
    "SELECT id, operating_mode, " + ", ".join(_TE) + " FROM te_full", ["te_full"], _TE)


def flagship(s, p):
    """Mean true efficiency per mode: source, cleaning, KPI, median fill and aggregation."""
    return k.true_efficiency(v.clean(s, p)).groupBy("operating_mode").agg(
        F.count(F.lit(1)).alias("n"), F.avg("true_efficiency_te").alias("mean_te"))


add("kpi_by_mode", flagship, "SELECT operating_mode, count(*) AS n, avg(true_efficiency_te) AS mean_te FROM te_full GROUP BY 1", ["te_full"], ["mean_te"])


def _worker(s, p):
    """Some power, rate, voltage and mode values removed, so that every default is used."""
    t = v.clean(s, p)
    for i, c in enumerate(["asic_power_w", "asic_voltage_v", "ambient_temperature_c", "operating_mode"]):
        t = t.withColumn(c, F.when(F.col("id") % 11 != i, F.col(c)))
    return t.select("id", k.te_worker().alias("plain"), k.te_worker(0.3, F.col("cooling_power_w")).alias("with_cooling"))


cte("holes", "SELECT * REPLACE (" + ", ".join(f"CASE WHEN id % 11 <> {i} THEN {c} END AS {c}" for i, c in enumerate(
    ["asic_power_w", "asic_voltage_v", "ambient_temperature_c", "operating_mode"])) + ") FROM clean", ["clean"])
add("kpi_te_worker", _worker, f"""SELECT id, {te_sql('coalesce(asic_power_w, 0e0) * 0.24e0')} AS plain,
{te_sql('coalesce(cooling_power_w, coalesce(asic_power_w, 0e0) * 0.3e0)')} AS with_cooling FROM holes""", ["holes"], ["plain", "with_cooling"])
_prod = f"({_vs}) * ({_es}) * ({mode_factor('operating_mode')})"
add("kpi_te_snapshot", lambda s, p: v.clean(s, p).select("id", k.te_snapshot().alias("te")),
    f"SELECT id, CAST(round(CAST(asic_hashrate_ths / greatest(asic_power_w + asic_power_w * 0.24e0, 1e-6) / ({at_least(_prod, 1e-6)}) AS DECIMAL(38, 17)), 6) AS DOUBLE) AS te FROM clean",
    ["clean"], ["te"])
add("kpi_efficiency", lambda s, p: v.clean(s, p).select("id", k.efficiency().alias("efficiency_j_per_th")),
    "SELECT id, round_even(asic_power_w / nullif(asic_hashrate_ths, 0), 4) AS efficiency_j_per_th FROM clean", ["clean"], ["efficiency_j_per_th"])

_fr = 'OVER (PARTITION BY miner_id ORDER BY "timestamp", id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)'
_cv = f"CASE WHEN count(asic_power_w) {_fr} >= 2 THEN stddev_pop(asic_power_w) {_fr} / nullif(avg(asic_power_w) {_fr}, 0) END"
cte("instability", f"SELECT * REPLACE (round_even({between(f'coalesce({_cv}, 0e0)', 0, 1)}, 4) AS power_instability_index) FROM clean", ["clean"])
add("kpi_power_instability", lambda s, p: k.power_instability(v.clean(s, p)).select("id", "power_instability_index"),
    "SELECT id, power_instability_index FROM instability", ["instability"], ["power_instability_index"])
cte("mode_medians", "SELECT operating_mode AS m, median(asic_hashrate_ths) AS med FROM clean GROUP BY 1", ["clean"])
_dev = "round_even((asic_hashrate_ths - med) / nullif(med, 0) * 100e0, 2)"
add("kpi_hashrate_deviation_mode", lambda s, p: k.hashrate_deviation_by_mode(v.clean(s, p)).select("id", "hashrate_deviation_pct"),
    f"SELECT id, {_dev} AS hashrate_deviation_pct FROM clean JOIN mode_medians ON operating_mode = m", ["mode_medians", "clean"], ["hashrate_deviation_pct"])
add("kpi_hashrate_deviation_batch", lambda s, p: k.hashrate_deviation_by_mode(
        v.clean(s, p).withColumn("batch_id", F.floor(F.col("id") / 5000)), "batch_id").select("id", "hashrate_deviation_pct"),
    f"""SELECT id, {_dev} AS hashrate_deviation_pct FROM clean JOIN (SELECT operating_mode AS m, id // 5000 AS b,
median(asic_hashrate_ths) AS med FROM clean GROUP BY 1, 2) AS g ON operating_mode = m AND id // 5000 = b""", ["clean"], ["hashrate_deviation_pct"])

_NEW = ["miner_id", "timestamp", "efficiency_j_per_th", "power_instability_index", "hashrate_deviation_pct", "true_efficiency_te", S.TARGET, "chip_temp_max"]
add("kpi_incremental", lambda s, p: k.kpi_incremental(v.clean(s, p), v.kpi(s, p).filter("id % 3 <> 0")).select(*_NEW),
    f"""SELECT miner_id, "timestamp", round_even(asic_power_w / nullif(asic_hashrate_ths, 0), 4) AS efficiency_j_per_th,
power_instability_index, {_dev} AS hashrate_deviation_pct, {te_sql('coalesce(asic_power_w, 0e0) * 0.24e0')} AS true_efficiency_te,
CAST(0 AS BIGINT) AS failure_within_horizon, chip_temp_max FROM instability JOIN mode_medians ON operating_mode = m
WHERE NOT EXISTS (SELECT 1 FROM clean AS c WHERE c.id % 3 <> 0 AND c.miner_id = instability.miner_id AND c."timestamp" = instability."timestamp")""",
    ["instability", "mode_medians"], [c for c in _NEW if c not in ("miner_id", "timestamp", S.TARGET)])

_METRICS = ["true_efficiency_te", "efficiency_j_per_th", "asic_power_w", "cooling_power_w", "asic_hashrate_ths"]
_stats = {
    ("rows", "rows"): "count(*)", ("te_stats", "min"): "min(true_efficiency_te)", ("te_stats", "mean"): "avg(true_efficiency_te)",
    ("te_stats", "max"): "max(true_efficiency_te)", ("te_stats", "median"): "median(true_efficiency_te)",
    ("correlation_with_failure_label", S.TARGET): corr("true_efficiency_te", S.TARGET),
}
add("kpi_summary", lambda s, p: k.kpi_summary(v.kpi(s, p)),
    " UNION ALL ".join(f"SELECT '{a}' AS section, '{b}' AS item, CAST({e} AS DOUBLE) AS value FROM kpi" for (a, b), e in _stats.items())
    + "".join(f" UNION ALL SELECT 'mode_average_metrics', concat(operating_mode, '.{m}'), round_even(avg({m}), 4) FROM kpi GROUP BY operating_mode" for m in _METRICS),
    ["kpi"], ["value"])
