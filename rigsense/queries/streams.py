"""Streaming jobs, run over the events file as a stream until it is used up."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.operators.scale import work_dir
from rigsense.plans import training as tr
from rigsense.queries.evaluation import _stored_run
from rigsense.queries.kpis import _dev
from rigsense.queries.registry import add, te_sql
from rigsense.sources import views as v
from rigsense.streaming import jobs


def telemetry_stream(s, p):
    schema = v.table(s, p, "events").schema
    return v.telemetry_from(jobs.read_folder(s, p, schema, "events.parquet"))


def _twice(s, p):
    """The stream with every fifth reading polled a second time."""
    t = telemetry_stream(s, p).select("id", "miner_id", "timestamp", "asic_power_w")
    return t.withColumn("again", F.explode(F.when(F.col("id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again")


def _ingest(s, p):
    path = work_dir(s, "stream-ingest")
    for run in (1, 2):  # the second run has a new checkpoint: everything arrives again
        jobs.ingest(_twice(s, p), f"{path}/table", f"{path}/checkpoint-{run}")
    return s.read.parquet(f"{path}/table").select("id", "miner_id", "timestamp", "asic_power_w")


add("stream_ingest_dedup", _ingest, 'SELECT id, miner_id, "timestamp", asic_power_w FROM telemetry', ["telemetry"], ["asic_power_w"])
_KPI = ["miner_id", "timestamp", "efficiency_j_per_th", "power_instability_index", "hashrate_deviation_pct", "true_efficiency_te"]


def _kpi(s, p):
    path = work_dir(s, "stream-kpi")
    jobs.kpi_job(v.mode_normalize(telemetry_stream(s, p)), path, f"{path}/checkpoint")
    return s.read.parquet(f"{path}/kpi").select(*_KPI)


add("stream_kpi", _kpi, f"""SELECT miner_id, "timestamp", round_even(asic_power_w / nullif(asic_hashrate_ths, 0), 4) AS efficiency_j_per_th, power_instability_index,
{_dev} AS hashrate_deviation_pct, {te_sql('coalesce(asic_power_w, 0e0) * 0.24e0')} AS true_efficiency_te FROM instability JOIN mode_medians ON operating_mode = m""",
    ["instability", "mode_medians"], _KPI[2:])


def _rollup(s, p, as_of):
    path = work_dir(s, "stream-rollup")
    stream = v.as_kpi(v.mode_normalize(telemetry_stream(s, p)))
    jobs.rollup_job(stream, path, f"{path}/checkpoint", as_of)
    return path


add("stream_hourly_rollup", lambda s, p: jobs.merge_rollup(s.read.parquet(_rollup(s, p, v.AS_OF) + "/partials")),
    "SELECT * FROM rollup WHERE bucket >= TIMESTAMP '2024-01-01 00:00:00'", ["rollup"], list(S.ROLLUP_SOURCES))


def _late(s, p):
    """Seen 20 days after the last event, the first third of January is too late."""
    path = _rollup(s, p, v.AS_OF + timedelta(days=10))
    kept = jobs.merge_rollup(s.read.parquet(f"{path}/partials")).agg(F.sum("samples").alias("n")).withColumn("kind", F.lit("in the rollup"))
    late = s.read.parquet(f"{path}/late").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("too late"))
    return kept.unionByName(late)


add("stream_late_data", _late, """SELECT 'in the rollup' AS kind, count(*) AS n FROM telemetry WHERE "timestamp" >= TIMESTAMP '2024-01-11 00:00:00'
UNION ALL SELECT 'too late', count(*) FROM telemetry WHERE "timestamp" < TIMESTAMP '2024-01-11 00:00:00'""", ["telemetry"])


def _score(s, p):
    path = work_dir(s, "stream-score")
    stream = v.as_kpi(v.mode_normalize(telemetry_stream(s, p)))
    jobs.score_job(stream, path, f"{path}/checkpoint", v.AS_OF, 24 * 10)
    return jobs.current_predictions(s, path).select("miner_id", "model_version", "predicted_at", "risk_score", "risk_band", "predicted_failure")


add("stream_score", _score, """SELECT miner_id, 'v1' AS model_version, TIMESTAMP '2024-01-31 00:00:00' AS predicted_at, risk_score, risk_band, predicted_failure FROM (
SELECT *, row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp" DESC, id DESC) AS rn FROM risk WHERE "timestamp" >= TIMESTAMP '2024-01-21 00:00:00') AS r WHERE rn = 1""",
    ["risk"], ["risk_score"])


def _score_model(s, p):
    """The stored model over the stream: windows and peers come from the stored lookback."""
    path, as_of, hours = work_dir(s, "stream-score-model"), v.AS_OF - timedelta(hours=12), 24 * 7
    artifact = _stored_run(s, p)[0]
    stream = v.as_kpi(v.mode_normalize(telemetry_stream(s, p)))
    jobs.score_job(stream, path, f"{path}/checkpoint", as_of, hours, lambda rows: tr.score_model(rows, as_of, artifact, hours), peers=True)
    return jobs.current_predictions(s, path).select("miner_id", "model_version", "predicted_at", "risk_score", "risk_band", "predicted_failure")


add("stream_score_model", _score_model)


def _alerts(s, p):
    """At most one alert per risky device."""
    path = work_dir(s, "stream-alerts")
    stream = v.as_kpi(v.mode_normalize(telemetry_stream(s, p)))
    jobs.alert_job(stream, f"{path}/alerts", f"{path}/checkpoint", v.AS_OF, threshold=0.3)
    return s.read.parquet(f"{path}/alerts").select("miner_id", "severity", "risk_score", "resolved")


add("stream_alert_cooldown", _alerts, """SELECT miner_id, CASE WHEN risk_score >= 0.75e0 THEN 'critical' ELSE 'warning' END AS severity, risk_score, false AS resolved FROM (
SELECT *, row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp" DESC, id DESC) AS rn FROM risk) AS r WHERE rn = 1 AND risk_score >= 0.3e0""", ["risk"], ["risk_score"])
