"""Joins, set operations and the fleet, device and alert reads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from rigsense.operators import alerts as al
from rigsense.operators import fleet as fl
from rigsense.operators.analytics import concat_frames
from rigsense.queries.registry import add, cte
from rigsense.sources import views as v

NOW = v.AS_OF
LATE_JAN = datetime(2024, 1, 25)
_newest = 'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY miner_id ORDER BY {t} DESC, id DESC) AS rn FROM {src}) AS r WHERE rn = 1'
cte("newest_tele", _newest.format(t='"timestamp"', src="telemetry"), ["telemetry"])
cte("newest_pred", _newest.format(t="predicted_at", src="predictions"), ["predictions"])
cte("newest_kpi", _newest.format(t='"timestamp"', src="kpi"), ["kpi"])
_LATEST = ", ".join(f"t.{c}" for c in fl.LATEST_COLUMNS)
_DBL = [c for c in fl.LATEST_COLUMNS if c != "operating_mode"]

# --- joins and set operations
add("join_not_exists_kpi", lambda s, p: fl.not_in_table(v.telemetry(s, p), v.kpi(s, p).filter("id % 3 <> 0"), ["miner_id", "timestamp"]).select("id", "miner_id"),
    """SELECT id, miner_id FROM telemetry AS t WHERE NOT EXISTS (SELECT 1 FROM kpi AS k WHERE k.id % 3 <> 0 AND k.miner_id = t.miner_id
AND k."timestamp" = t."timestamp")""", ["telemetry", "kpi"])
add("join_latest_lateral", lambda s, p: fl.latest_for_devices(v.predictions(s, p).select("miner_id").distinct(), v.telemetry(s, p)),
    f'SELECT m.miner_id, t."timestamp" AS last_seen, {_LATEST} FROM (SELECT DISTINCT miner_id FROM predictions) AS m JOIN newest_tele AS t ON t.miner_id = m.miner_id',
    ["newest_tele", "predictions"], _DBL)
add("join_latest_left_lateral", lambda s, p: fl.latest_risk(v.telemetry(s, p).select("miner_id").distinct(), v.predictions(s, p).filter("id % 5 = 0")),
    """SELECT m.miner_id, coalesce(risk_score, 0e0) AS risk_score, coalesce(risk_band, 'unknown') AS risk_band, predicted_at FROM (SELECT DISTINCT miner_id FROM telemetry) AS m
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY miner_id ORDER BY predicted_at DESC, id DESC) AS rn FROM predictions WHERE id % 5 = 0) AS r WHERE rn = 1) AS p
ON p.miner_id = m.miner_id""", ["telemetry", "predictions"], ["risk_score"])
add("join_left_context", lambda s, p: fl.with_latest_context(v.kpi(s, p).select("id", "miner_id", "timestamp"), v.kpi(s, p)),
    'SELECT k.id, k.miner_id, k."timestamp", n.event_codes FROM kpi AS k LEFT JOIN newest_kpi AS n ON n.miner_id = k.miner_id AND n."timestamp" = k."timestamp"',
    ["kpi", "newest_kpi"])
add("join_cross_stats", lambda s, p: fl.with_stats(v.kpi(s, p).select("id", "asic_power_w", "asic_temperature_c"), ["asic_power_w", "asic_temperature_c"]),
    """SELECT id, asic_power_w, asic_temperature_c, mean_asic_power_w, mean_asic_temperature_c, std_asic_power_w, std_asic_temperature_c FROM kpi CROSS JOIN
(SELECT avg(asic_power_w) AS mean_asic_power_w, avg(asic_temperature_c) AS mean_asic_temperature_c, stddev_pop(asic_power_w) AS std_asic_power_w,
stddev_pop(asic_temperature_c) AS std_asic_temperature_c FROM kpi) AS st""", ["kpi"],
    ["asic_power_w", "asic_temperature_c", "mean_asic_power_w", "mean_asic_temperature_c", "std_asic_power_w", "std_asic_temperature_c"])
add("join_cooldown_anti", lambda s, p: fl.without_cooldown(v.predictions(s, p).select("id", "miner_id"), v.alerts(s, p), NOW, 240),
    """SELECT id, miner_id FROM predictions WHERE miner_id NOT IN (SELECT miner_id FROM alerts WHERE NOT resolved
AND created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 240 HOUR)""", ["predictions", "alerts"])


def stored_twice(s, p):
    """Telemetry with some keys stored twice under a larger id."""
    t = v.telemetry(s, p).select("id", "miner_id", "timestamp", "asic_power_w")
    return t.unionByName(t.filter("id % 13 = 0").withColumns({"id": F.col("id") + 1_000_000_000, "asic_power_w": F.lit(1.0)}))


cte("doubled", """SELECT id, miner_id, "timestamp", asic_power_w FROM telemetry UNION ALL
SELECT id + 1000000000, miner_id, "timestamp", 1e0 FROM telemetry WHERE id % 13 = 0""", ["telemetry"])


def _delete_ranked(s, p):
    from rigsense.operators.tables import keep_newest_id

    return keep_newest_id(stored_twice(s, p))


add("join_delete_using", _delete_ranked, """SELECT * FROM doubled AS d WHERE NOT EXISTS (SELECT 1 FROM doubled AS n
WHERE n.miner_id = d.miner_id AND n."timestamp" = d."timestamp" AND n.id > d.id)""", ["doubled"], ["asic_power_w"])
add("set_union_distinct", lambda s, p: fl.seeded_devices(v.predictions(s, p), v.rollup(s, p)),
    "SELECT miner_id FROM predictions UNION SELECT miner_id FROM rollup", ["predictions", "rollup"])


def _fallback(s, p):
    """Known devices with seeds, and the fallback when both seed tables are empty."""
    pred, roll, kpi = v.predictions(s, p), v.rollup(s, p), v.kpi(s, p)
    seeded = fl.known_devices(pred, roll, kpi, NOW).withColumn("kind", F.lit("seeded"))
    empty = fl.known_devices(pred.filter("risk_score < 0"), roll.filter("samples < 0"), kpi, NOW).withColumn("kind", F.lit("fallback"))
    return seeded.unionByName(empty)


add("set_union_all_fallback", _fallback, """SELECT miner_id, 'seeded' AS kind FROM (SELECT miner_id FROM predictions UNION SELECT miner_id FROM rollup) AS s
UNION ALL SELECT DISTINCT miner_id, 'fallback' FROM kpi WHERE "timestamp" >= TIMESTAMP '2024-01-24 00:00:00'""", ["predictions", "rollup", "kpi"])
add("concat_frames", lambda s, p: concat_frames(
        v.telemetry(s, p).select("id", "miner_id", "asic_power_w"), v.predictions(s, p).select("id", "miner_id", "risk_score")),
    "SELECT id, miner_id, asic_power_w, CAST(NULL AS DOUBLE) AS risk_score FROM telemetry UNION ALL SELECT id, miner_id, NULL, risk_score FROM predictions",
    ["telemetry", "predictions"], ["asic_power_w", "risk_score"])
add("semi_in_list", lambda s, p: fl.in_list(v.settings(s, p), "key", v.table(s, p, "events").filter("event_type = 'error'").select(
        F.element_at(F.array(*[F.lit(k) for k in v.SETTING_KEYS[:10]]), (F.col("event_id") % 10 + 1).cast("int")).alias("key"))),
    """SELECT * FROM settings WHERE "key" IN (SELECT list_extract([""" + ", ".join(f"'{k}'" for k in v.SETTING_KEYS[:10])
    + "], CAST(event_id % 10 AS INTEGER) + 1) FROM events WHERE event_type = 'error')", ["settings"])

# --- fleet
cte("fleet_rows", f"""SELECT m.miner_id, t."timestamp" AS last_seen, {_LATEST}, coalesce(p.risk_score, 0e0) AS risk_score, coalesce(p.risk_band, 'unknown') AS risk_band,
p.predicted_at FROM (SELECT miner_id FROM predictions UNION SELECT miner_id FROM rollup) AS m JOIN newest_tele AS t ON t.miner_id = m.miner_id
LEFT JOIN newest_pred AS p ON p.miner_id = m.miner_id""", ["newest_tele", "newest_pred", "rollup"])


def _fleet(s, p, limit, offset):
    devices = fl.known_devices(v.predictions(s, p), v.rollup(s, p), v.kpi(s, p), NOW)
    return fl.fleet_status(devices, v.telemetry(s, p), v.predictions(s, p), limit, offset)


add("fleet_status", lambda s, p: _fleet(s, p, 500, 0), "SELECT * FROM fleet_rows ORDER BY risk_score DESC, miner_id LIMIT 500", ["fleet_rows"], [*_DBL, "risk_score"])
add("fleet_status_page", lambda s, p: _fleet(s, p, 25, 25), "SELECT * FROM fleet_rows ORDER BY risk_score DESC, miner_id LIMIT 25 OFFSET 25", ["fleet_rows"], [*_DBL, "risk_score"])


def _summary(s, p):
    devices = fl.known_devices(v.predictions(s, p), v.rollup(s, p), v.kpi(s, p), NOW)
    return fl.fleet_summary(devices, v.telemetry(s, p), v.predictions(s, p))


add("fleet_summary", _summary, """SELECT count(*) AS total_miners, round(avg(asic_hashrate_ths), 2) AS avg_hashrate, round(avg(asic_temperature_c), 1) AS avg_temperature,
round(avg(asic_power_w), 0) AS avg_power, round(sum(asic_hashrate_ths), 2) AS total_hashrate, count(CASE WHEN risk_band = 'critical' THEN 1 END) AS critical_count,
count(CASE WHEN risk_band = 'high' THEN 1 END) AS high_risk_count, count(CASE WHEN risk_band IN ('low', 'medium') THEN 1 END) AS healthy_count FROM fleet_rows""",
    ["fleet_rows"], ["avg_hashrate", "avg_temperature", "avg_power", "total_hashrate"])
add("fleet_filter", lambda s, p: fl.fleet_filter(_fleet(s, p, None, 0), "M-1", "critical").select("miner_id", "risk_band"),
    "SELECT miner_id, risk_band FROM fleet_rows WHERE contains(lower(miner_id), 'm-1') AND risk_band = 'critical'", ["fleet_rows"])
_since = "\"timestamp\" >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 360 HOUR"
add("miner_history", lambda s, p: fl.miner_history(v.telemetry(s, p), "m-8", LATE_JAN, 360),
    f'SELECT "timestamp", {", ".join(fl.LATEST_COLUMNS)} FROM telemetry WHERE miner_id = \'m-8\' AND {_since} ORDER BY "timestamp", id LIMIT 5000', ["telemetry"], _DBL)
_KH = ["true_efficiency_te", "efficiency_j_per_th", "power_instability_index", "hashrate_deviation_pct"]
add("miner_kpi_history", lambda s, p: fl.miner_kpi_history(v.kpi(s, p), "m-8", LATE_JAN, 360),
    f'SELECT "timestamp", {", ".join(_KH)} FROM kpi WHERE miner_id = \'m-8\' AND {_since} ORDER BY "timestamp", id LIMIT 5000', ["kpi"], _KH)
add("miner_risk_history", lambda s, p: fl.miner_risk_history(v.predictions(s, p), "m-8", LATE_JAN, 360),
    f"SELECT predicted_at, risk_score, risk_band, predicted_failure FROM predictions WHERE miner_id = 'm-8' AND {_since.replace(chr(34) + 'timestamp' + chr(34), 'predicted_at')}",
    ["predictions"], ["risk_score"])

# --- alerts
_AL = ", ".join(al.ALERT_FIELDS)
add("alerts_active", lambda s, p: al.alerts_active(v.alerts(s, p)),
    f"SELECT {_AL} FROM alerts WHERE NOT resolved ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, created_at DESC, id DESC LIMIT 100", ["alerts"], ["risk_score"])
add("alerts_history", lambda s, p: al.alerts_history(v.alerts(s, p), 200, 100),
    f"SELECT {_AL} FROM alerts ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 100", ["alerts"], ["risk_score"])


def _resolve(s, p):
    ids = v.table(s, p, "events").filter("event_id % 6 = 0").select("event_id")
    done = al.alert_resolve(v.alerts(s, p), ids, NOW).select("id", "resolved", "resolved_at", F.lit("alert").alias("kind"))
    lost = al.alert_ids_not_found(v.alerts(s, p), ids).select("id", F.lit(False).alias("resolved"), F.lit(None).cast("timestamp").alias("resolved_at"), F.lit("not found").alias("kind"))
    return done.unionByName(lost)


add("alert_resolve", _resolve, """SELECT id, resolved OR id % 6 = 0 AS resolved, CASE WHEN id % 6 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE resolved_at END AS resolved_at,
'alert' AS kind FROM alerts UNION ALL SELECT event_id, false, NULL, 'not found' FROM events WHERE event_id % 6 = 0 AND event_id NOT IN (SELECT id FROM alerts)""", ["alerts"])
add("alerts_pending_automation", lambda s, p: al.alerts_pending_automation(v.alerts(s, p)),
    "SELECT id, miner_id, recommended_action FROM alerts WHERE NOT resolved AND automation_triggered ORDER BY created_at, id LIMIT 50", ["alerts"])


def _acks(s, p):
    acks = v.alerts(s, p).filter("automation_triggered").select(
        "id", (F.col("id") % 2 == 0).alias("success"), (F.col("id") % 4 == 0).alias("acknowledged"))
    return al.alerts_apply_acks(v.alerts(s, p), acks, NOW).select("id", "resolved", "resolved_at")


add("alerts_apply_acks", _acks, """SELECT id, resolved OR (automation_triggered AND id % 4 = 0) AS resolved,
CASE WHEN automation_triggered AND id % 4 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE resolved_at END AS resolved_at FROM alerts""", ["alerts"])
_esc = "replace(replace(replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
cte("pending", "SELECT *, printf('%.2f%%', risk_score * 100) AS pct FROM alerts WHERE NOT resolved AND NOT (email_sent AND telegram_sent) ORDER BY created_at DESC, id DESC LIMIT 50", ["alerts"])
add("alert_outbox", lambda s, p: al.alert_outbox(v.alerts(s, p)).withColumn("subject", F.coalesce("subject", F.lit(""))),
    f"""SELECT id, miner_id, 'email' AS channel, concat('Fleet Alerts: ', severity, ' for ', miner_id) AS subject,
concat('<ul><li>severity: ', severity, '</li><li>device: ', miner_id, '</li><li>risk: ', pct, '</li><li>details: ', {_esc}, '</li></ul>') AS body
FROM pending WHERE NOT email_sent
UNION ALL SELECT id, miner_id, 'telegram', '', concat_ws(chr(10), concat('severity: ', severity), concat('device: ', miner_id), concat('risk: ', pct),
concat('details: ', {_esc})) FROM pending WHERE NOT telegram_sent""", ["pending"])


def _sent(s, p):
    results = v.table(s, p, "events").filter("event_id % 4 < 3").select(
        F.col("event_id").alias("id"), (F.col("event_id") % 2 == 0).alias("email_sent"), (F.col("event_id") % 3 == 0).alias("telegram_sent"))
    return al.alert_mark_sent(v.alerts(s, p), results).select("id", "email_sent", "telegram_sent")


add("alert_mark_sent", _sent, """SELECT id, email_sent OR (id % 4 < 3 AND id % 2 = 0) AS email_sent, telegram_sent OR (id % 4 < 3 AND id % 3 = 0) AS telegram_sent FROM alerts""", ["alerts"])
