"""Economic policy and alert generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.operators import alerts as al
from rigsense.operators import policy as po
from rigsense.operators import scoring as sc
from rigsense.operators.settings import typed_runtime_config
from rigsense.queries.registry import add, cte, d, num
from rigsense.sources import views as v

_NEWEST = 'SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp" DESC, id DESC) AS rn FROM risk) AS r WHERE rn = 1'
cte("scored", _NEWEST, ["risk"])


def _site_settings(s, p):
    """Wide policy settings per site, invalid entries included."""
    return typed_runtime_config(v.settings(s, p), ["site"]).select("site", *po.POLICY_SETTINGS)


# --- settings to configuration
def _wide(key: str) -> str:
    return f"coalesce(max(CASE WHEN \"key\" = '{key}' AND value <> '' THEN value END), '{S.SETTING_DEFAULTS[key]}') AS {key}"


_MORE = ["risk_threshold", "alert_cooldown_hours", "inference_lookback_hours", "cooling_power_ratio", "retrain_days", "control_mode"]
cte("site_settings", "SELECT site, " + ", ".join(_wide(k) for k in po.POLICY_SETTINGS) + ' FROM settings WHERE "key" IN ('
    + ", ".join(f"'{k}'" for k in [*_MORE, *po.POLICY_SETTINGS]) + ") GROUP BY site", ["settings"])


def _number(key: str) -> str:
    _, default, floor = po.NUMBERS[key]
    x = f"coalesce({num(key)}, {d(default)})"
    return x if floor is None else f"greatest({x}, {d(floor)})"


_hash = _number("hashprice_usd_per_ph_day")
_NUMS = [name for name, _, _ in po.NUMBERS.values()]
cte("configs", "SELECT site, " + ", ".join(f"{_number(k)} AS {po.NUMBERS[k][0]}" for k in po.NUMBERS) + f""",
lower(trim(policy_optimizer_enabled)) IN ('1', 'true', 'yes', 'on') AS optimizer_enabled,
lower(trim(automation_require_policy_backtest)) IN ('1', 'true', 'yes', 'on') AS require_backtest,
CASE WHEN trim(policy_reward_per_th_hour_usd) = '' THEN {_hash} / 1000e0 / 24e0
 ELSE greatest(coalesce({num('policy_reward_per_th_hour_usd')}, {_hash} / 1000e0 / 24e0), 0e0) END AS reward_per_th_hour_usd,
CASE WHEN trim(policy_timezone) = '' THEN 'UTC' ELSE trim(policy_timezone) END AS timezone, energy_price_schedule_json, curtailment_windows_json FROM site_settings""", ["site_settings"])
add("policy_config", lambda s, p: po.policy_config(_site_settings(s, p)).drop("energy_price_schedule", "curtailment_windows"),
    "SELECT * EXCLUDE (energy_price_schedule_json, curtailment_windows_json) FROM configs", ["configs"], [*_NUMS, "reward_per_th_hour_usd"])
# The JSON texts of the view and what they must become.
_SCHEDULE = "CASE energy_price_schedule_json WHEN '{\"18\":0.25,\"x\":1,\"3\":-2}' THEN '3=0.0;18=0.25' WHEN '[{\"hour\":4,\"price\":0.3},{\"hour\":99,\"price\":1}]' THEN '4=0.3' ELSE '' END"
add("price_schedule", lambda s, p: _site_settings(s, p).select("site", F.array_join(F.transform(
        F.array_sort(F.map_entries(po.price_schedule(F.col("energy_price_schedule_json")))), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"].cast("string"))), ";").alias("schedule")),
    f"SELECT site, {_SCHEDULE} AS schedule FROM configs", ["configs"])
_IS_WINDOW = "curtailment_windows_json LIKE '%start_hour%'"
add("curtailment_windows", lambda s, p: _site_settings(s, p).select("site", F.array_join(F.transform(
        po.curtailment_windows(F.col("curtailment_windows_json")), lambda w: F.concat(w["start_hour"].cast("string"), F.lit("-"), w["end_hour"].cast("string"))), ";").alias("windows")),
    f"SELECT site, CASE WHEN {_IS_WINDOW} THEN '17-3' ELSE '' END AS windows FROM configs", ["configs"])


def _per_site(s, p):
    """Devices scored under the settings of their own site; a device and its site share a number."""
    cfg = po.policy_config(_site_settings(s, p))
    packed = cfg.select("site", F.struct(*[c for c in cfg.columns if c != "site"]).alias("cfg"))
    rows = v.risk(s, p).withColumn("site", F.substring("miner_id", 3, 18).try_cast("bigint"))
    return rows.join(packed, "site")


cte("priced", f"""SELECT r.*, c.* EXCLUDE (site), local_hour, inside AS in_curtailment_window,
greatest(CASE WHEN inside THEN base * curtailment_penalty_multiplier ELSE base END, 0e0) AS energy_price FROM (SELECT id AS rid, site AS rsite, local_hour,
coalesce({_IS_WINDOW} AND (local_hour >= 17 OR local_hour < 3), false) AS inside,
coalesce(CASE WHEN {_SCHEDULE} = '3=0.0;18=0.25' AND local_hour = 18 THEN 0.25e0 WHEN {_SCHEDULE} = '3=0.0;18=0.25' AND local_hour = 3 THEN 0e0
 WHEN {_SCHEDULE} = '4=0.3' AND local_hour = 4 THEN 0.3e0 END, energy_price_usd_per_kwh) AS base FROM (SELECT risk.id, c.*,
 (extract(hour FROM "timestamp") + CASE timezone WHEN 'Europe/Berlin' THEN 1 ELSE 0 END) % 24 AS local_hour
 FROM risk JOIN configs AS c ON concat('m-', c.site) = risk.miner_id) AS h) AS x
JOIN risk AS r ON r.id = x.rid JOIN configs AS c ON c.site = x.rsite""", ["risk", "configs"])
add("energy_price", lambda s, p: po.energy_price(_per_site(s, p)).select("id", "local_hour", "in_curtailment_window", "energy_price"),
    "SELECT id, CAST(local_hour AS BIGINT) AS local_hour, in_curtailment_window, energy_price FROM priced", ["priced"], ["energy_price"])

# --- decisions
_OVER = "contains(upper(coalesce(event_codes, '')), 'OVERTEMP')"
_BASE = f"""CASE WHEN risk_score >= 0.85e0 OR {_OVER} THEN 'PULL_FOR_MAINTENANCE' WHEN risk_score >= 0.75e0 THEN 'REBOOT'
WHEN risk_score >= 0.6e0 THEN 'DOWNCLOCK' WHEN risk_score >= 0.35e0 THEN 'WATCHLIST' ELSE 'CONTINUE' END"""
_REASON = f"""CASE WHEN risk_score >= 0.85e0 OR {_OVER} THEN 'baseline_critical_risk_or_overtemp' WHEN risk_score >= 0.75e0 THEN 'baseline_high_risk'
WHEN risk_score >= 0.6e0 THEN 'baseline_medium_high_risk' WHEN risk_score >= 0.35e0 THEN 'baseline_watchlist' ELSE 'baseline_default' END"""
add("policy_baseline", lambda s, p: po.baseline(v.risk(s, p)).select("id", "baseline_action", "baseline_reason", "baseline_automation"),
    f"SELECT id, {_BASE} AS baseline_action, {_REASON} AS baseline_reason, {_BASE} IN ('REBOOT', 'DOWNCLOCK') AS baseline_automation FROM risk", ["risk"])
cte("actions", "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', {i}, {d(p)}, {d(h)}, {d(r)}, {d(c)}, {d(t)})" for i, (a, p, h, r, c, t) in enumerate(S.ACTIONS)) + ") AS t(action, ord, px, hx, rx, icost, down)")
_R0 = "CASE WHEN asic_temperature_c >= 95 THEN least(risk_score + 0.08e0, 1e0) ELSE risk_score END"
_R1 = f"CASE WHEN asic_temperature_c >= 100 THEN least({_R0} + 0.1e0, 1e0) ELSE {_R0} END"
_ALLOW = f"""CASE WHEN risk_score >= 0.97e0 OR asic_temperature_c >= 102 THEN action = 'PULL_FOR_MAINTENANCE'
 WHEN risk_score >= 0.85e0 AND action IN ('CONTINUE', 'WATCHLIST', 'DOWNCLOCK') THEN false
 WHEN risk_score >= 0.75e0 AND action IN ('CONTINUE', 'WATCHLIST') THEN false
 WHEN action = 'REBOOT' AND risk_score < 0.7e0 AND asic_temperature_c < 92 AND NOT {_OVER} THEN false
 WHEN action = 'DOWNCLOCK' AND risk_score < 0.55e0 AND asic_temperature_c < 90 THEN false
 WHEN asic_temperature_c >= 99 AND action IN ('CONTINUE', 'WATCHLIST') THEN false
 WHEN {_OVER} AND action IN ('CONTINUE', 'WATCHLIST') THEN false
 WHEN risk_score < 0.25e0 AND action = 'PULL_FOR_MAINTENANCE' THEN false ELSE true END"""


def money(source: str) -> str:
    """Rows x actions with the utility terms; ``source`` carries the configuration columns."""
    return f"""SELECT *, expected_revenue_usd - energy * all_in_cost_usd_per_mwh - expected_failure_cost_usd - icost AS utility_usd FROM (
SELECT *, energy_price * 1000e0 + opex_usd_per_mwh + capex_usd_per_mwh AS all_in_cost_usd_per_mwh,
coalesce(CASE WHEN eff > 0 AND hashprice_usd_per_ph_day > 0 THEN hashprice_usd_per_ph_day * 1000e0 / (24e0 * eff) END * energy,
 rate * reward_per_th_hour_usd * hours) AS expected_revenue_usd,
r1 * rx * failure_cost_usd * least(1e0, horizon_hours / risk_probability_horizon_hours) AS expected_failure_cost_usd FROM (
SELECT *, power * hours / 1e6 AS energy, CASE WHEN rate > 0 THEN power / rate END AS eff FROM (
SELECT src.*, a.*, {_R1} AS r1, {_ALLOW} AS is_allowed, coalesce(asic_hashrate_ths, 0e0) * hx AS rate, coalesce(asic_power_w, 0e0) * px AS power,
greatest(horizon_hours - down, 0e0) AS hours FROM ({source}) AS src, actions AS a) AS m1) AS m2) AS m3"""


_DEFAULT = """0.08e0 AS energy_price, 0.25e0 AS min_uplift_usd_per_miner, 55e0 AS hashprice_usd_per_ph_day, 8e0 AS opex_usd_per_mwh, 20e0 AS capex_usd_per_mwh,
300e0 AS failure_cost_usd, 1e0 AS horizon_hours, 24e0 AS risk_probability_horizon_hours, 55e0 / 1000e0 / 24e0 AS reward_per_th_hour_usd"""
cte("money", money(f"SELECT *, {_DEFAULT} FROM risk"), ["risk", "actions"])
cte("site_money", money("SELECT * FROM priced"), ["priced", "actions"])
_TERMS = ["utility_usd", "expected_revenue_usd", "expected_failure_cost_usd", "all_in_cost_usd_per_mwh"]
add("action_utility", lambda s, p: po.action_table(v.risk(s, p), ["id"]).select("id", "action", *_TERMS),
    f"SELECT id, action, {', '.join(_TERMS)} FROM money", ["money"], _TERMS)
add("action_utility_per_site", lambda s, p: po.action_table(_per_site(s, p), ["id"]).select("id", "action", *_TERMS),
    f"SELECT id, action, {', '.join(_TERMS)} FROM site_money", ["site_money"], _TERMS)
add("action_allowed", lambda s, p: po.action_table(v.risk(s, p), ["id"]).select("id", "action", "is_allowed"),
    f"SELECT id, action, {_ALLOW} AS is_allowed FROM risk, actions", ["risk", "actions"])
for _name, _src in [("choices", "money"), ("site_choices", "site_money")]:
    cte(_name, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY utility_usd DESC, ord) AS rn FROM {_src} WHERE is_allowed) AS r WHERE rn = 1", [_src])
_PICK = "SELECT id, action AS optimized_action, concat('optimized_max_utility_', lower(action)) AS optimized_reason, action IN ('DOWNCLOCK', 'REBOOT') AS optimized_automation, utility_usd AS expected_utility_usd FROM "
_PICKED = ["id", "optimized_action", "optimized_reason", "optimized_automation", "expected_utility_usd"]
add("policy_optimized", lambda s, p: po.optimized(v.risk(s, p)).select(*_PICKED), _PICK + "choices", ["choices"], ["expected_utility_usd"])
add("policy_optimized_per_site", lambda s, p: po.optimized(_per_site(s, p)).select(*_PICKED), _PICK + "site_choices", ["site_choices"], ["expected_utility_usd"])


def backtest_sql(source: str, money_cte: str, choice: str) -> str:
    mixes = ", ".join(f"count(CASE WHEN base = '{a[0]}' THEN 1 END) AS baseline_{a[0].lower()}, count(CASE WHEN opt = '{a[0]}' THEN 1 END) AS optimized_{a[0].lower()}" for a in S.ACTIONS)
    return f"""SELECT count(*) AS samples, round(avg(ub), 4) AS baseline_avg_utility_usd, round(avg(uo), 4) AS optimized_avg_utility_usd,
round(avg(uo) - avg(ub), 4) AS avg_uplift_usd_per_miner, round(sum(uo) - sum(ub), 4) AS total_uplift_usd, {mixes},
round(avg(CASE WHEN base IN ('DOWNCLOCK', 'REBOOT') THEN 1e0 ELSE 0e0 END), 4) AS baseline_automation_rate,
round(avg(CASE WHEN opt IN ('DOWNCLOCK', 'REBOOT') THEN 1e0 ELSE 0e0 END), 4) AS optimized_automation_rate,
0.25e0 AS minimum_required_uplift, avg(uo) - avg(ub) >= 0.25e0 AS passed FROM (
SELECT r.base, c.action AS opt, m.utility_usd AS ub, c.utility_usd AS uo FROM (SELECT id, {_BASE} AS base FROM {source}) AS r
JOIN {money_cte} AS m ON m.id = r.id AND m.action = r.base JOIN {choice} AS c ON c.id = r.id) AS j"""


_BT = ["baseline_avg_utility_usd", "optimized_avg_utility_usd", "avg_uplift_usd_per_miner", "total_uplift_usd", "baseline_automation_rate", "optimized_automation_rate", "minimum_required_uplift"]
add("policy_backtest", lambda s, p: po.backtest(v.risk(s, p)), backtest_sql("risk", "money", "choices"), ["risk", "choices"], _BT)
add("policy_backtest_empty", lambda s, p: po.backtest(v.risk(s, p).filter("risk_score < 0")),
    "SELECT count(*) AS samples, " + ", ".join(f"0e0 AS {c}" for c in _BT[:-1]) + ", 0.25e0 AS minimum_required_uplift, "
    + ", ".join(f"count(*) AS baseline_{a[0].lower()}, count(*) AS optimized_{a[0].lower()}" for a in S.ACTIONS) + ", true AS passed FROM risk WHERE risk_score < 0",
    ["risk"], _BT)

# --- alerts
AL_T = 0.3


def _alerts(mode):
    def run(s, p):
        scored = sc.risk_heuristic(v.kpi(s, p))
        return al.alert_generate(scored, v.alerts(s, p), v.AS_OF, AL_T, cooldown_hours=48, control_mode=mode)

    return run


def alerts_sql(mode: str) -> str:
    gate = "" if mode == "actuation" else f"CASE WHEN auto THEN '|automation_gated_by_mode:{mode}' ELSE '' END"
    notes = "CASE WHEN auto AND NOT passed THEN '|automation_gated_by_backtest' ELSE '' END" + (f" || {gate}" if gate else "")
    return f"""SELECT TIMESTAMP '2024-01-31 00:00:00' AS created_at, miner_id, severity, round(risk_score, 4) AS risk_score,
concat('Risk score ', pct, ' exceeds threshold; policy=optimized; reason=optimized_max_utility_', lower(action), util, gates) AS trigger_reason,
concat('Miner ', miner_id, ' — ', upper(severity), ': predicted failure risk ', pct, '. Action=', action, ' (optimized)', util, gates) AS message,
action AS recommended_action, auto AND passed AND {'true' if mode == 'actuation' else 'false'} AS automation_triggered FROM (
SELECT *, CASE WHEN notes = '' THEN '' ELSE concat('; ', substr(notes, 2)) END AS gates FROM (
SELECT *, {notes} AS notes FROM (SELECT s.miner_id, s.risk_score, c.action, CASE WHEN s.risk_score >= 0.75e0 THEN 'critical' ELSE 'warning' END AS severity,
printf('%.2f%%', s.risk_score * 100) AS pct, printf(', utility=$%.2f', c.utility_usd) AS util, c.action IN ('DOWNCLOCK', 'REBOOT') AS auto,
(SELECT passed FROM test) AS passed FROM scored AS s JOIN choices AS c ON c.id = s.id WHERE s.risk_score >= {d(AL_T)} AND s.miner_id NOT IN (
SELECT miner_id FROM alerts WHERE NOT resolved AND created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR)) AS a) AS b) AS c"""


cte("test", backtest_sql("scored", "money", "choices"), ["scored", "choices"])
add("alert_generate", _alerts("advisory"), alerts_sql("advisory"), ["test", "alerts"], ["risk_score"])
add("alert_generate_actuation", _alerts("actuation"), alerts_sql("actuation"), ["test", "alerts"], ["risk_score"])
