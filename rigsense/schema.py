"""Column lists, plausible ranges and other fixed values of the data model."""

from __future__ import annotations

# --- fixed values: operating modes and their stress factors -----------------
OPERATING_MODES = ["eco", "normal", "turbo"]
MODE_STRESS = {"eco": 0.97, "normal": 1.00, "turbo": 1.08}
V_REF, T_REF, ALPHA_V, ALPHA_E = 12.5, 25.0, 0.6, 0.4
COOLING_RATIO = 0.24

# --- fixed values: required offline columns and plausible ranges ------------
REQUIRED_COLUMNS = [
    "timestamp", "miner_id", "operating_mode", "ambient_temperature_c", "cooling_power_w",
    "asic_clock_mhz", "asic_voltage_v", "asic_hashrate_ths", "asic_temperature_c",
    "asic_power_w", "efficiency_j_per_th", "power_instability_index",
    "hashrate_deviation_pct", "failure_within_horizon",
]
PLAUSIBLE_RANGES = {
    "ambient_temperature_c": (-5.0, 55.0),
    "cooling_power_w": (50.0, 2500.0),
    "asic_clock_mhz": (250.0, 900.0),
    "asic_voltage_v": (10.0, 15.0),
    "asic_hashrate_ths": (5.0, 300.0),
    "asic_temperature_c": (20.0, 125.0),
    "asic_power_w": (500.0, 5000.0),
    "efficiency_j_per_th": (10.0, 80.0),
    "power_instability_index": (0.0, 1.0),
    "hashrate_deviation_pct": (-60.0, 60.0),
    "failure_within_horizon": (0.0, 1.0),
}
NUMERIC_COLUMNS = list(PLAUSIBLE_RANGES)

# --- fixed values: upload columns and their types ---------------------------
UPLOAD_TYPES = {
    "timestamp": "timestamp", "miner_id": "string", "asic_clock_mhz": "double",
    "asic_voltage_v": "double", "asic_hashrate_ths": "double", "asic_temperature_c": "double",
    "asic_power_w": "double", "operating_mode": "string", "ambient_temperature_c": "double",
    "chip_temp_max": "double", "chip_temp_std": "double", "bad_hash_count": "int",
    "double_hash_count": "int", "read_errors": "int", "event_codes": "string",
    "expected_hashrate_ths": "double",
}
UPLOAD_TEXT = ["miner_id", "operating_mode", "event_codes"]
KPI_TYPES = {
    **{c: UPLOAD_TYPES[c] for c in list(UPLOAD_TYPES)[:9]},
    "efficiency_j_per_th": "double", "power_instability_index": "double",
    "hashrate_deviation_pct": "double", "true_efficiency_te": "double",
    "failure_within_horizon": "int",
    **{c: UPLOAD_TYPES[c] for c in list(UPLOAD_TYPES)[9:]},
}
RISK_TYPES = {
    "predicted_at": "timestamp", "miner_id": "string", "risk_score": "double",
    "risk_band": "string", "predicted_failure": "boolean", "model_version": "string",
}
MAX_UPLOAD_BYTES, MAX_UPLOAD_ROWS = 10_485_760, 200_000

# --- fixed values: model features -------------------------------------------
BASE_FEATURES = [
    "ambient_temperature_c", "cooling_power_w", "asic_clock_mhz", "asic_voltage_v",
    "asic_hashrate_ths", "asic_temperature_c", "asic_power_w", "efficiency_j_per_th",
    "power_instability_index", "hashrate_deviation_pct", "true_efficiency_te",
]
ENGINEERED_FEATURES = [
    "temp_roll_mean_1h", "temp_roll_max_1h", "temp_roll_std_1h", "temp_roll_mean_4h",
    "temp_delta_10m", "power_instability_roll_mean_1h", "power_instability_roll_std_4h",
    "power_delta_10m", "hashrate_roll_mean_1h", "hashrate_roll_mean_12h",
    "hashrate_degradation_pct_12h", "te_roll_mean_4h", "te_drift_pct_4h", "te_delta_10m",
    "thermal_margin_to_95c", "voltage_stress_index", "mode_peer_hashrate_dev_pct",
    "mode_peer_temp_dev_c", "mode_peer_te_dev_pct", "hashrate_residual", "chip_temp_imbalance",
]
NUMERIC_FEATURES = BASE_FEATURES + ENGINEERED_FEATURES
CATEGORICAL_FEATURES = ["operating_mode"]
TARGET = "failure_within_horizon"
ROWS_1H, ROWS_4H, ROWS_12H = 6, 24, 72

# --- fixed values: analytics columns ----------------------------------------
EDA_COLUMNS = BASE_FEATURES + [TARGET]
API_CORRELATION_COLUMNS = [
    "asic_clock_mhz", "asic_voltage_v", "asic_hashrate_ths", "asic_temperature_c",
    "asic_power_w", "efficiency_j_per_th", "true_efficiency_te",
]
ZSCORE_COLUMNS = API_CORRELATION_COLUMNS[:5]
ROLLUP_SOURCES = {  # rollup column -> telemetry column it averages
    "avg_hashrate": "asic_hashrate_ths", "avg_temperature": "asic_temperature_c",
    "avg_power": "asic_power_w", "avg_clock": "asic_clock_mhz", "avg_voltage": "asic_voltage_v",
    "avg_efficiency_j_per_th": "efficiency_j_per_th",
    "avg_true_efficiency_te": "true_efficiency_te",
}
TRADEOFF_COLUMNS = [
    "asic_hashrate_ths", "asic_power_w", "cooling_power_w", "asic_temperature_c",
    "efficiency_j_per_th", "true_efficiency_te", "power_instability_index", TARGET,
]
KEY_CORRELATIONS = [
    ("asic_clock_mhz", "asic_hashrate_ths"), ("asic_voltage_v", "asic_power_w"),
    ("ambient_temperature_c", "asic_temperature_c"), ("asic_power_w", "asic_temperature_c"),
    ("power_instability_index", TARGET), ("true_efficiency_te", TARGET),
]
TRADEOFF_CHARTS = [
    ("to-power-hash", "asic_power_w", "asic_hashrate_ths"),
    ("to-temp-hash", "asic_temperature_c", "asic_hashrate_ths"),
    ("to-clock-hash", "asic_clock_mhz", "asic_hashrate_ths"),
    ("to-voltage-temp", "asic_voltage_v", "asic_temperature_c"),
]

# --- fixed values: risk bands (lowest score of each band) -------------------
BANDS_OFFLINE = [(0.75, "critical"), (0.55, "high"), (0.35, "medium")]
BANDS_WORKER = [(0.75, "critical"), (0.50, "high"), (0.30, "medium")]

# --- fixed values: maintenance actions, in order of preference on ties ------
# (action, power factor, hashrate factor, risk factor, cost in USD, downtime in hours)
ACTIONS = [
    ("CONTINUE", 1.00, 1.00, 1.00, 0.0, 0.0),
    ("WATCHLIST", 1.00, 1.00, 0.96, 0.2, 0.0),
    ("DOWNCLOCK", 0.88, 0.93, 0.78, 1.2, 0.0),
    ("REBOOT", 0.95, 0.97, 0.62, 2.8, 0.15),
    ("PULL_FOR_MAINTENANCE", 0.0, 0.0, 0.55, 35.0, 1.5),
]

# --- fixed values: settings -------------------------------------------------
BOOLEAN_SETTINGS = ["policy_optimizer_enabled", "automation_require_policy_backtest"]
INTEGER_SETTINGS = {
    "smtp_port": (1, 65535), "alert_cooldown_hours": (0, 168), "retrain_days": (1, 3650),
}
FLOAT_SETTINGS = {
    "risk_threshold": (0.05, 0.99), "policy_min_uplift_usd_per_miner": (0.0, 1000.0),
    "hashprice_usd_per_ph_day": (0.0, 100000.0), "opex_usd_per_mwh": (0.0, 10000.0),
    "capex_usd_per_mwh": (0.0, 10000.0), "energy_price_usd_per_kwh": (0.0, 5.0),
    "curtailment_penalty_multiplier": (1.0, 20.0),
    "policy_reward_per_th_hour_usd": (0.0, 1000.0),
    "policy_failure_cost_usd": (0.0, 1000000.0), "policy_horizon_hours": (0.25, 168.0),
    "risk_probability_horizon_hours": (1.0, 720.0),
}
JSON_OBJECT_SETTINGS = ["energy_price_schedule_json"]
JSON_ARRAY_SETTINGS = ["curtailment_windows_json"]
TIMEZONE_SETTINGS = ["policy_timezone"]
TEXT_SETTINGS = [
    "smtp_host", "smtp_user", "smtp_password", "alert_from_email", "alert_to_emails",
    "telegram_bot_token", "telegram_chat_id",
]
SECRET_SETTINGS = ["smtp_password", "telegram_bot_token"]
MAX_SETTING_TEXT = 4096
SETTING_DEFAULTS = {
    "risk_threshold": "0.55", "alert_cooldown_hours": "1", "inference_lookback_hours": "24",
    "cooling_power_ratio": "0.24", "control_mode": "advisory", "retrain_days": "30",
    "policy_optimizer_enabled": "true", "automation_require_policy_backtest": "true",
    "policy_min_uplift_usd_per_miner": "0.25", "energy_price_usd_per_kwh": "0.08",
    "hashprice_usd_per_ph_day": "55", "opex_usd_per_mwh": "8", "capex_usd_per_mwh": "20",
    "energy_price_schedule_json": "{}", "curtailment_windows_json": "[]",
    "curtailment_penalty_multiplier": "2.0", "policy_reward_per_th_hour_usd": "0.0022916667",
    "policy_failure_cost_usd": "300", "policy_horizon_hours": "1.0",
    "risk_probability_horizon_hours": "24", "policy_timezone": "UTC", "smtp_host": "",
    "smtp_port": "587", "smtp_user": "", "smtp_password": "", "alert_from_email": "",
    "alert_to_emails": "", "telegram_bot_token": "", "telegram_chat_id": "",
}
# key -> stored values that count as "never changed by an operator"
LEGACY_SETTING_VALUES = {
    "curtailment_penalty_multiplier": ["", "1.5"],
    "policy_reward_per_th_hour_usd": ["", "0.0025"],
    "policy_failure_cost_usd": ["", "120"],
    "inference_lookback_hours": [""],
    "cooling_power_ratio": [""],
}
TRUTHY = ["1", "true", "yes", "on"]
BOOLEAN_TEXT = ["1", "0", "true", "false", "yes", "no", "on", "off"]
CONTROL_MODES = ["advisory", "actuation"]

# --- fixed values: source URL rules -----------------------------------------
URL_SCHEMES = ["http", "https"]
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "metadata", "metadata.google.internal"]


def ddl(types: dict[str, str]) -> str:
    """A column -> type mapping as a Spark DDL string."""
    return ", ".join(f"`{c}` {t}" for c, t in types.items())
