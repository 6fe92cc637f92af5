"""Profiling and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.operators import quality as q
from rigsense.operators import settings as st
from rigsense.operators import urls
from rigsense.operators.scale import attach_row
from rigsense.queries.registry import add, between, cte, d, num, txt
from rigsense.sources import views as v

RAW_COLUMNS = [
    "timestamp", "miner_id", "operating_mode", "ambient_temperature_c", "cooling_power_w", "asic_clock_mhz",
    "asic_voltage_v", "asic_hashrate_ths", "asic_temperature_c", "asic_power_w", "efficiency_j_per_th",
    "power_instability_index", "hashrate_deviation_pct", "failure_within_horizon", "bad_hash_count",
    "event_codes", "batch_note", "src_ord",
]
RANGED = list(S.PLAUSIBLE_RANGES)
OK_TIME = 'TRY_CAST("timestamp" AS TIMESTAMP)'


def melt(name: str, value: str, cells: dict[str, str], source: str = "raw") -> str:
    """A one-row aggregate as (name, value) rows."""
    inner = ", ".join(f'{expr} AS "{c}"' for c, expr in cells.items())
    rows = " UNION ALL ".join(f"SELECT '{c}' AS \"{name}\", \"{c}\" AS \"{value}\" FROM w" for c in cells)
    return f"SELECT * FROM (WITH w AS (SELECT {inner} FROM {source}) {rows}) AS melted"


def bad_range(c: str) -> str:
    lo, hi = S.PLAUSIBLE_RANGES[c]
    return f"count(CASE WHEN {num(c)} < {d(lo)} OR {num(c)} > {d(hi)} THEN 1 END)"


DUPES = "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM raw GROUP BY miner_id, \"timestamp\") AS g"

# --- profile
add("dq_missing_by_column", lambda s, p: q.missing_by_column(v.raw_text(s, p)),
    melt("column", "missing", {c: f'count(CASE WHEN "{c}" IS NULL THEN 1 END)' for c in RAW_COLUMNS}), ["raw"])
add("dq_parse_nulls", lambda s, p: q.parse_nulls(v.raw_text(s, p)),
    melt("column", "parse_nulls", {c: f"count(CASE WHEN {num(c)} IS NULL THEN 1 END)" for c in S.NUMERIC_COLUMNS}), ["raw"])
add("dq_range_violations", lambda s, p: q.range_violations(v.raw_text(s, p).drop("cooling_power_w")),
    melt("column", "violations", {c: ("CAST(-1 AS BIGINT)" if c == "cooling_power_w" else bad_range(c)) for c in RANGED}).replace(
        "CAST(-1 AS BIGINT) AS", "CAST(max(-1) AS BIGINT) AS"), ["raw"])
add("dq_duplicate_keys", lambda s, p: q.duplicate_keys(v.raw_text(s, p)), DUPES, ["raw"])

_report = {
    ("rows", "rows"): "count(*)",
    ("columns_count", "columns_count"): f"CAST(max({len(RAW_COLUMNS)}) AS BIGINT)",
    **{("missing_values", c): f'count(CASE WHEN "{c}" IS NULL THEN 1 END)' for c in RAW_COLUMNS},
    **{("numeric_parse_nulls", c): f"count(CASE WHEN {num(c)} IS NULL THEN 1 END)" for c in S.NUMERIC_COLUMNS},
    **{("range_violations", c): bad_range(c) for c in RANGED},
    **{("extra_columns", c): "CAST(max(1) AS BIGINT)" for c in RAW_COLUMNS if c not in S.REQUIRED_COLUMNS},
}
REPORT_SQL = (
    "SELECT * FROM (WITH w AS (SELECT " + ", ".join(f'{e} AS "{a}:{b}"' for (a, b), e in _report.items()) + " FROM raw) "
    + " UNION ALL ".join(f"SELECT '{a}' AS section, '{b}' AS item, \"{a}:{b}\" AS value FROM w" for a, b in _report)
    + f" UNION ALL SELECT 'duplicates_by_timestamp_miner', 'duplicates_by_timestamp_miner', duplicates FROM ({DUPES}) AS dup) AS report")
add("dq_report", lambda s, p: q.quality_report(v.raw_text(s, p)), REPORT_SQL, ["raw"])
add("dataset_summary", lambda s, p: q.dataset_summary(v.kpi(s, p)),
    """SELECT count(*) AS row_count, count(DISTINCT miner_id) AS miners, min("timestamp") AS start_timestamp,
max("timestamp") AS end_timestamp, avg(failure_within_horizon) AS positive_label_rate FROM kpi""", ["kpi"], ["positive_label_rate"])

# --- field cleaning
add("clean_project_allowed", lambda s, p: q.project_allowed(v.raw_text(s, p)),
    "SELECT " + ", ".join(f'"{c}"' for c in RAW_COLUMNS if c in S.UPLOAD_TYPES).replace(
        '"timestamp"', "CASE WHEN TRY_CAST(\"timestamp\" AS TIMESTAMP) IS NULL THEN \"timestamp\" ELSE concat(strftime(CAST(\"timestamp\" AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f'), 'Z') END AS \"timestamp\"")
    + " FROM raw", ["raw"])
add("clean_timestamp", lambda s, p: q.clean_timestamp(v.raw_text(s, p)).select("src_ord", "timestamp"),
    f'SELECT src_ord, {OK_TIME} AS "timestamp" FROM raw WHERE {OK_TIME} IS NOT NULL', ["raw"])


def _iso_forms(s, p):
    """The same instant written with Z, with an offset and without zone."""
    t = v.telemetry(s, p)
    utc = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    plus2 = F.date_format(F.col("timestamp") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (F.when(F.col("id") % 4 == 0, F.concat(utc, F.lit("Z")))
            .when(F.col("id") % 4 == 1, F.concat(plus2, F.lit("+02:00")))
            .when(F.col("id") % 4 == 2, utc).otherwise(F.lit(" bad-ts ")))
    return q.clean_timestamp(t.withColumn("timestamp", text)).select("id", "timestamp")


add("clean_timestamp_iso", _iso_forms, 'SELECT id, "timestamp" FROM telemetry WHERE id % 4 <> 3', ["telemetry"])
_NUMS = ["asic_hashrate_ths", "asic_temperature_c", "asic_power_w", "bad_hash_count"]
add("clean_numeric", lambda s, p: q.clean_numeric(v.raw_text(s, p)).select("src_ord", *_NUMS),
    "SELECT src_ord, " + ", ".join(f"{num(c)} AS {c}" for c in _NUMS) + " FROM raw", ["raw"], _NUMS)
add("clean_numeric_finite",
    lambda s, p: q.clean_numeric_finite(v.raw_text(s, p), ["asic_power_w"], ["bad_hash_count"]).select(
        "src_ord", "asic_power_w", F.coalesce("bad_hash_count", F.lit(-99)).alias("bad_hash_count")),
    f"SELECT src_ord, {num('asic_power_w')} AS asic_power_w, CAST(coalesce(trunc({num('bad_hash_count')}), -99) AS BIGINT) AS bad_hash_count FROM raw",
    ["raw"], ["asic_power_w"])
add("clean_text", lambda s, p: q.clean_text(v.raw_text(s, p), ["miner_id", "operating_mode", "event_codes"]).withColumn(
        "codes_strict", q.text_or_null(F.col("event_codes"), True)).select(
        "src_ord", "miner_id", "operating_mode", "event_codes", "codes_strict"),
    f"SELECT src_ord, {txt('miner_id')} AS miner_id, {txt('operating_mode')} AS operating_mode, "
    f"{txt('event_codes')} AS event_codes, {txt('event_codes', True)} AS codes_strict FROM raw", ["raw"])


def _required_id(s, p):
    raw = v.raw_text(s, p)
    kept = q.clean_required_id(q.clean_timestamp(raw)).groupBy("miner_id").agg(F.count(F.lit(1)).alias("kept"))
    with_drops, row = attach_row(kept, q.dropped_counts(raw))
    return with_drops.select("miner_id", "kept", row["bad_timestamps"].alias("bad_timestamps"), row["missing_ids"].alias("missing_ids"))


add("clean_required_id", _required_id,
    f"""SELECT trim(miner_id) AS miner_id, count(*) AS kept,
(SELECT count(*) FROM raw WHERE {OK_TIME} IS NULL) AS bad_timestamps,
(SELECT count(*) FROM raw WHERE {OK_TIME} IS NOT NULL AND (miner_id IS NULL OR trim(miner_id) = '')) AS missing_ids
FROM raw WHERE {OK_TIME} IS NOT NULL AND trim(miner_id) <> '' GROUP BY 1""", ["raw"])
add("clean_default_mode", lambda s, p: q.clean_default_mode(v.raw_text(s, p).drop("operating_mode")).groupBy("operating_mode").agg(
        F.count(F.lit(1)).alias("n")).unionByName(
        q.clean_default_mode(v.raw_text(s, p)).groupBy("operating_mode").agg(F.count(F.lit(1)).alias("n"))),
    "SELECT 'normal' AS operating_mode, count(*) AS n FROM raw UNION ALL SELECT operating_mode, count(*) FROM raw GROUP BY 1", ["raw"])

KEYED = f"""SELECT *, row_number() OVER (PARTITION BY miner_id, "timestamp" ORDER BY src_ord) AS first_rn,
row_number() OVER (PARTITION BY miner_id, "timestamp" ORDER BY src_ord DESC) AS last_rn FROM (
SELECT src_ord, trim(miner_id) AS miner_id, {OK_TIME} AS "timestamp", {num('asic_power_w')} AS asic_power_w FROM raw) AS typed
WHERE miner_id <> '' AND "timestamp" IS NOT NULL"""
cte("keyed", KEYED, ["raw"])


def _keyed(s, p):
    raw = q.clean_numeric(q.clean_timestamp(v.raw_text(s, p)), ["asic_power_w"])
    return q.clean_required_id(raw).select("src_ord", "miner_id", "timestamp", "asic_power_w")


for _name, _fn, _rn in [("dedup_keep_first", q.dedup_keep_first, "first_rn"), ("dedup_keep_last", q.dedup_keep_last, "last_rn")]:
    add(_name, lambda s, p, fn=_fn: fn(_keyed(s, p), ["src_ord"]),
        f'SELECT src_ord, miner_id, "timestamp", asic_power_w FROM keyed WHERE {_rn} = 1', ["keyed"], ["asic_power_w"])

# --- preprocessing
MODE = "CASE WHEN lower(trim(operating_mode)) IN ('eco', 'normal', 'turbo') THEN lower(trim(operating_mode)) ELSE 'normal' END"
add("mode_normalize", lambda s, p: q.mode_normalize(v.raw_text(s, p)).groupBy("operating_mode").agg(F.count(F.lit(1)).alias("n")).unionByName(
        v.raw_text(s, p).agg(F.count(F.when(q.invalid_mode(), F.lit(1))).alias("n")).withColumn("operating_mode", F.lit("(replaced)"))),
    f"SELECT {MODE} AS operating_mode, count(*) AS n FROM raw GROUP BY 1 UNION ALL SELECT '(replaced)', count(*) FROM raw "
    "WHERE operating_mode IS NULL OR lower(trim(operating_mode)) NOT IN ('eco', 'normal', 'turbo')", ["raw"])

cte("core", f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY miner_id, "timestamp" ORDER BY src_ord DESC) AS rn
FROM (SELECT miner_id, src_ord, {OK_TIME} AS "timestamp", {MODE} AS operating_mode, {', '.join(f'{num(c)} AS {c}' for c in RANGED)}
FROM raw WHERE miner_id IS NOT NULL AND {OK_TIME} IS NOT NULL) AS typed) AS ranked WHERE rn = 1""", ["raw"])
_w = 'OVER (PARTITION BY miner_id ORDER BY "timestamp", src_ord ROWS BETWEEN'
cte("filled", "SELECT miner_id, src_ord, \"timestamp\", operating_mode, " + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) {_w} UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({c} IGNORE NULLS) {_w} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in RANGED) + " FROM core", ["core"])
cte("imputed", "SELECT filled.* REPLACE (" + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in RANGED) + ") FROM filled, (SELECT "
    + ", ".join(f"median({c}) AS m_{c}" for c in RANGED) + " FROM filled) AS medians", ["filled"])
cte("clipped", "SELECT * REPLACE (" + ", ".join(f"{between(c, *S.PLAUSIBLE_RANGES[c])} AS {c}" for c in RANGED) + ") FROM imputed", ["imputed"])
cte("effed", """SELECT * REPLACE (coalesce(asic_power_w / nullif(asic_hashrate_ths, 0),
(SELECT median(asic_power_w / nullif(asic_hashrate_ths, 0)) FROM clipped)) AS efficiency_j_per_th) FROM clipped""", ["clipped"])
_dev = "(effed.asic_hashrate_ths - coalesce(nullif(g.m, 0), a.m)) / coalesce(nullif(g.m, 0), a.m) * 100e0"
cte("deviated", f"""SELECT effed.* REPLACE ({between(_dev, -60, 60)} AS hashrate_deviation_pct) FROM effed
LEFT JOIN (SELECT miner_id, operating_mode, median(asic_hashrate_ths) AS m FROM effed GROUP BY 1, 2) AS g
ON effed.miner_id = g.miner_id AND effed.operating_mode = g.operating_mode, (SELECT median(asic_hashrate_ths) AS m FROM effed) AS a""", ["effed"])
LABEL = "CAST(greatest(least(round_even(coalesce(failure_within_horizon, 0e0), 0), 1), 0) AS BIGINT)"
cte("preprocessed", f"SELECT * REPLACE ({LABEL} AS failure_within_horizon) FROM deviated", ["deviated"])

_IMPUTED = ["miner_id", "src_ord", "timestamp", *RANGED]
_key = lambda df, cols: df.select("src_ord", *cols)
add("impute_ffill_bfill_median", lambda s, p: _key(q.impute(q.core_rows(v.raw_text(s, p)), tiebreak=("src_ord",)), RANGED),
    "SELECT src_ord, " + ", ".join(RANGED) + " FROM imputed", ["imputed"], RANGED)
add("clip_ranges", lambda s, p: _key(q.clip_ranges(q.core_rows(v.raw_text(s, p))), RANGED),
    "SELECT src_ord, " + ", ".join(f"{between(c, *S.PLAUSIBLE_RANGES[c])} AS {c}" for c in RANGED) + " FROM core", ["core"], RANGED)
add("clip_ranges_counts", lambda s, p: q.clipped_counts(q.core_rows(v.raw_text(s, p))),
    melt("column", "clipped", {c: f"count(CASE WHEN {c} < {d(S.PLAUSIBLE_RANGES[c][0])} OR {c} > {d(S.PLAUSIBLE_RANGES[c][1])} THEN 1 END)" for c in RANGED}, "core"), ["core"])
add("recompute_efficiency", lambda s, p: _key(q.recompute_efficiency(q.core_rows(v.raw_text(s, p))), ["efficiency_j_per_th"]),
    """SELECT src_ord, coalesce(asic_power_w / nullif(asic_hashrate_ths, 0),
(SELECT median(asic_power_w / nullif(asic_hashrate_ths, 0)) FROM core)) AS efficiency_j_per_th FROM core""", ["core"], ["efficiency_j_per_th"])
_dev2 = _dev.replace("effed.", "core.")
add("recompute_hashrate_deviation", lambda s, p: _key(q.recompute_hashrate_deviation(q.core_rows(v.raw_text(s, p))), ["hashrate_deviation_pct"]),
    f"""SELECT src_ord, {between(_dev2, -60, 60)} AS hashrate_deviation_pct FROM core
LEFT JOIN (SELECT miner_id, operating_mode, median(asic_hashrate_ths) AS m FROM core GROUP BY 1, 2) AS g
ON core.miner_id = g.miner_id AND core.operating_mode = g.operating_mode, (SELECT median(asic_hashrate_ths) AS m FROM core) AS a""",
    ["core"], ["hashrate_deviation_pct"])
add("label_normalize", lambda s, p: _key(q.label_normalize(q.core_rows(v.raw_text(s, p))), [S.TARGET]),
    f"SELECT src_ord, {LABEL} AS failure_within_horizon FROM core", ["core"])
_OUT = [c for c in RANGED if c != S.TARGET]
add("preprocess", lambda s, p: q.preprocess(v.raw_text(s, p)).select("src_ord", "miner_id", "timestamp", "operating_mode", *RANGED),
    "SELECT src_ord, miner_id, \"timestamp\", operating_mode, " + ", ".join(RANGED) + " FROM preprocessed", ["preprocessed"], _OUT)

_rep = {
    ("input_rows", ""): "(SELECT count(*) FROM raw)", ("output_rows", ""): "(SELECT count(*) FROM preprocessed)",
    ("rows_dropped_invalid_core_fields", ""): f"(SELECT count(*) FROM raw WHERE NOT (miner_id IS NOT NULL AND {OK_TIME} IS NOT NULL))",
    ("null_timestamp_rows", ""): f"(SELECT count(*) FROM raw WHERE {OK_TIME} IS NULL)",
    ("operating_mode_replacements_to_normal", ""): f"(SELECT count(*) FROM raw WHERE miner_id IS NOT NULL AND {OK_TIME} IS NOT NULL AND (operating_mode IS NULL OR lower(trim(operating_mode)) NOT IN ('eco', 'normal', 'turbo')))",
    ("miners_count", ""): "(SELECT count(DISTINCT miner_id) FROM preprocessed)",
    ("label_positive_rate", ""): "(SELECT avg(failure_within_horizon) FROM preprocessed)",
    ("duplicates_removed", ""): f"(SELECT count(*) FROM raw WHERE miner_id IS NOT NULL AND {OK_TIME} IS NOT NULL) - (SELECT count(*) FROM core)",
    ("start_timestamp", ""): '(SELECT epoch_us(min("timestamp")) / 1e6 FROM preprocessed)',
    ("end_timestamp", ""): '(SELECT epoch_us(max("timestamp")) / 1e6 FROM preprocessed)',
    **{("missing_values_before_imputation", c): f"(SELECT count(*) - count({c}) FROM core)" for c in RANGED},
    **{("missing_values_after_preprocessing", c): f"(SELECT count(*) - count({c}) FROM preprocessed)" for c in RANGED},
    **{("clipped_values", c): f"(SELECT count(*) FROM imputed WHERE {c} < {d(S.PLAUSIBLE_RANGES[c][0])} OR {c} > {d(S.PLAUSIBLE_RANGES[c][1])})" for c in RANGED},
}
add("preprocess_report", lambda s, p: q.preprocess_report(v.raw_text(s, p), q.preprocess(v.raw_text(s, p))),
    " UNION ALL ".join(f"SELECT '{a}' AS metric, '{b}' AS item, CAST({e} AS DOUBLE) AS value" for (a, b), e in _rep.items()),
    ["preprocessed"], ["value"])


def _inputs(s, p):
    from rigsense.operators.features import ensure_inputs

    full = ensure_inputs(v.clean(s, p), 0.3).select(
        "id", "cooling_power_w", "efficiency_j_per_th", "true_efficiency_te", "hashrate_deviation_pct", "chip_temp_max", "expected_hashrate_ths")
    bare = ensure_inputs(v.clean(s, p).select("id", "timestamp", "miner_id", "asic_temperature_c"))
    return full.withColumn("kind", F.lit("full")).unionByName(bare.select(
        "id", "cooling_power_w", "efficiency_j_per_th", "true_efficiency_te", "hashrate_deviation_pct", "chip_temp_max",
        "expected_hashrate_ths").withColumn("kind", F.lit("bare")))


_COOL = "coalesce(cooling_power_w, asic_power_w * 0.3e0)"
add("ensure_feature_inputs", _inputs,
    f"""SELECT 'full' AS kind, id, {_COOL} AS cooling_power_w, asic_power_w / nullif(asic_hashrate_ths, 0) AS efficiency_j_per_th,
asic_hashrate_ths / nullif(asic_power_w + {_COOL}, 0) AS true_efficiency_te, 0e0 AS hashrate_deviation_pct, chip_temp_max, expected_hashrate_ths FROM clean
UNION ALL SELECT 'bare', id, 0e0, NULL, NULL, 0e0, asic_temperature_c, 0e0 FROM clean""", ["clean"],
    ["cooling_power_w", "efficiency_j_per_th", "true_efficiency_te", "hashrate_deviation_pct", "chip_temp_max", "expected_hashrate_ths"])

# --- settings
_kind = "CASE " + " ".join(f"WHEN \"key\" = '{k}' THEN '{x}'" for k, x in st.KINDS.items()) + " END"


def _bound(i: int) -> str:
    spans = {**S.INTEGER_SETTINGS, **S.FLOAT_SETTINGS}
    return "CASE " + " ".join(f"WHEN \"key\" = '{k}' THEN {d(b[i])}" for k, b in spans.items()) + " END"


_json = "CASE WHEN json_valid(t) THEN json_type(t) END"
add("validate_settings", lambda s, p: st.validate_settings(v.settings(s, p)).select(
        "site", "key", "value", F.col("error").isNull().alias("ok"), F.coalesce("error", F.lit("")).alias("error"),
        F.when(F.col("key").isin(S.JSON_OBJECT_SETTINGS + S.JSON_ARRAY_SETTINGS) & F.col("clean_value").isNotNull(), F.lit("(json)")).when(
            F.col("key").isin(list(S.FLOAT_SETTINGS)), F.round(F.col("clean_value").try_cast("double"), 6).cast("string")
        ).otherwise(F.col("clean_value")).alias("clean_value")),
    f"""SELECT site, "key", value, error = '' AS ok, error, CASE WHEN error <> '' THEN NULL
 WHEN kind IN ('object', 'array') THEN '(json)' WHEN t = '' THEN CASE WHEN kind = 'timezone' THEN 'UTC' WHEN kind = 'float' THEN NULL ELSE '' END
 WHEN kind = 'boolean' THEN lower(t) WHEN kind = 'integer' THEN CAST(CAST(trunc(x) AS BIGINT) AS VARCHAR)
 WHEN kind = 'float' THEN CAST(x AS VARCHAR) ELSE t END AS clean_value
FROM (SELECT *, CASE WHEN kind IS NULL THEN concat('Unsupported setting key ''', "key", '''')
 WHEN kind = 'boolean' AND t <> '' AND lower(t) NOT IN ('1','0','true','false','yes','no','on','off') THEN concat('Invalid boolean for ''', "key", '''')
 WHEN kind = 'integer' AND t <> '' AND x IS NULL THEN concat('Invalid integer for ''', "key", '''')
 WHEN kind = 'integer' AND t <> '' AND (trunc(x) < lo OR trunc(x) > hi) THEN concat('Value for ''', "key", ''' must be between ', CAST(lo AS BIGINT), ' and ', CAST(hi AS BIGINT))
 WHEN kind = 'float' AND t <> '' AND x IS NULL THEN concat('Invalid number for ''', "key", '''')
 WHEN kind = 'float' AND t <> '' AND (x < lo OR x > hi) THEN concat('Value for ''', "key", ''' must be between ', lo, ' and ', hi)
 WHEN kind = 'object' AND t <> '' AND j IS NULL THEN concat('Invalid JSON object for ''', "key", '''')
 WHEN kind = 'object' AND t <> '' AND j <> 'OBJECT' THEN concat('Setting ''', "key", ''' must be a JSON object')
 WHEN kind = 'array' AND t <> '' AND j IS NULL THEN concat('Invalid JSON array for ''', "key", '''')
 WHEN kind = 'array' AND t <> '' AND j <> 'ARRAY' THEN concat('Setting ''', "key", ''' must be a JSON array')
 WHEN kind = 'timezone' AND t NOT IN ('', 'UTC', 'Europe/Berlin') THEN concat('Invalid timezone for ''', "key", '''')
 ELSE '' END AS error FROM (SELECT *, trim(value) AS t, TRY_CAST(trim(value) AS DOUBLE) AS x, {_kind} AS kind, {_bound(0)} AS lo, {_bound(1)} AS hi,
 {_json.replace('(t)', '(trim(value))')} AS j FROM settings) AS typed) AS judged""", ["settings"])


def _pick(k: str) -> str:
    return f"max(CASE WHEN \"key\" = '{k}' AND value <> '' THEN value END)"


_n = lambda k: num(_pick(k))
_typed_text = [k for k in st.POLICY_SETTINGS]
add("typed_runtime_config", lambda s, p: st.typed_runtime_config(v.settings(s, p), ["site"]),
    f"""SELECT site,
CASE WHEN {_n('risk_threshold')} BETWEEN 0 AND 1 THEN {_n('risk_threshold')} ELSE 0.55e0 END AS risk_threshold,
CASE WHEN trunc({_n('alert_cooldown_hours')}) >= 0 THEN CAST(trunc({_n('alert_cooldown_hours')}) AS BIGINT) ELSE 1 END AS alert_cooldown_hours,
CASE WHEN trunc({_n('inference_lookback_hours')}) >= 1 THEN CAST(trunc({_n('inference_lookback_hours')}) AS BIGINT) ELSE 24 END AS inference_lookback_hours,
CASE WHEN {_n('cooling_power_ratio')} >= 0 THEN {_n('cooling_power_ratio')} ELSE 0.24e0 END AS cooling_power_ratio,
CASE WHEN trunc({_n('retrain_days')}) >= 1 THEN CAST(trunc({_n('retrain_days')}) AS BIGINT) ELSE 30 END AS retrain_days,
CASE WHEN lower(trim({_pick('control_mode')})) IN ('advisory', 'actuation') THEN lower(trim({_pick('control_mode')})) ELSE 'advisory' END AS control_mode,
""" + ",\n".join(f"coalesce({_pick(k)}, '{S.SETTING_DEFAULTS[k]}') AS {k}" for k in _typed_text) + """
FROM settings WHERE "key" IN (""" + ", ".join(f"'{k}'" for k in ["risk_threshold", "alert_cooldown_hours", "inference_lookback_hours", "cooling_power_ratio", "retrain_days", "control_mode", *_typed_text]) + ") GROUP BY site",
    ["settings"], ["risk_threshold", "cooling_power_ratio"])
add("mask_secrets", lambda s, p: st.mask_secrets(v.settings(s, p)),
    """SELECT site, "key", CASE WHEN "key" IN ('smtp_password', 'telegram_bot_token')
THEN CASE WHEN coalesce(value, '') = '' THEN '(not configured)' ELSE '********' END ELSE value END AS value FROM settings""", ["settings"])

# --- source URLs
ALLOW = ["*.example.com", "ththed.example.org", "10.0.0.7"]
HOST = "lower(nullif(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1), ''))"


def _urls(s, p):
    """Page URLs, with every seventh turned into one of the cases the audit must refuse."""
    page = v.table(s, p, "pages")
    url = (F.when(F.col("page_id") % 21 == 0, F.lit("ftp://ththed.example.org/x"))
           .when(F.col("page_id") % 21 == 7, F.concat(F.lit("http://10.0.0.7:8080/"), F.col("page_id").cast("string")))
           .when(F.col("page_id") % 21 == 14, F.lit("http://localhost/metrics")).otherwise(F.col("url")))
    audited = urls.source_url_audit(page.select("page_id", url.alias("url")), ALLOW)
    return audited.select("page_id", "scheme", "hostname", F.coalesce("port", F.lit(-1)).alias("port"), F.array_join("errors", "; ").alias("errors"), "valid")


add("source_url_audit", _urls, f"""SELECT page_id, scheme, hostname, port, errors, errors = '' AS valid FROM (
SELECT page_id, scheme, hostname, CAST(CASE WHEN scheme = 'ftp' THEN -1 WHEN hostname = '10.0.0.7' THEN 8080 WHEN scheme = 'https' THEN 443 ELSE 80 END AS BIGINT) AS port,
concat_ws('; ', CASE WHEN scheme NOT IN ('http', 'https') THEN 'Only http/https source URLs are allowed' END,
 CASE WHEN hostname = 'localhost' THEN 'Source hostname is blocked' END,
 CASE WHEN NOT (hostname IN ('ththed.example.org', '10.0.0.7', 'example.com') OR ends_with(hostname, '.example.com')) THEN 'Source hostname is not in the source allowlist' END,
 CASE WHEN hostname = '10.0.0.7' THEN 'Source hostname is a blocked address' END) AS errors
FROM (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, {HOST} AS hostname FROM (
SELECT page_id, CASE page_id % 21 WHEN 0 THEN 'ftp://ththed.example.org/x' WHEN 7 THEN concat('http://10.0.0.7:8080/', page_id)
 WHEN 14 THEN 'http://localhost/metrics' ELSE url END AS url FROM pages) AS u) AS h) AS a""")
