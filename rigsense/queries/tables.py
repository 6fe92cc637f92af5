"""Scans, sinks, payloads and keyed writes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.operators import features as f
from rigsense.operators import quality as q
from rigsense.operators import scoring as sc
from rigsense.operators import settings as st
from rigsense.operators import tables as t
from rigsense.operators.scale import work_dir
from rigsense.queries.cleaning import REPORT_SQL
from rigsense.queries.fleet import stored_twice
from rigsense.queries.registry import add, cte, num, txt
from rigsense.sources import files, payloads
from rigsense.sources import views as v

CSV_COLUMNS = [c for c in S.UPLOAD_TYPES if c not in ("double_hash_count", "read_errors", "chip_temp_max", "chip_temp_std", "expected_hashrate_ths")]


# --- scans and sinks
def _csv(s, p):
    """Write the raw text as CSV and read it back typed."""
    path = work_dir(s, "csv")
    v.raw_text(s, p).select(*CSV_COLUMNS, "src_ord").write.option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)
    raw = files.scan_csv(s, path, [*CSV_COLUMNS, "src_ord"])
    return files.typed(raw, S.UPLOAD_TYPES).select("src_ord", "timestamp", "asic_hashrate_ths", "asic_power_w")


_TIME = 'TRY_CAST("timestamp" AS TIMESTAMP)'
add("scan_csv", _csv, f"""SELECT CAST(src_ord AS VARCHAR) AS src_ord, {_TIME} AS "timestamp", {num('asic_hashrate_ths')} AS asic_hashrate_ths,
{num('asic_power_w')} AS asic_power_w FROM raw""", ["raw"], ["asic_hashrate_ths", "asic_power_w"])
_PAIR = ["id", "timestamp", "miner_id", "asic_power_w", "true_efficiency_te"]


def _pair(s, p):
    out = files.write_parquet_csv(v.kpi(s, p).select(*_PAIR), work_dir(s, "pair"))
    return s.read.parquet(out["parquet"])


def _both(s, p):
    out = files.write_parquet_csv(v.kpi(s, p).select(*_PAIR), work_dir(s, "sink"))
    csv = s.read.option("header", True).schema("id bigint, timestamp timestamp, miner_id string, asic_power_w double, true_efficiency_te double").csv(out["csv"])
    return s.read.parquet(out["parquet"]).withColumn("kind", F.lit("parquet")).unionByName(csv.withColumn("kind", F.lit("csv")))


_PAIR_SQL = 'SELECT id, "timestamp", miner_id, asic_power_w, true_efficiency_te{} FROM kpi'
add("scan_parquet_csv_pair", _pair, _PAIR_SQL.format(""), ["kpi"], ["asic_power_w", "true_efficiency_te"])
add("sink_parquet_csv", _both, _PAIR_SQL.format(", 'parquet' AS kind") + " UNION ALL " + _PAIR_SQL.format(", 'csv'"), ["kpi"], ["asic_power_w", "true_efficiency_te"])
add("sink_json_report", lambda s, p: s.read.schema("section string, item string, value bigint").json(
        files.write_json_report(q.quality_report(v.raw_text(s, p)), work_dir(s, "report"))).groupBy("section").agg(F.count(F.lit(1)).alias("items"), F.sum("value").alias("total")),
    f"SELECT section, count(*) AS items, CAST(sum(value) AS BIGINT) AS total FROM ({REPORT_SQL}) AS report GROUP BY 1", ["raw"])


def _risk_csv(s, p):
    outputs = sc.risk_outputs(f.temporal_features(v.risk(s, p)), 0.45).select(*sc.ALERT_COLUMNS)
    out = files.write_risk_outputs(outputs, sc.alert_examples(outputs), work_dir(s, "risk"))
    return s.read.option("header", True).csv(out["risk_predictions_csv"]).groupBy("risk_band").agg(F.count(F.lit(1)).alias("n")).unionByName(
        s.read.option("header", True).csv(out["alerts_csv"]).agg(F.count(F.lit(1)).alias("n")).withColumn("risk_band", F.lit("(alerts)")))


add("sink_risk_alert_csv", _risk_csv, """SELECT risk_band, count(*) AS n FROM outputs GROUP BY 1 UNION ALL
SELECT '(alerts)', least(count(*), 250) FROM outputs WHERE predicted_failure_risk = 1 OR alert_signal_count >= 2""", ["outputs"])


def _by_date(s, p):
    """A date-partitioned table, read back for a few days only."""
    path = work_dir(s, "by-date")
    t.write_by_date(v.telemetry(s, p).select("id", "timestamp", "miner_id", "asic_power_w"), path)
    days = t.read_by_date(s, path).filter("event_date between date'2024-01-05' and date'2024-01-07'")
    return days.select("id", "timestamp", "miner_id", "event_date")


add("partition_by_time", _by_date, """SELECT id, "timestamp", miner_id, CAST("timestamp" AS DATE) AS event_date FROM telemetry
WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'""", ["telemetry"])


def _guard(s, p):
    raw = v.raw_text(s, p)
    rows = t.upload_guard(raw, max_rows=5000).withColumn("rule", F.lit("rows"))
    size = files.files_size(v.table(s, p, "events")).first()["n_bytes"]
    small = t.upload_guard(raw, max_bytes=1024, total_bytes=size).withColumn("rule", F.lit("bytes"))
    fine = t.upload_guard(raw, max_rows=10**9).withColumn("rule", F.lit("none"))
    return rows.unionByName(small).unionByName(fine).select("rule", "n_rows", "verdict")


add("guard_upload_size", _guard, """SELECT 'rows' AS rule, count(*) AS n_rows, CASE WHEN count(*) > 5000 THEN 'too_many_rows' ELSE 'accepted' END AS verdict FROM raw
UNION ALL SELECT 'bytes', count(*), 'too_many_bytes' FROM raw UNION ALL SELECT 'none', count(*), 'accepted' FROM raw""", ["raw"])

# --- uploads
cte("uploaded", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY miner_id, "timestamp" ORDER BY src_ord) AS rn FROM (SELECT src_ord, trim(miner_id) AS miner_id,
{_TIME} AS "timestamp", {num('asic_hashrate_ths')} AS asic_hashrate_ths, {num('asic_power_w')} AS asic_power_w, {txt('event_codes')} AS event_codes,
{txt('operating_mode')} AS operating_mode FROM raw) AS a WHERE miner_id <> '' AND "timestamp" IS NOT NULL) AS b WHERE rn = 1""", ["raw"])


def _stored(s, p):
    """What the table holds before the upload: two thirds of the rows."""
    return v.telemetry(s, p).filter("id % 3 <> 0").select("miner_id", "timestamp")


cte("stored", 'SELECT miner_id, "timestamp" FROM telemetry WHERE id % 3 <> 0', ["telemetry"])
_new = "SELECT count(*) FROM uploaded AS u WHERE NOT EXISTS (SELECT 1 FROM stored AS s WHERE s.miner_id = u.miner_id AND s.\"timestamp\" = u.\"timestamp\")"
add("ingest_csv", lambda s, p: t.ingest_result(v.raw_text(s, p), _stored(s, p), ["src_ord"]).withColumn("errors", F.array_join("errors", "; ")),
    f"""SELECT (SELECT count(*) FROM raw) AS rows_received, ({_new}) AS rows_inserted, (SELECT count(DISTINCT miner_id) FROM uploaded) AS miners_found,
concat('Dropped ', (SELECT count(*) FROM raw WHERE {_TIME} IS NULL), ' rows with unparseable timestamps; Dropped ',
(SELECT count(*) FROM raw WHERE {_TIME} IS NOT NULL AND (miner_id IS NULL OR trim(miner_id) = '')), ' rows with missing miner_id') AS errors""", ["uploaded", "stored"])
add("ingest_csv_devices", lambda s, p: t.ingest_devices(v.raw_text(s, p), _stored(s, p), ["src_ord"]),
    """SELECT u.miner_id, count(*) AS rows_clean, count(CASE WHEN s.miner_id IS NULL THEN 1 END) AS rows_inserted FROM uploaded AS u
LEFT JOIN stored AS s ON s.miner_id = u.miner_id AND s."timestamp" = u."timestamp" GROUP BY 1""", ["uploaded", "stored"])
add("ingest_csv_rows", lambda s, p: q.clean_upload(v.raw_text(s, p), ["src_ord"]).select(
        "src_ord", "miner_id", "timestamp", "asic_hashrate_ths", "asic_power_w", "event_codes", "operating_mode"),
    'SELECT src_ord, miner_id, "timestamp", asic_hashrate_ths, asic_power_w, event_codes, operating_mode FROM uploaded', ["uploaded"], ["asic_hashrate_ths", "asic_power_w"])


# --- JSON
def _bodies(s, p):
    """Polled bodies: three sources with different field names; some bodies are single objects."""
    tele = v.raw_text(s, p).withColumn("source_name", F.concat(F.lit("src-"), (F.col("src_ord") % 3).cast("string")))
    plain = ["miner_id", "timestamp", "asic_power_w", "operating_mode", "event_codes", "bad_hash_count"]
    renamed = {"miner_id": "worker", "timestamp": "at", "asic_power_w": "watts"}
    is_renamed = F.col("source_name") == "src-1"
    a = F.to_json(F.struct(*plain))
    b = F.to_json(F.struct(*[F.col(c).alias(renamed.get(c, c)) for c in plain]))
    one = F.when(is_renamed, b).otherwise(a)
    return tele.select("source_name", "src_ord", F.when(F.col("src_ord") % 5 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one).alias("body"))


def _mappings(s, p):
    """The field mappings of the sources that appear in the table."""
    names = v.table(s, p, "events").select(F.concat(F.lit("src-"), (F.col("event_id") % 3).cast("string")).alias("source_name")).distinct()
    mapping = F.when(F.col("source_name") == "src-1", F.create_map(*[F.lit(x) for x in ("miner_id", "worker", "timestamp", "at", "asic_power_w", "watts")]))
    return names.select("source_name", mapping.alias("field_mapping"))


add("ingest_json_mapped", lambda s, p: payloads.polled_records(_bodies(s, p), _mappings(s, p)).select(
        "src_ord", "miner_id", "timestamp", "asic_power_w", "operating_mode", "event_codes", "source", F.coalesce("bad_hash_count", F.lit(-1)).alias("bad_hash_count")),
    f"""SELECT src_ord, {txt('miner_id', True)} AS miner_id, {_TIME} AS "timestamp", {num('asic_power_w')} AS asic_power_w,
coalesce({txt('operating_mode', True)}, 'normal') AS operating_mode, {txt('event_codes', True)} AS event_codes, concat('api:src-', src_ord % 3) AS source,
CAST(coalesce(trunc({num('bad_hash_count')}), -1) AS BIGINT) AS bad_hash_count FROM raw WHERE {txt('miner_id', True)} IS NOT NULL AND {_TIME} IS NOT NULL""",
    ["raw"], ["asic_power_w"])


def _payloads(s, p, rows, types):
    """Rows packed into JSON arrays of at most 50 records per device, and unpacked again."""
    packed = payloads.payload_per_device(rows.withColumn("batch", F.floor(F.col("id") / 50)), types)
    return payloads.payload_to_rows(packed, "payload", types)


for _name, _fn, _cte, _types in [
    ("telemetry", lambda s, p: v.telemetry(s, p), "telemetry", S.UPLOAD_TYPES), ("kpi", lambda s, p: v.kpi(s, p), "kpi", S.KPI_TYPES),
    ("risk", lambda s, p: v.predictions(s, p), "predictions", S.RISK_TYPES),
]:
    add("json_payload_to_rows" + ("" if _name == "telemetry" else f"_{_name}"), lambda s, p, fn=_fn, ty=_types: _payloads(s, p, fn(s, p), ty),
        "SELECT " + ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' if ty == "int" else f'"{c}"' for c, ty in _types.items()) + f" FROM {_cte}",
        [_cte], [c for c, ty in _types.items() if ty == "double"])
add("rows_to_json_payload", lambda s, p: payloads.rows_to_payload(
        v.raw_text(s, p).select("miner_id", "timestamp", F.col("asic_power_w").try_cast("double").alias("asic_power_w"), "event_codes")
        .withColumn("timestamp", q.parse_time(F.col("timestamp"))), {"timestamp": "timestamp", "miner_id": "string", "asic_power_w": "double", "read_errors": "int"}).select(
        F.get_json_object("payload", "$.miner_id").alias("miner_id"), F.get_json_object("payload", "$.timestamp").alias("at"),
        F.get_json_object("payload", "$.asic_power_w").try_cast("double").alias("power"), F.col("payload").contains('"read_errors":null').alias("explicit_null"),
        F.lower("payload").contains("nan").alias("has_nan")),
    f"""SELECT miner_id, CASE WHEN {_TIME} IS NOT NULL THEN concat(strftime({_TIME}, '%Y-%m-%dT%H:%M:%S.%f'), 'Z') END AS at, {num('asic_power_w')} AS power,
true AS explicit_null, false AS has_nan FROM raw""", ["raw"], ["power"])

# --- keyed writes
_T4 = ["id", "miner_id", "timestamp", "asic_power_w"]


def _target(s, p):
    return v.telemetry(s, p).filter("id % 3 <> 0").select(*_T4)


def _batch(s, p):
    """All keys again with other values, some of them twice."""
    b = v.telemetry(s, p).select(*_T4).withColumns({"asic_power_w": F.lit(7.0), "seq": F.lit(0)})
    return b.unionByName(b.filter("id % 11 = 0").withColumns({"asic_power_w": F.lit(8.0), "seq": F.lit(1)}))


add("insert_if_absent", lambda s, p: t.insert_if_absent(_target(s, p), _batch(s, p), order=["seq"]).select(*_T4),
    'SELECT id, miner_id, "timestamp", CASE WHEN id % 3 <> 0 THEN asic_power_w ELSE 7e0 END AS asic_power_w FROM telemetry', ["telemetry"], ["asic_power_w"])


def _pred_target(s, p):
    return t.keep_latest_predictions(v.predictions(s, p)).select("id", "miner_id", "model_version", "predicted_at", "risk_score")


def _pred_batch(s, p):
    """Newer predictions for two versions; each key more than once, the last row must win."""
    e = v.predictions(s, p)
    return e.filter("id % 2 = 0").select(
        "miner_id", F.when(F.col("id") % 4 == 0, F.lit("v3")).otherwise(F.lit("v1")).alias("model_version"),
        (F.col("predicted_at") + F.expr("INTERVAL 60 DAYS")).alias("predicted_at"), (F.col("risk_score") / 2).alias("risk_score"), F.col("id").alias("seq"))


cte("pred_target", """SELECT id, miner_id, model_version, predicted_at, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY miner_id, model_version
ORDER BY predicted_at DESC, id DESC) AS rn FROM (SELECT * REPLACE (coalesce(model_version, 'v1') AS model_version) FROM predictions) AS a) AS b WHERE rn = 1""", ["predictions"])
cte("pred_batch", """SELECT miner_id, model_version, predicted_at, risk_score FROM (SELECT *, row_number() OVER (PARTITION BY miner_id, model_version ORDER BY seq DESC) AS rn FROM (
SELECT miner_id, CASE WHEN id % 4 = 0 THEN 'v3' ELSE 'v1' END AS model_version, predicted_at + INTERVAL 60 DAY AS predicted_at, risk_score / 2 AS risk_score, id AS seq
FROM predictions WHERE id % 2 = 0) AS a) AS b WHERE rn = 1""", ["predictions"])
add("upsert_predictions", lambda s, p: t.upsert_columns(_pred_target(s, p), _pred_batch(s, p), ["miner_id", "model_version"], ["predicted_at", "risk_score"], ["seq"]).withColumn(
        "id", F.coalesce("id", F.lit(-1).cast("long"))),
    """SELECT coalesce(t.id, -1) AS id, coalesce(t.miner_id, b.miner_id) AS miner_id, coalesce(t.model_version, b.model_version) AS model_version,
coalesce(b.predicted_at, t.predicted_at) AS predicted_at, coalesce(b.risk_score, t.risk_score) AS risk_score
FROM pred_target AS t FULL OUTER JOIN pred_batch AS b ON b.miner_id = t.miner_id AND b.model_version = t.model_version""", ["pred_target", "pred_batch"], ["risk_score"])
add("replace_by_keys", lambda s, p: t.replace_by_keys(
        _pred_target(s, p).drop("id"), _pred_batch(s, p).filter("model_version = 'v1'").drop("seq"), "miner_id", {"model_version": "v1"}),
    """SELECT miner_id, model_version, predicted_at, risk_score FROM pred_target WHERE NOT (model_version = 'v1' AND miner_id IN (SELECT miner_id FROM predictions WHERE id % 4 = 2))
UNION ALL SELECT miner_id, 'v1', predicted_at + INTERVAL 60 DAY, risk_score / 2 FROM predictions WHERE id % 4 = 2""", ["pred_target"], ["risk_score"])


def _settings_halves(s, p):
    changes = v.setting_changes(s, p)
    newest = ["site", "key"]
    old = t.upsert(changes.limit(0).select("site", "key", "value", "updated_at"), changes.filter("id % 2 = 0"), newest, ["id"])
    return t.upsert(old, changes.filter("id % 2 = 1"), newest, ["id"])


add("upsert_settings", _settings_halves, """SELECT site, "key", value, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY site, "key"
ORDER BY id % 2 DESC, id DESC) AS rn FROM setting_changes) AS r WHERE rn = 1""", ["setting_changes"])
_legacy = " ".join(f"WHEN \"key\" = '{key}' THEN coalesce(value, '') IN ({', '.join(repr(x) for x in vals)})" for key, vals in S.LEGACY_SETTING_VALUES.items())
cte("defaults", "SELECT * FROM (VALUES " + ", ".join(f"('{key}', '{val}')" for key, val in S.SETTING_DEFAULTS.items()) + ") AS t(k, dv)")
add("seed_defaults", lambda s, p: st.seed_defaults(v.settings(s, p), ["site"]),
    f"""SELECT site, "key", CASE WHEN (CASE {_legacy} WHEN "key" = 'control_mode' THEN coalesce(value, '') NOT IN ('advisory', 'actuation') ELSE false END) THEN dv ELSE value END AS value
FROM settings LEFT JOIN defaults ON k = "key" UNION ALL SELECT g.site, k, dv FROM (SELECT DISTINCT site FROM settings) AS g, defaults
WHERE NOT EXISTS (SELECT 1 FROM settings AS x WHERE x.site = g.site AND x."key" = k)""", ["settings", "defaults"])
add("retention", lambda s, p: t.retention(v.telemetry(s, p), v.AS_OF + timedelta(days=165)).select("id", "timestamp"),
    "SELECT id, \"timestamp\" FROM telemetry WHERE \"timestamp\" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 15 DAY", ["telemetry"])


def _newest_ids(s, p):
    return t.keep_newest_id(stored_twice(s, p))


add("dedup_keep_newest_id", _newest_ids, """SELECT id, miner_id, "timestamp", asic_power_w FROM (SELECT *, row_number() OVER (PARTITION BY miner_id, "timestamp" ORDER BY id DESC) AS rn
FROM doubled) AS r WHERE rn = 1""", ["doubled"], ["asic_power_w"])
add("dedup_predictions_latest", lambda s, p: _pred_target(s, p), "SELECT * FROM pred_target", ["pred_target"], ["risk_score"])
