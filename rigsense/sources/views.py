"""Telemetry-shaped views over the ``events`` table, used by the registered queries and tests.

All of them are row-local selects (plus one union for duplicates), so filters and column
lists chosen later reach the Parquet scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.operators.analytics import hourly_rollup
from rigsense.operators.kpi import efficiency, te_worker
from rigsense.operators.quality import mode_normalize
from rigsense.operators.scale import latest_per_key
from rigsense.operators.scoring import risk_band, score_rows

AS_OF = datetime(2024, 1, 31)  # just after the last event

# ``props`` is always {"k": n}. Filters on columns computed from k are pushed below it, which
# repeats the extraction, so it has to be cheaper than parsing JSON.
K = """TRY_CAST(translate(props, '{"k: }', '') AS INT)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry_from(events: DataFrame) -> DataFrame:
    """Telemetry columns computed from an events frame, batch or streaming."""
    e = events.selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "value",
        f"{K} AS k",
    )
    temp = "CAST(55 AS DOUBLE) + CAST(2*k AS DOUBLE) / 5 + least(value, CAST(100 AS DOUBLE)) / 5"
    return e.selectExpr(
        "event_id AS id", "ts AS `timestamp`", "concat('m-', CAST(user_id AS STRING)) AS miner_id",
        "'csv' AS source",
        """CASE WHEN event_id % 211 = 0 THEN 'boost' WHEN event_type = 'click' THEN ' Eco '
                WHEN event_type IN ('view', 'purchase') THEN 'normal' ELSE 'turbo' END AS operating_mode""",
        "CAST(20 + event_id % 21 AS DOUBLE) AS ambient_temperature_c",
        "CASE WHEN event_id % 97 <> 0 THEN CAST(600 + 3*k AS DOUBLE) END AS cooling_power_w",
        "CAST(480 + 2*k AS DOUBLE) AS asic_clock_mhz",
        "CAST(590 + k AS DOUBLE) / 50 AS asic_voltage_v",
        """CASE WHEN event_id % 101 <> 0
                THEN CAST(110 AS DOUBLE) - least(value, CAST(400 AS DOUBLE)) / 5 END AS asic_hashrate_ths""",
        f"{temp} AS asic_temperature_c",
        "CAST(2800 + 5*k AS DOUBLE) + value / 2 AS asic_power_w",
        "CAST(k AS DOUBLE) / 100 AS power_instability_index",
        "CASE WHEN event_type = 'error' AND k >= 90 THEN 1 ELSE 0 END AS failure_event",
        "CASE WHEN event_type = 'error' THEN '[\"OVERTEMP\"]' END AS event_codes",
        f"CASE WHEN event_id % 5 <> 0 THEN {temp} + event_id % 7 END AS chip_temp_max",
        "CAST(event_id % 9 AS DOUBLE) / 4 AS chip_temp_std",
        "CAST(event_id % 4 AS INT) AS bad_hash_count",
        "CAST(event_id % 3 AS INT) AS double_hash_count",
        "CAST(event_id % 2 AS INT) AS read_errors",
        "CASE WHEN event_id % 3 <> 0 THEN CAST(108 AS DOUBLE) END AS expected_hashrate_ths",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from(table(spark, sf_dir, "events"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with valid modes."""
    return mode_normalize(telemetry(spark, sf_dir))


def as_kpi(clean_rows: DataFrame) -> DataFrame:
    """KPI rows as a stored KPI table would have them; row-local."""
    base = F.lit(98.0)
    return clean_rows.withColumns({
        "efficiency_j_per_th": efficiency(),
        "hashrate_deviation_pct": F.round((F.col("asic_hashrate_ths") - base) / base * F.lit(100.0), 2),
        "true_efficiency_te": te_worker(),
        S.TARGET: F.col("failure_event"),
    }).drop("source", "failure_event")


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_kpi(clean(spark, sf_dir))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_rollup(kpi(spark, sf_dir))


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI rows with the heuristic score of each row."""
    return score_rows(kpi(spark, sf_dir))


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry as text with unreadable values, blank ids and repeated keys."""
    t = telemetry(spark, sf_dir)
    rows = t.selectExpr(
        """CASE WHEN id % 83 = 0 THEN 'not-a-time' WHEN id % 89 = 0 THEN NULL
                ELSE date_format(`timestamp`, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") END AS `timestamp`""",
        """CASE WHEN id % 71 = 0 THEN '   ' WHEN id % 73 = 0 THEN NULL
                WHEN id % 4 = 0 THEN concat(' ', miner_id, ' ') ELSE miner_id END AS miner_id""",
        "CASE WHEN id % 37 = 0 THEN NULL WHEN id % 41 = 0 THEN 'nan' ELSE operating_mode END AS operating_mode",
        "CAST(ambient_temperature_c AS STRING) AS ambient_temperature_c",
        "CAST(cooling_power_w AS STRING) AS cooling_power_w",
        "CAST(asic_clock_mhz AS STRING) AS asic_clock_mhz",
        "CASE WHEN id % 43 = 0 THEN '1.25' ELSE CAST(asic_voltage_v AS STRING) END AS asic_voltage_v",
        """CASE WHEN id % 61 = 0 THEN 'oops' WHEN id % 67 = 0 THEN 'NaN' WHEN id % 59 = 0 THEN ''
                ELSE CAST(asic_hashrate_ths AS STRING) END AS asic_hashrate_ths""",
        """CASE WHEN id % 53 = 0 THEN ' 91.5 ' ELSE CAST(asic_temperature_c AS STRING) END
                AS asic_temperature_c""",
        """CASE WHEN id % 79 = 0 THEN '-5' WHEN id % 47 = 0 THEN 'Infinity'
                ELSE CAST(asic_power_w AS STRING) END AS asic_power_w""",
        "CAST(asic_power_w / 90 AS STRING) AS efficiency_j_per_th",
        "CAST(power_instability_index AS STRING) AS power_instability_index",
        "CAST(asic_clock_mhz - 600 AS STRING) AS hashrate_deviation_pct",
        """CASE WHEN id % 31 = 0 THEN NULL WHEN id % 29 = 0 THEN '3'
                ELSE CAST(failure_event AS STRING) END AS failure_within_horizon""",
        """CASE WHEN id % 10 = 3 THEN '5.9' WHEN id % 10 = 4 THEN 'oops'
                ELSE CAST(bad_hash_count AS STRING) END AS bad_hash_count""",
        """CASE WHEN id % 6 = 0 THEN ' ' WHEN id % 6 = 1 THEN 'None'
                ELSE ' ["OVERTEMP"] ' END AS event_codes""",
        "CAST(id AS STRING) AS batch_note",
        "id * 2 AS src_ord", "id",
    )
    again = rows.filter("id % 97 = 0").withColumns({
        "asic_power_w": F.lit("3333.25"), "src_ord": F.col("src_ord") + 1})
    return rows.unionByName(again).drop("id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", f"{K} AS k")
    score = F.col("k").cast("double") / F.lit(100.0)
    return e.filter("event_id % 3 = 0").select(
        F.col("event_id").alias("id"), F.col("ts").alias("predicted_at"),
        F.concat(F.lit("m-"), F.col("user_id").cast("string")).alias("miner_id"),
        score.alias("risk_score"), risk_band(score, S.BANDS_WORKER).alias("risk_band"),
        (score >= F.lit(0.55)).alias("predicted_failure"),
        F.expr("CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'v2' ELSE 'v1' END").alias("model_version"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type",
        f"{K} AS k").filter("event_type IN ('error', 'signup')")
    return e.selectExpr(
        "event_id AS id", "ts AS created_at", "concat('m-', CAST(user_id AS STRING)) AS miner_id",
        "CASE WHEN k >= 75 THEN 'critical' ELSE 'warning' END AS severity",
        "CAST(k AS DOUBLE) / 100 AS risk_score",
        "concat('Risk score ', CAST(k AS STRING), '% exceeds threshold') AS trigger_reason",
        "concat('<', event_type, '> & \"', CAST(user_id AS STRING), '\" isn\\'t well') AS message",
        """CASE k % 5 WHEN 0 THEN 'CONTINUE' WHEN 1 THEN 'WATCHLIST' WHEN 2 THEN 'DOWNCLOCK'
                WHEN 3 THEN 'REBOOT' ELSE 'PULL_FOR_MAINTENANCE' END AS recommended_action""",
        "k % 2 = 0 AS automation_triggered", "k % 3 = 0 AS resolved",
        "CASE WHEN k % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS resolved_at",
        "k % 4 = 0 AS email_sent", "k % 5 = 0 AS telegram_sent",
    )


SETTING_KEYS = sorted(S.SETTING_DEFAULTS) + ["not_a_setting"]
SETTING_VALUES = [
    "0.5", "24", " 30 ", "true", "NO", "oops", '{"18":0.25,"x":1,"3":-2}',
    '[{"start_hour":17,"end_hour":3},{"start_hour":5,"end_hour":5}]', "UTC", "", "Europe/Berlin",
    "1e3", "-1", "1.5", "actuation", "120", '[{"hour":4,"price":0.3},{"hour":99,"price":1}]', "Mars/Base",
]


def setting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of settings changes per site: (id, site, key, value, updated_at)."""
    e = table(spark, sf_dir, "events")
    keys = F.array(*[F.lit(k) for k in SETTING_KEYS])
    values = F.array(*[F.lit(v) for v in SETTING_VALUES])
    at = F.col("event_id")
    return e.select(
        at.alias("id"), F.col("user_id").alias("site"),
        F.get(keys, (at % len(SETTING_KEYS)).cast("int")).alias("key"),
        F.get(values, (F.floor(at / 7) % len(SETTING_VALUES)).cast("int")).alias("value"),
        F.col("ts").cast("timestamp").alias("updated_at"),
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current settings of each site."""
    newest = latest_per_key(setting_changes(spark, sf_dir), ["site", "key"], [F.col("id").desc()])
    return newest.select("site", "key", "value")
