"""The query registry, and the views as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.functions.exprs import r6
from rigsense.sources.views import SETTING_KEYS, SETTING_VALUES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def out(df: DataFrame) -> DataFrame:
    """Comparable values: doubles to six digits, integers to bigint."""
    kinds = dict(df.dtypes)
    change = {c: r6(F.col(f"`{c}`")) for c, t in kinds.items() if t == "double"}
    change |= {c: F.col(f"`{c}`").cast("bigint") for c, t in kinds.items() if t in ("int", "smallint", "tinyint")}
    return df.withColumns(change) if change else df


def add(
    name: str, fn: Callable[[SparkSession, str], DataFrame], body: str | None = None,
    ctes: Sequence[str] = (), doubles: Sequence[str] = (),
) -> None:
    """Register a query and, when it can be written in SQL, the statement it must agree with."""
    assert name not in QUERIES, name

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return out(fn(spark, sf_dir))

    QUERIES[name] = run
    if body is not None:
        ORACLE[name] = with_ctes(rounded(body, doubles), ctes)


def rounded(body: str, doubles: Sequence[str]) -> str:
    if not doubles:
        return body
    marks = ", ".join(f'round(CAST("{c}" AS DOUBLE) + 1e-9, 6) AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({marks}) FROM (\n{body}\n) AS result"


def d(x: float) -> str:
    """A double literal; a bare 0.5 would be a decimal."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def num(c: str) -> str:
    x = f"TRY_CAST(trim({c}) AS DOUBLE)"
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def txt(c: str, words: bool = False) -> str:
    bad = f"trim({c}) = ''" + (f" OR lower(trim({c})) IN ('nan', 'none', 'null')" if words else "")
    return f"CASE WHEN NOT ({bad}) THEN trim({c}) END"


def at_least(x: str, lo: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, {d(lo)}) END"


def between(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(least({x}, {d(hi)}), {d(lo)}) END"


def band(x: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {d(t)} THEN '{n}'" for t, n in bands) + " ELSE 'low' END"


def mode_factor(m: str) -> str:
    return f"CASE {m} WHEN 'eco' THEN 0.97e0 WHEN 'turbo' THEN 1.08e0 ELSE 1e0 END"


def corr(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    va, vb = (f"var_pop(CASE WHEN {both} THEN CAST({x} AS DOUBLE) END)" for x in (a, b))
    return f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / nullif(sqrt({va} * {vb}), 0)"


def te_sql(cooling: str) -> str:
    v = at_least("(coalesce(asic_voltage_v, 12.5e0) - 12.5e0) / 12.5e0", 0)
    t = at_least("(coalesce(ambient_temperature_c, 25e0) - 25e0) / 10e0", 0)
    return (
        f"round_even(coalesce(asic_hashrate_ths, 1e0) / nullif(coalesce(asic_power_w, 1500e0) + {cooling}, 0)"
        f" / ((1e0 + 0.6e0 * ({v})) * (1e0 + 0.4e0 * ({t})) * ({mode_factor('operating_mode')})), 6)"
    )


_TEMP = "55e0 + CAST(2*k AS DOUBLE) / 5 + least(value, 100e0) / 5"
_HEUR = (
    f"greatest(least(0.5e0 * greatest(least((coalesce(asic_temperature_c, 70e0) - 60e0) / 40e0, 1e0), 0e0)"
    f" + 0.4e0 * (CASE WHEN coalesce(asic_hashrate_ths, 100e0) < 50 THEN 1e0"
    f" WHEN coalesce(asic_hashrate_ths, 100e0) < 80 THEN 0.5e0 ELSE 0e0 END)"
    f" + 0.1e0 * greatest(least(coalesce(power_instability_index, 0e0), 1e0), 0e0), 1e0), 0e0)"
)


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ev": ("SELECT event_id, ts, user_id, event_type, value, "
           "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", ()),
    "telemetry": (f"""SELECT event_id AS id, ts AS "timestamp", concat('m-', CAST(user_id AS VARCHAR)) AS miner_id,
  'csv' AS source,
  CASE WHEN event_id % 211 = 0 THEN 'boost' WHEN event_type = 'click' THEN ' Eco '
       WHEN event_type IN ('view', 'purchase') THEN 'normal' ELSE 'turbo' END AS operating_mode,
  CAST(20 + event_id % 21 AS DOUBLE) AS ambient_temperature_c,
  CASE WHEN event_id % 97 <> 0 THEN CAST(600 + 3*k AS DOUBLE) END AS cooling_power_w,
  CAST(480 + 2*k AS DOUBLE) AS asic_clock_mhz, CAST(590 + k AS DOUBLE) / 50 AS asic_voltage_v,
  CASE WHEN event_id % 101 <> 0 THEN 110e0 - least(value, 400e0) / 5 END AS asic_hashrate_ths,
  {_TEMP} AS asic_temperature_c, CAST(2800 + 5*k AS DOUBLE) + value / 2 AS asic_power_w,
  CAST(k AS DOUBLE) / 100 AS power_instability_index,
  CASE WHEN event_type = 'error' AND k >= 90 THEN 1 ELSE 0 END AS failure_event,
  CASE WHEN event_type = 'error' THEN '["OVERTEMP"]' END AS event_codes,
  CASE WHEN event_id % 5 <> 0 THEN {_TEMP} + event_id % 7 END AS chip_temp_max,
  CAST(event_id % 9 AS DOUBLE) / 4 AS chip_temp_std, event_id % 4 AS bad_hash_count,
  event_id % 3 AS double_hash_count, event_id % 2 AS read_errors,
  CASE WHEN event_id % 3 <> 0 THEN 108e0 END AS expected_hashrate_ths FROM ev""", ("ev",)),
    "clean": ("""SELECT * REPLACE (CASE WHEN lower(trim(operating_mode)) IN ('eco', 'normal', 'turbo')
  THEN lower(trim(operating_mode)) ELSE 'normal' END AS operating_mode) FROM telemetry""", ("telemetry",)),
    "kpi": (f"""SELECT * EXCLUDE (source, failure_event),
  round_even(asic_power_w / nullif(asic_hashrate_ths, 0), 4) AS efficiency_j_per_th,
  round((asic_hashrate_ths - 98e0) / 98e0 * 100e0, 2) AS hashrate_deviation_pct,
  {te_sql('coalesce(asic_power_w, 0e0) * 0.24e0')} AS true_efficiency_te,
  failure_event AS failure_within_horizon FROM clean""", ("clean",)),
    "rollup": ("""SELECT date_trunc('hour', "timestamp") AS bucket, miner_id,
  """ + ",\n  ".join(f"avg({s}) AS {n}" for n, s in S.ROLLUP_SOURCES.items()) + """,
  min(operating_mode) AS operating_mode_sample, count(*) AS samples FROM kpi GROUP BY 1, 2""", ("kpi",)),
    "risk": (f"""SELECT *, round_even({_HEUR}, 4) AS risk_score, {band(_HEUR, S.BANDS_WORKER)} AS risk_band,
  {_HEUR} >= 0.55e0 AS predicted_failure FROM kpi""", ("kpi",)),
    "raw_once": (f"""SELECT
  CASE WHEN id % 83 = 0 THEN 'not-a-time' WHEN id % 89 = 0 THEN NULL ELSE CAST("timestamp" AS VARCHAR) END AS "timestamp",
  CASE WHEN id % 71 = 0 THEN '   ' WHEN id % 73 = 0 THEN NULL WHEN id % 4 = 0 THEN concat(' ', miner_id, ' ')
       ELSE miner_id END AS miner_id,
  CASE WHEN id % 37 = 0 THEN NULL WHEN id % 41 = 0 THEN 'nan' ELSE operating_mode END AS operating_mode,
  CAST(ambient_temperature_c AS VARCHAR) AS ambient_temperature_c, CAST(cooling_power_w AS VARCHAR) AS cooling_power_w,
  CAST(asic_clock_mhz AS VARCHAR) AS asic_clock_mhz,
  CASE WHEN id % 43 = 0 THEN '1.25' ELSE CAST(asic_voltage_v AS VARCHAR) END AS asic_voltage_v,
  CASE WHEN id % 61 = 0 THEN 'oops' WHEN id % 67 = 0 THEN 'NaN' WHEN id % 59 = 0 THEN ''
       ELSE CAST(asic_hashrate_ths AS VARCHAR) END AS asic_hashrate_ths,
  CASE WHEN id % 53 = 0 THEN ' 91.5 ' ELSE CAST(asic_temperature_c AS VARCHAR) END AS asic_temperature_c,
  CASE WHEN id % 79 = 0 THEN '-5' WHEN id % 47 = 0 THEN 'Infinity' ELSE CAST(asic_power_w AS VARCHAR) END AS asic_power_w,
  CAST(asic_power_w / 90 AS VARCHAR) AS efficiency_j_per_th,
  CAST(power_instability_index AS VARCHAR) AS power_instability_index,
  CAST(asic_clock_mhz - 600 AS VARCHAR) AS hashrate_deviation_pct,
  CASE WHEN id % 31 = 0 THEN NULL WHEN id % 29 = 0 THEN '3' ELSE CAST(failure_event AS VARCHAR) END AS failure_within_horizon,
  CASE WHEN id % 10 = 3 THEN '5.9' WHEN id % 10 = 4 THEN 'oops' ELSE CAST(bad_hash_count AS VARCHAR) END AS bad_hash_count,
  CASE WHEN id % 6 = 0 THEN ' ' WHEN id % 6 = 1 THEN 'None' ELSE ' ["OVERTEMP"] ' END AS event_codes,
  CAST(id AS VARCHAR) AS batch_note, id * 2 AS src_ord, id FROM telemetry""", ("telemetry",)),
    "raw": ("""SELECT * EXCLUDE (id) FROM raw_once UNION ALL
  SELECT * EXCLUDE (id) REPLACE ('3333.25' AS asic_power_w, src_ord + 1 AS src_ord) FROM raw_once WHERE id % 97 = 0""",
            ("raw_once",)),
    "predictions": (f"""SELECT event_id AS id, ts AS predicted_at, concat('m-', CAST(user_id AS VARCHAR)) AS miner_id,
  k / 100e0 AS risk_score, {band('(k / 100e0)', S.BANDS_WORKER)} AS risk_band, k / 100e0 >= 0.55e0 AS predicted_failure,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'v2' ELSE 'v1' END AS model_version FROM ev WHERE event_id % 3 = 0""", ("ev",)),
    "alerts": ("""SELECT event_id AS id, ts AS created_at, concat('m-', CAST(user_id AS VARCHAR)) AS miner_id,
  CASE WHEN k >= 75 THEN 'critical' ELSE 'warning' END AS severity, k / 100e0 AS risk_score,
  concat('Risk score ', k, '% exceeds threshold') AS trigger_reason,
  concat('<', event_type, '> & "', user_id, '" isn''t well') AS message,
  CASE k % 5 WHEN 0 THEN 'CONTINUE' WHEN 1 THEN 'WATCHLIST' WHEN 2 THEN 'DOWNCLOCK' WHEN 3 THEN 'REBOOT'
       ELSE 'PULL_FOR_MAINTENANCE' END AS recommended_action,
  k % 2 = 0 AS automation_triggered, k % 3 = 0 AS resolved,
  CASE WHEN k % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS resolved_at, k % 4 = 0 AS email_sent,
  k % 5 = 0 AS telegram_sent FROM ev WHERE event_type IN ('error', 'signup')""", ("ev",)),
    "setting_changes": (f"""SELECT event_id AS id, user_id AS site,
  list_extract({_list(SETTING_KEYS)}, CAST(event_id % {len(SETTING_KEYS)} AS INTEGER) + 1) AS "key",
  list_extract({_list(SETTING_VALUES)}, CAST((event_id // 7) % {len(SETTING_VALUES)} AS INTEGER) + 1) AS value,
  ts AS updated_at FROM events""", ()),
    "settings": ("""SELECT site, "key", value FROM (SELECT *, row_number() OVER (PARTITION BY site, "key" ORDER BY id DESC) AS rn
  FROM setting_changes) AS ranked WHERE rn = 1""", ("setting_changes",)),
}


def cte(name: str, body: str, needs: Sequence[str] = ()) -> None:
    """Add a further view that several oracle statements share."""
    CTES[name] = (body, tuple(needs))


def with_ctes(body: str, names: Sequence[str]) -> str:
    chosen: list[str] = []

    def visit(n: str) -> None:
        for need in CTES[n][1]:
            visit(need)
        if n not in chosen:
            chosen.append(n)

    for n in names:
        visit(n)
    if not chosen:
        return body
    parts = ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in chosen)
    return f"WITH {parts}\n{body}"
