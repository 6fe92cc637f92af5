"""JSON payloads to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.functions.exprs import parse_time, text_or_null, to_int, to_number

POLLED = [
    "asic_clock_mhz", "asic_voltage_v", "asic_hashrate_ths", "asic_temperature_c", "asic_power_w",
    "chip_temp_max", "chip_temp_std", "expected_hashrate_ths",
]
POLLED_INTS = ["bad_hash_count", "double_hash_count", "read_errors"]
SENT_SOURCES = 50_000  # sources whose mappings are sent to every executor


def payload_to_rows(df: DataFrame, payload: str, types: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A text column holding a JSON array of records to one typed row per record."""
    shape = f"array<struct<{', '.join(f'`{c}`:{t}' for c, t in types.items())}>>"
    return df.select(*keep, F.inline(F.from_json(F.col(payload), shape)))


def _json_value(c: str, type_: str) -> Column:
    if type_ == "timestamp":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c)
    if type_ == "double":  # JSON has no NaN or infinity
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias(c)
    return F.col(c).cast(type_).alias(c)


def rows_to_payload(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Each row as a JSON object with explicit nulls; absent columns become null."""
    have = set(df.columns)
    fields = [
        _json_value(c, t) if c in have else F.lit(None).cast("string" if t == "timestamp" else t).alias(c)
        for c, t in types.items()
    ]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def payload_per_device(df: DataFrame, types: dict[str, str], keys: tuple[str, ...] = ("miner_id", "batch")) -> DataFrame:
    """JSON arrays of records per device and batch; batches keep one array bounded."""
    record = F.struct(*[_json_value(c, t) for c, t in types.items() if c in df.columns])
    return df.groupBy(*keys).agg(
        F.to_json(F.collect_list(record), {"ignoreNullFields": "false"}).alias("payload"))


def polled_records(df: DataFrame, mappings: DataFrame, body: str = "body", source: str = "source_name") -> DataFrame:
    """Polled JSON bodies (a list or a single object) to telemetry rows.

    ``mappings`` has (source_name, field_mapping) with a map from our names to the source's. It is a settings
    table of a row per source, and few sources hold all bodies: it goes to the rows, a shuffle by source would
    put all bodies of a source into one task. Only where it is too long for that is it joined by shuffle.
    Records without device id or a readable time are dropped; the source is kept as origin.
    """
    text = F.trim(body)
    as_list = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    records = df.withColumn("_items", F.from_json(as_list, "array<map<string,string>>")).select(
        *[c for c in df.columns if c != body], F.explode("_items").alias("_item"))
    known = mappings.select(source, "field_mapping")
    if known.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES:
        known = F.broadcast(known)
    joined = records.join(known, source, "left")

    def get(name: str) -> Column:
        theirs = F.coalesce(F.try_element_at("field_mapping", F.lit(name)), F.lit(name))
        return F.try_element_at("_item", theirs)

    mode = F.coalesce(text_or_null(get("operating_mode"), True), F.lit("normal"))
    out = joined.select(
        *[c for c in df.columns if c not in (body, source)],
        text_or_null(get("miner_id"), True).alias("miner_id"),
        parse_time(get("timestamp")).alias("timestamp"),
        *[to_number(get(c)).alias(c) for c in POLLED],
        *[to_int(get(c)).alias(c) for c in POLLED_INTS],
        mode.alias("operating_mode"),
        text_or_null(get("event_codes"), True).alias("event_codes"),
        F.concat(F.lit("api:"), F.col(source)).alias("source"),
    )
    return out.filter(F.col("miner_id").isNotNull() & F.col("timestamp").isNotNull())


def types_of(table: str) -> dict[str, str]:
    return {"telemetry": S.UPLOAD_TYPES, "kpi": S.KPI_TYPES, "risk": S.RISK_TYPES}[table]
