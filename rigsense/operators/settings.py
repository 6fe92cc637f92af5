"""Key/value settings: validation, typing, masking and seeding.

Settings tables have (key, value) rows and may carry further columns, such as a site, that
separate one set of settings from another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.functions.exprs import lit_d, to_number, known_zone
from rigsense.operators.policy import POLICY_SETTINGS

KINDS = {
    **{k: "boolean" for k in S.BOOLEAN_SETTINGS}, **{k: "integer" for k in S.INTEGER_SETTINGS},
    **{k: "float" for k in S.FLOAT_SETTINGS}, **{k: "object" for k in S.JSON_OBJECT_SETTINGS},
    **{k: "array" for k in S.JSON_ARRAY_SETTINGS}, **{k: "timezone" for k in S.TIMEZONE_SETTINGS},
    **{k: "text" for k in S.TEXT_SETTINGS},
}


def rules(spark) -> DataFrame:
    """One row per allowed setting: kind and numeric bounds."""
    spans = {**S.INTEGER_SETTINGS, **S.FLOAT_SETTINGS}
    rows = [(k, kind, *(float(x) for x in spans.get(k, (0, 0)))) for k, kind in KINDS.items()]
    return spark.createDataFrame(rows, "key string, kind string, low double, high double")


def _float_text(x: Column) -> Column:
    """A double as text the way settings store it: '8.0', '0.05'."""
    return x.cast("string")


def validate_settings(settings: DataFrame) -> DataFrame:
    """Each setting with its cleaned value, or an error and no value."""
    spark = settings.sparkSession
    text = F.coalesce(F.trim("value"), F.lit(""))
    joined = settings.join(F.broadcast(rules(spark)), "key", "left")  # a fixed, short rule list
    kind, key = F.col("kind"), F.col("key")
    number = text.try_cast("double")
    number = F.when(~F.isnan(number), number)
    whole = F.when(F.abs(number) < lit_d(9e18), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    parsed = F.try_parse_json(text)
    shape = F.schema_of_variant(parsed)
    blank = text == ""
    low, high = F.col("low"), F.col("high")

    def quoted(before: str, after: str = "'") -> Column:
        return F.concat(F.lit(before), key, F.lit(after))

    def bounds(integer: bool) -> Column:
        show = (lambda c: c.cast("long").cast("string")) if integer else _float_text
        return F.concat(quoted("Value for '", "' must be between "), show(low), F.lit(" and "), show(high))

    error = (
        F.when(kind.isNull(), quoted("Unsupported setting key '"))
        .when((kind == "boolean") & ~blank & ~F.lower(text).isin(S.BOOLEAN_TEXT), quoted("Invalid boolean for '"))
        .when((kind == "integer") & ~blank & whole.isNull(), quoted("Invalid integer for '"))
        .when((kind == "integer") & ~blank & ~whole.between(low, high), bounds(True))
        .when((kind == "float") & ~blank & number.isNull(), quoted("Invalid number for '"))
        .when((kind == "float") & ~blank & ~number.between(low, high), bounds(False))
        .when((kind == "object") & ~blank & parsed.isNull(), quoted("Invalid JSON object for '"))
        .when((kind == "object") & ~blank & ~shape.startswith("OBJECT"), quoted("Setting '", "' must be a JSON object"))
        .when((kind == "array") & ~blank & parsed.isNull(), quoted("Invalid JSON array for '"))
        .when((kind == "array") & ~blank & ~shape.startswith("ARRAY"), quoted("Setting '", "' must be a JSON array"))
        .when((kind == "timezone") & ~blank & ~known_zone(text), quoted("Invalid timezone for '"))
        .when((kind == "text") & (F.length(text) > S.MAX_SETTING_TEXT), quoted("Value for '", "' is too long"))
    )
    clean = (
        F.when(kind == "boolean", F.lower(text))
        .when(kind == "integer", F.when(blank, F.lit("")).otherwise(whole.cast("long").cast("string")))
        .when(kind == "float", F.when(blank, F.lit("")).otherwise(_float_text(number)))
        .when(kind == "object", F.when(blank, F.lit("{}")).otherwise(F.to_json(parsed)))
        .when(kind == "array", F.when(blank, F.lit("[]")).otherwise(F.to_json(parsed)))
        .when(kind == "timezone", F.when(blank, F.lit("UTC")).otherwise(text))
        .otherwise(text)
    )
    return joined.withColumn("error", error).withColumn(
        "clean_value", F.when(F.col("error").isNull(), clean)
    ).select(*settings.columns, "clean_value", "error")


def typed_runtime_config(settings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One typed configuration per group of settings; a bad or missing entry keeps its default.

    Keys are unique within a group, as upserts leave them; one aggregate pivots them.
    """
    d = S.SETTING_DEFAULTS
    keys = ["risk_threshold", "alert_cooldown_hours", "inference_lookback_hours", "cooling_power_ratio",
            "retrain_days", "control_mode", *POLICY_SETTINGS]
    wide = settings.filter(F.col("key").isin(keys)).groupBy(*by).agg(*[
        F.max(F.when((F.col("key") == k) & (F.col("value") != ""), F.col("value"))).alias(k) for k in keys
    ])
    num = {k: to_number(F.col(k)) for k in keys}

    def guarded(key: str, ok, integer: bool = False) -> Column:
        x = num[key].try_cast("int") if integer else num[key]
        default = F.lit(int(d[key])) if integer else lit_d(float(d[key]))
        return F.when(ok(x), x).otherwise(default).alias(key)

    mode = F.lower(F.trim("control_mode"))
    policy = {k: F.coalesce(F.col(k), F.lit(d[k])).alias(k) for k in POLICY_SETTINGS}
    return wide.select(
        *by,
        guarded("risk_threshold", lambda x: x.between(0.0, 1.0)),
        guarded("alert_cooldown_hours", lambda x: x >= 0, True),
        guarded("inference_lookback_hours", lambda x: x >= 1, True),
        guarded("cooling_power_ratio", lambda x: x >= 0),
        guarded("retrain_days", lambda x: x >= 1, True),
        F.when(mode.isin(S.CONTROL_MODES), mode).otherwise(F.lit(d["control_mode"])).alias("control_mode"),
        *policy.values(),
    )


def mask_secrets(settings: DataFrame) -> DataFrame:
    value = F.coalesce("value", F.lit(""))
    masked = F.when(value != "", F.lit("********")).otherwise(F.lit("(not configured)"))
    return settings.withColumn(
        "value", F.when(F.col("key").isin(S.SECRET_SETTINGS), masked).otherwise(F.col("value")))


def seed_defaults(settings: DataFrame, by: Sequence[str] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """Add missing keys with their default, and replace values no operator ever changed."""
    spark = settings.sparkSession
    defaults = defaults or S.SETTING_DEFAULTS
    table = spark.createDataFrame(list(defaults.items()), "key string, _default string")
    legacy = F.when(F.lit(False), F.lit(False))
    for key, values in S.LEGACY_SETTING_VALUES.items():
        if key in defaults:
            legacy = legacy.when(F.col("key") == key, F.coalesce("value", F.lit("")).isin(values))
    legacy = legacy.when(
        F.col("key") == "control_mode", ~F.coalesce("value", F.lit("")).isin(S.CONTROL_MODES)
    ).otherwise(F.lit(False))
    kept = settings.join(F.broadcast(table), "key", "left").withColumn(
        "value", F.when(legacy & F.col("_default").isNotNull(), F.col("_default")).otherwise(F.col("value"))
    ).select(*by, "key", "value")
    if by:
        groups = settings.select(*by).distinct()
        every = groups.select(*by, F.explode(F.array(*[
            F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in defaults.items()
        ])).alias("d")).select(*by, "d.key", "d.value")
    else:
        every = table.toDF("key", "value")
    missing = every.join(settings.select(*by, "key"), [*by, "key"], "left_anti")
    return kept.unionByName(missing)


