"""Fleet, device and join-shaped read queries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigsense.functions.exprs import count_where, lit_d
from rigsense.operators.scale import attach_row, latest_per_key

LATEST_COLUMNS = [
    "asic_hashrate_ths", "asic_temperature_c", "asic_power_w", "asic_voltage_v",
    "asic_clock_mhz", "operating_mode",
]


def newest(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """The newest row of each device."""
    order = [F.col(time).desc()] + [F.col("id").desc()] * ("id" in df.columns)
    return latest_per_key(df, ["miner_id"], order)


def not_in_table(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def in_list(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among the values of a one-column DataFrame."""
    return df.join(values.toDF(column), column, "left_semi")


def latest_for_devices(devices: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Inner top-1 per device: devices without telemetry are left out."""
    latest = newest(telemetry).select("miner_id", F.col("timestamp").alias("last_seen"), *LATEST_COLUMNS)
    return devices.join(latest, "miner_id")


def latest_risk(devices: DataFrame, predictions: DataFrame) -> DataFrame:
    """Left top-1 per device: score 0 and band 'unknown' where nothing was predicted."""
    latest = newest(predictions, "predicted_at").select("miner_id", "risk_score", "risk_band", "predicted_at")
    return devices.join(latest, "miner_id", "left").withColumns({
        "risk_score": F.coalesce("risk_score", lit_d(0.0)),
        "risk_band": F.coalesce("risk_band", F.lit("unknown")),
    })


def with_latest_context(features: DataFrame, history: DataFrame) -> DataFrame:
    """Event codes of the row a device's features were taken from."""
    context = newest(history).select("miner_id", "timestamp", "event_codes")
    return features.join(context, ["miner_id", "timestamp"], "left")


def with_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row next to the overall mean and deviation of the given columns."""
    stats = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns]
    )
    out, row = attach_row(df, stats)
    return out.select(*df.columns, *[row[c].alias(c) for c in stats.columns])


def without_cooldown(df: DataFrame, alerts: DataFrame, as_of: datetime, hours: float) -> DataFrame:
    """Devices that have no unresolved alert younger than the cooldown."""
    recent = alerts.filter(
        ~F.col("resolved") & (F.col("created_at") >= F.lit(as_of - timedelta(hours=hours)))
    )
    return df.join(recent.select("miner_id").distinct(), "miner_id", "left_anti")


def seeded_devices(predictions: DataFrame, rollup: DataFrame) -> DataFrame:
    return predictions.select("miner_id").union(rollup.select("miner_id")).distinct()


def known_devices(
    predictions: DataFrame, rollup: DataFrame, kpi: DataFrame, as_of: datetime, days: float = 7
) -> DataFrame:
    """Seeded devices; only when there are none, the devices seen in the last days."""
    seeds = seeded_devices(predictions, rollup)
    recent = kpi.filter(F.col("timestamp") >= F.lit(as_of - timedelta(days=days))).select("miner_id").distinct()
    out, row = attach_row(recent, seeds.limit(1).agg(F.count(F.lit(1)).alias("n")))
    return seeds.unionAll(out.filter(row["n"] == 0).select("miner_id"))


def fleet_status(
    devices: DataFrame, telemetry: DataFrame, predictions: DataFrame, limit: int | None = 500, offset: int = 0
) -> DataFrame:
    """Devices with their newest reading and risk, riskiest first; all of them where ``limit`` is None."""
    rows = latest_risk(latest_for_devices(devices, telemetry), predictions)
    ordered = rows.orderBy(F.col("risk_score").desc(), "miner_id").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def fleet_summary(devices: DataFrame, telemetry: DataFrame, predictions: DataFrame) -> DataFrame:
    rows = latest_risk(latest_for_devices(devices, telemetry), predictions)

    def banded(*names: str) -> Column:
        return count_where(F.col("risk_band").isin(*names))

    return rows.agg(
        F.count(F.lit(1)).alias("total_miners"),
        F.round(F.avg("asic_hashrate_ths"), 2).alias("avg_hashrate"),
        F.round(F.avg("asic_temperature_c"), 1).alias("avg_temperature"),
        F.round(F.avg("asic_power_w"), 0).alias("avg_power"),
        F.round(F.sum("asic_hashrate_ths"), 2).alias("total_hashrate"),
        banded("critical").alias("critical_count"),
        banded("high").alias("high_risk_count"),
        banded("low", "medium").alias("healthy_count"),
    )


def fleet_filter(fleet: DataFrame, search: str = "", band: str = "all") -> DataFrame:
    """Case-insensitive part of the id, and optionally one risk band."""
    out = fleet
    if search:
        out = out.filter(F.lower(F.coalesce("miner_id", F.lit(""))).contains(search.lower()))
    if band and band != "all":
        out = out.filter(F.col("risk_band") == band)
    return out


def history(
    df: DataFrame, miner_id: str, as_of: datetime, hours: float, columns: Sequence[str],
    time: str = "timestamp", limit: int | None = 5000,
) -> DataFrame:
    """One device's last hours, oldest first."""
    rows = df.filter((F.col("miner_id") == miner_id) & (F.col(time) >= F.lit(as_of - timedelta(hours=hours))))
    ordered = rows.orderBy(time, *(["id"] if "id" in df.columns else []))
    return (ordered.limit(limit) if limit else ordered).select(*columns)


def miner_history(telemetry: DataFrame, miner_id: str, as_of: datetime, hours: float = 24) -> DataFrame:
    return history(telemetry, miner_id, as_of, hours, ["timestamp", *LATEST_COLUMNS])


def miner_kpi_history(kpi: DataFrame, miner_id: str, as_of: datetime, hours: float = 24) -> DataFrame:
    return history(kpi, miner_id, as_of, hours, [
        "timestamp", "true_efficiency_te", "efficiency_j_per_th", "power_instability_index",
        "hashrate_deviation_pct",
    ])


def miner_risk_history(predictions: DataFrame, miner_id: str, as_of: datetime, hours: float = 48) -> DataFrame:
    return history(
        predictions, miner_id, as_of, hours,
        ["predicted_at", "risk_score", "risk_band", "predicted_failure"], "predicted_at", None,
    )
