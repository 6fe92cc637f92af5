"""Efficiency KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.functions.exprs import clamp, lit_d, ratio, round_half_even, safe_corr
from rigsense.operators.quality import median_fill
from rigsense.operators.scale import attach_row, exact_quantiles, over_device_rows

POWER_WINDOW = 6


def mode_factor(mode: Column) -> Column:
    """Stress factor of a mode; unknown and missing modes count as 1."""
    out = F.when(F.lit(False), lit_d(1.0))
    for name, factor in S.MODE_STRESS.items():
        out = out.when(mode == name, lit_d(factor))
    return out.otherwise(lit_d(1.0))


def voltage_stress(v: Column, v_ref: float = S.V_REF, alpha: float = S.ALPHA_V) -> Column:
    return lit_d(1.0) + lit_d(alpha) * clamp((v - lit_d(v_ref)) / lit_d(max(v_ref, 1e-6)), lo=0.0)


def environment_stress(t: Column, t_ref: float = S.T_REF, alpha: float = S.ALPHA_E) -> Column:
    return lit_d(1.0) + lit_d(alpha) * clamp((t - lit_d(t_ref)) / lit_d(10.0), lo=0.0)


def true_efficiency_columns(
    df: DataFrame,
    v_ref: float = S.V_REF,
    t_ref: float = S.T_REF,
    alpha_v: float = S.ALPHA_V,
    alpha_e: float = S.ALPHA_E,
) -> DataFrame:
    """The KPI columns without the median fill; row-local."""
    mode = F.lower(F.trim("operating_mode"))
    total = clamp(F.col("asic_power_w") + F.col("cooling_power_w"), lo=1e-6)
    out = df.withColumns({
        "operating_mode": mode,
        "total_power_w": total,
        "base_eff_th_per_w": F.col("asic_hashrate_ths") / total,
        "voltage_stress_factor": voltage_stress(F.col("asic_voltage_v"), v_ref, alpha_v),
        "environment_stress_factor": environment_stress(
            F.col("ambient_temperature_c"), t_ref, alpha_e
        ),
        "mode_stress_factor": mode_factor(mode),
    })
    stress = clamp(
        F.col("voltage_stress_factor") * F.col("environment_stress_factor")
        * F.col("mode_stress_factor"),
        lo=1e-6,
    )
    return out.withColumn("true_efficiency_te", ratio(F.col("base_eff_th_per_w"), stress))


def true_efficiency(df: DataFrame, **constants: float) -> DataFrame:
    """Append the six KPI columns; a missing TE gets the median TE."""
    return median_fill(true_efficiency_columns(df, **constants), ["true_efficiency_te"])


def te_worker(cooling_ratio: float = S.COOLING_RATIO, cooling: Column | None = None) -> Column:
    """TE as the periodic KPI job defines it: defaults for missing inputs, no median fill."""
    power = F.col("asic_power_w")
    filled = F.coalesce(power, lit_d(0.0)) * lit_d(cooling_ratio)
    cool = F.coalesce(cooling, filled) if cooling is not None else filled
    total = F.coalesce(power, lit_d(1500.0)) + cool
    base = ratio(F.coalesce(F.col("asic_hashrate_ths"), lit_d(1.0)), total)
    stress = (
        voltage_stress(F.coalesce(F.col("asic_voltage_v"), lit_d(S.V_REF)))
        * environment_stress(F.coalesce(F.col("ambient_temperature_c"), lit_d(S.T_REF)))
        * mode_factor(F.col("operating_mode"))
    )
    return round_half_even(ratio(base, stress), 6)


def te_snapshot() -> Column:
    """TE of a seeded snapshot: cooling is a fixed share of power."""
    power = F.col("asic_power_w")
    total = clamp(power + power * lit_d(S.COOLING_RATIO), lo=1e-6)
    stress = clamp(
        voltage_stress(F.col("asic_voltage_v")) * environment_stress(F.col("ambient_temperature_c"))
        * mode_factor(F.col("operating_mode")),
        lo=1e-6,
    )
    return F.round(F.col("asic_hashrate_ths") / total / stress, 6)


def efficiency() -> Column:
    return round_half_even(ratio(F.col("asic_power_w"), F.col("asic_hashrate_ths")), 4)


def power_instability(df: DataFrame, window: int = POWER_WINDOW, **skew) -> DataFrame:
    """Rolling coefficient of variation of power per device, 0..1.

    It runs over a device's whole history, not over pages of it.
    """
    def build(part: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(window - 1), 0)
        power = F.col("asic_power_w")
        enough = F.count(power).over(frame) >= 2
        cv = F.when(enough, ratio(F.stddev_pop(power).over(frame), F.avg(power).over(frame)))
        index = round_half_even(clamp(F.coalesce(cv, lit_d(0.0)), 0.0, 1.0), 4)
        return part.withColumn("power_instability_index", index)

    return over_device_rows(df, build, back=window - 1, **skew)


def hashrate_deviation_by_mode(df: DataFrame, batch: str | None = None) -> DataFrame:
    """Percent off the mode's median hashrate; ``batch`` limits the median to a batch.

    Modes are few, so their medians are aggregated and sent to the rows; a window per mode
    would put a third of the table on one task.
    """
    by = ["operating_mode"] + ([batch] if batch else [])
    medians = exact_quantiles(df, {"_median": (F.col("asic_hashrate_ths"), 0.5)}, by)
    dev = round_half_even(
        ratio(F.col("asic_hashrate_ths") - F.col("_median"), F.col("_median")) * lit_d(100.0), 2
    )
    side = F.broadcast(medians) if batch is None else medians
    return df.join(side, by, "left").withColumn("hashrate_deviation_pct", dev).select(
        *[c for c in df.columns if c != "hashrate_deviation_pct"], "hashrate_deviation_pct"
    )


def kpi_rows(telemetry: DataFrame, cooling_ratio: float = S.COOLING_RATIO, **skew) -> DataFrame:
    """KPI rows for telemetry rows, in the column order of the KPI table."""
    out = hashrate_deviation_by_mode(power_instability(telemetry, **skew))
    out = out.withColumns({
        "efficiency_j_per_th": efficiency(),
        "true_efficiency_te": te_worker(cooling_ratio),
        S.TARGET: F.lit(0),
    })
    return out.select(*[c for c in S.KPI_TYPES if c in out.columns])


def kpi_incremental(telemetry: DataFrame, kpi: DataFrame, **kw) -> DataFrame:
    """KPI rows for telemetry that has none yet. Values come from the full history, so they
    do not depend on how the backlog is cut into batches."""
    keys = ["miner_id", "timestamp"]
    valid = telemetry.filter(F.col("timestamp").isNotNull())
    return kpi_rows(valid, **kw).join(kpi.select(*keys), keys, "left_anti")


def kpi_summary(df: DataFrame) -> DataFrame:
    """TE statistics, per-mode means and the TE/label correlation as (section, item, value)."""
    metrics = [
        "true_efficiency_te", "efficiency_j_per_th", "asic_power_w", "cooling_power_w",
        "asic_hashrate_ths",
    ]
    te, label = F.col("true_efficiency_te"), F.col(S.TARGET).cast("double")
    stats = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.min(te).alias("min"),
        F.avg(te).alias("mean"), F.max(te).alias("max"), safe_corr(te, label).alias("corr"),
    )
    stats, med = attach_row(stats, exact_quantiles(df, {"median": (te, 0.5)}))
    entries = [("rows", "rows", F.col("rows"))]
    entries += [("te_stats", m, F.col(m)) for m in ("min", "mean", "max")]
    entries += [("te_stats", "median", med["median"]),
                ("correlation_with_failure_label", S.TARGET, F.col("corr"))]

    def long(row: DataFrame, prefix: Column | None, items) -> DataFrame:
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(s).alias("section"),
                     (F.lit(i) if prefix is None else F.concat(prefix, F.lit("."), F.lit(i))).alias("item"),
                     v.alias("value"))
            for s, i, v in items
        ])))

    modes = df.filter(F.col("operating_mode").isNotNull()).groupBy("operating_mode").agg(
        *[round_half_even(F.avg(m), 4).alias(m) for m in metrics]
    )
    return long(stats, None, entries).unionByName(
        long(modes, F.col("operating_mode"), [("mode_average_metrics", m, F.col(m)) for m in metrics])
    )
