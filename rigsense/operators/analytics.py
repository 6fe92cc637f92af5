"""Exploratory statistics, anomalies, rollups and chart data."""

from __future__ import annotations

from math import isfinite
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.functions.exprs import count_where, flag, lit_d, ratio, round_half_even, safe_corr
from rigsense.operators.scale import attach_row, exact_quantiles


def time_window(
    df: DataFrame,
    end: datetime,
    hours: float | None = None,
    start: datetime | None = None,
    column: str = "timestamp",
    date_column: str | None = None,
) -> DataFrame:
    """Rows in [start, end], start defaulting to ``hours`` before the end.

    The bounds are literals, so they reach the scan; with ``date_column`` they also prune
    date partitions.
    """
    start = start or end - timedelta(hours=hours or 0)
    out = df.filter(F.col(column).between(F.lit(start), F.lit(end)))
    if date_column:
        out = out.filter(F.col(date_column).between(F.lit(start.date()), F.lit(end.date())))
    return out


# --------------------------------------------------------------------------- correlations
def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson r of every pair (a, b) with a not after b, in one scan.

    Rows are grouped by which columns are missing. Inside such a group every column is either
    complete or absent, so one sum per column and one per pair of columns are enough, and the
    groups that have both columns add up to the pair. Sums are taken around each column's mean,
    which one scan before finds; that keeps them accurate for narrow columns. (One scan of ``covar_pop`` per
    pair is as accurate, but keeps four numbers a pair and takes twice the time of both scans.) NaN is
    missing; a column with an infinite value has no correlation.
    """
    cols = list(columns)
    df = df.select(*[F.expr(f"nullif(CAST(`{c}` AS DOUBLE), double('NaN'))").alias(c) for c in cols])
    means = df.agg(*[F.avg(f"`{c}`").alias(c) for c in cols]).first()
    centre = {c: means[c] if means[c] is not None and isfinite(means[c]) else 0.0 for c in cols}
    x = {c: f"(`{c}` - {centre[c]!r}D)" for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    missing = "concat(" + ", ".join(f"if(`{c}` IS NULL, '1', '0')" for c in cols) + ")"
    sums = df.groupBy(F.expr(missing).alias("_missing")).agg(
        F.expr("CAST(count(1) AS DOUBLE)").alias("n"),
        *[F.expr(f"sum({x[c]})").alias(f"s_{c}") for c in cols],
        *[F.expr(f"sum({x[a]} * {x[b]})").alias(f"p_{a}~{b}") for a, b in pairs],
    )
    cells = ", ".join(
        f"struct('{a}' AS a, '{b}' AS b, n, `s_{a}` AS sa, `s_{b}` AS sb, `p_{a}~{a}` AS saa, "
        f"`p_{b}~{b}` AS sbb, `p_{a}~{b}` AS sab)" for a, b in pairs)
    long = sums.select(F.expr(f"inline(array({cells}))"))
    total = long.filter("sab IS NOT NULL").groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    # What rounding leaves of a constant column's spread counts as no spread.
    spread = "if({0}{0} - s{0} * s{0} / n > 1e-12D * {0}{0}, sqrt({0}{0} - s{0} * s{0} / n), NULL)"
    va, vb = (spread.format(c).replace(f"{c}{c}", f"s{c}{c}") for c in "ab")
    r = F.expr(f"nullif((sab - sa * sb / n) / ({va} * {vb}), double('NaN'))")
    return total.select("a", "b", F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r).alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] = tuple(S.EDA_COLUMNS)) -> DataFrame:
    """The full matrix as (left, right, r); r is NULL where it is undefined."""
    cols = [c for c in columns if c in df.columns]
    half = pair_correlations(df, cols)
    found = half.select(F.col("a").alias("left"), F.col("b").alias("right"), "r").unionByName(
        half.filter("a <> b").select(F.col("b").alias("left"), F.col("a").alias("right"), "r"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in cols for b in cols], "left string, right string")
    return grid.join(found, ["left", "right"], "left")


def correlation_api(df: DataFrame, columns: Sequence[str] = tuple(S.API_CORRELATION_COLUMNS)) -> DataFrame:
    """One row of named, rounded correlations; no row when every cell is undefined."""
    cols = list(columns)
    cells = [(a, b) if cols.index(a) <= cols.index(b) else (b, a) for a in cols for b in cols]
    row = pair_correlations(df, cols).agg(*[
        F.expr(f"round(max(CASE WHEN a = '{a}' AND b = '{b}' THEN r END), 3)").alias(f"{a}~{b}")
        for a, b in dict.fromkeys(cells)
    ], F.max("r").alias("_any"))
    names = [f"corr__{a}__{b}" for a in cols for b in cols]
    return row.filter("_any IS NOT NULL").select(*[F.col(f"`{a}~{b}`").alias(n) for (a, b), n in zip(cells, names)])


def tradeoff_summary(df: DataFrame, columns: Sequence[str] = tuple(S.TRADEOFF_COLUMNS)) -> DataFrame:
    """Mean, median and sample deviation of each metric per mode, four digits."""
    num = {c: F.col(c).cast("double") for c in columns}
    known = df.filter(F.col("operating_mode").isNotNull())
    stats = known.groupBy("operating_mode").agg(
        *[round_half_even(F.avg(x), 4).alias(f"{c}_mean") for c, x in num.items()],
        *[round_half_even(F.stddev_samp(x), 4).alias(f"{c}_std") for c, x in num.items()],
    )
    medians = exact_quantiles(known, {c: (x, 0.5) for c, x in num.items()}, ["operating_mode"]).select("operating_mode", *[round_half_even(F.col(c), 4).alias(f"{c}_median") for c in columns])
    order = [f"{c}_{s}" for c in columns for s in ("mean", "median", "std")]
    return stats.join(medians, "operating_mode").select("operating_mode", *order)


# --------------------------------------------------------------------------- anomalies
FLAGS = ["anomaly_temp", "anomaly_power_instability", "anomaly_hashrate_drop",
         "anomaly_power_spike", "anomaly_low_te"]


def anomaly_flags(df: DataFrame) -> DataFrame:
    """Five signals per row and their count."""
    temp, power, te = F.col("asic_temperature_c"), F.col("asic_power_w"), F.col("true_efficiency_te")
    stats = df.agg(
        F.avg(temp).alias("temp_mean"), F.stddev_pop(temp).alias("temp_std"),
        F.avg(power).alias("power_mean"), F.stddev_pop(power).alias("power_std"),
    )
    out, s = attach_row(df, stats)
    out, q = attach_row(out, exact_quantiles(df, {"te_low": (te, 0.10)}))
    temp_z = (temp - s["temp_mean"]) / (s["temp_std"] + lit_d(1e-6))
    power_z = (power - s["power_mean"]) / (s["power_std"] + lit_d(1e-6))
    tests = {
        "anomaly_temp": (temp > lit_d(95.0)) | (temp_z > lit_d(2.8)),
        "anomaly_power_instability": F.col("power_instability_index") > lit_d(0.75),
        "anomaly_hashrate_drop": F.col("hashrate_deviation_pct") < lit_d(-15.0),
        "anomaly_power_spike": power_z > lit_d(2.8),
        "anomaly_low_te": te < q["te_low"],
    }
    out = out.withColumns({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()})
    count = sum((flag(F.col(n)) for n in FLAGS), F.lit(0))
    return out.withColumn("anomaly_signal_count", count).select(*df.columns, *FLAGS, "anomaly_signal_count")


def anomaly_multi_signal(df: DataFrame) -> DataFrame:
    """Rows with at least two signals, most signals first, then oldest first."""
    keep = [
        "timestamp", "miner_id", "operating_mode", "asic_temperature_c", "asic_power_w",
        "asic_hashrate_ths", "power_instability_index", "hashrate_deviation_pct",
        "true_efficiency_te", S.TARGET, "anomaly_signal_count", *FLAGS,
    ]
    return anomaly_flags(df).filter("anomaly_signal_count >= 2").select(*keep).orderBy(
        F.col("anomaly_signal_count").desc(), "timestamp", "miner_id"
    )


def top_anomaly_miners(df: DataFrame, n: int = 10) -> DataFrame:
    flagged = anomaly_flags(df).filter("anomaly_signal_count >= 2 and miner_id is not null")
    return flagged.groupBy("miner_id").agg(F.count(F.lit(1)).alias("anomalies")).orderBy(
        F.col("anomalies").desc(), "miner_id"
    ).limit(n)


def eda_summary(df: DataFrame) -> DataFrame:
    """Counts, rates and the six key correlations in one aggregate."""
    return anomaly_flags(df).agg(
        F.count(F.lit(1)).alias("rows_analyzed"),
        F.count_distinct("miner_id").alias("miners_analyzed"),
        F.avg(F.col(S.TARGET).cast("double")).alias("label_positive_rate"),
        count_where(F.col("anomaly_signal_count") >= 2).alias("anomaly_rows"),
        (count_where(F.col("anomaly_signal_count") >= 2)
         / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("anomaly_rate"),
        *[
            safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
            for a, b in S.KEY_CORRELATIONS
        ],
    )


def anomaly_zscore(
    df: DataFrame, columns: Sequence[str] = tuple(S.ZSCORE_COLUMNS), n: int = 200
) -> DataFrame:
    """Readings more than three deviations off, worst first. One scan unpivots all columns."""
    stats = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    )
    out, s = attach_row(df, stats)
    z = {
        c: F.abs(ratio(F.col(c) - s[f"mean_{c}"], F.nullif(s[f"std_{c}"], lit_d(0.0))))
        for c in columns
    }
    long = out.select("miner_id", "timestamp", F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), z[c].alias("z")) for c in columns
    ])))
    return (
        long.filter(F.col("z") > lit_d(3.0))
        .withColumn("severity", F.when(F.col("z") > lit_d(5.0), F.lit("critical")).otherwise(F.lit("warning")))
        .orderBy(F.col("z").desc(), "miner_id", "timestamp", "field")
        .limit(n)
        .select("miner_id", "timestamp", "field", "value", F.round("z", 3).alias("z_score"), "severity")
    )


# --------------------------------------------------------------------------- rollup and reads
def hourly_rollup(df: DataFrame, exact: bool = False) -> DataFrame:
    """Hourly averages per device; ``exact`` also keeps sums and counts, from which averages
    over longer spans can be computed without the error of averaging averages."""
    aggs = [F.avg(src).alias(name) for name, src in S.ROLLUP_SOURCES.items()]
    if exact:
        aggs += [F.sum(src).alias(f"sum_{src}") for src in S.ROLLUP_SOURCES.values()]
        aggs += [F.count(src).alias(f"n_{src}") for src in S.ROLLUP_SOURCES.values()]
    return df.groupBy(F.date_trunc("hour", F.col("timestamp")).alias("bucket"), "miner_id").agg(
        *aggs, F.min("operating_mode").alias("operating_mode_sample"), F.count(F.lit(1)).alias("samples")
    )


def rollup_as_rows(rollup: DataFrame) -> DataFrame:
    """Rollup columns under the names of the readings they average."""
    return rollup.select(
        "miner_id", F.col("bucket").alias("timestamp"),
        *[F.col(n).alias(src) for n, src in S.ROLLUP_SOURCES.items()],
        F.col("operating_mode_sample").alias("operating_mode"),
    )


def route_source(
    raw: DataFrame, rollup: DataFrame | None, start: datetime, end: datetime, source: str = "auto"
) -> DataFrame:
    """Rows of the window from the rollup when it has any there, else from the raw table.

    ``auto`` asks with a one-row probe of the rollup; "raw" and "rollup" ask nothing.
    """
    if rollup is not None:
        scoped = rollup_as_rows(rollup).filter(F.col("timestamp").between(F.lit(start), F.lit(end)))
        if source == "rollup" or (source == "auto" and not scoped.isEmpty()):
            return scoped
    columns = ["miner_id", "timestamp", *S.ROLLUP_SOURCES.values(), "operating_mode"]
    return time_window(raw, end, start=start).select(*columns)


def tradeoff_points(df: DataFrame, n: int = 2000, tiebreak: Sequence[str] = ("id",)) -> DataFrame:
    """The latest ``n`` rows for the scatter charts; more than 5000 are refused."""
    if n > 5000:
        raise ValueError("at most 5000 points can be asked for")
    ties = [F.col(t) for t in (*tiebreak, "miner_id") if t in df.columns]
    return df.orderBy(F.col("timestamp").desc(), *ties).limit(n).select(
        "miner_id", "asic_hashrate_ths", "asic_temperature_c", "asic_power_w", "asic_clock_mhz",
        "asic_voltage_v", "true_efficiency_te", "operating_mode",
    )


def tradeoff_series(points: DataFrame) -> DataFrame:
    """Chart points as (chart, mode, x, y)."""
    mode = F.when(F.coalesce(F.col("operating_mode"), F.lit("")) == "", F.lit("normal")).otherwise(
        F.col("operating_mode"))
    return points.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("chart"), mode.alias("mode"), F.col(x).alias("x"), F.col(y).alias("y"))
        for c, x, y in S.TRADEOFF_CHARTS
    ])))


def efficiency_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("miner_id").agg(
        F.avg("true_efficiency_te").alias("avg_te"),
        F.avg("efficiency_j_per_th").alias("avg_efficiency"),
        F.avg("asic_hashrate_ths").alias("avg_hashrate"),
    ).orderBy(F.col("avg_te").desc_nulls_first(), "miner_id")


def scatter_sample(df: DataFrame, keys: Sequence[str], n: int = 8000, seed: int = 42) -> DataFrame:
    """A repeatable sample of at most ``n`` rows: the smallest hashes of the keys."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def te_box_stats(df: DataFrame, value: str = "true_efficiency_te") -> DataFrame:
    """Per mode the quartiles, the whiskers (last value within 1.5 IQR) and outlier counts."""
    x = F.col(value)
    known = df.filter(F.col("operating_mode").isin(S.OPERATING_MODES))
    quart = exact_quantiles(known, {"q1": (x, 0.25), "med": (x, 0.5), "q3": (x, 0.75)}, ["operating_mode"])
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - lit_d(1.5) * iqr, F.col("q3") + lit_d(1.5) * iqr
    fenced = known.join(F.broadcast(quart), "operating_mode")  # one row per mode
    return fenced.groupBy("operating_mode").agg(
        F.first("q1").alias("q1"), F.first("med").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(x >= low, x)).alias("whisker_low"), F.max(F.when(x <= high, x)).alias("whisker_high"),
        count_where((x < low) | (x > high)).alias("outliers"), F.count(x).alias("n"),
    )


def risk_histogram(df: DataFrame, bins: int = 35, score: str = "risk_score", label: str = S.TARGET) -> DataFrame:
    """Equal-width bins over the observed range; densities integrate to one per label."""
    span = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    out, s = attach_row(df.filter(F.col(score).isNotNull()), span)
    width = (s["hi"] - s["lo"]) / lit_d(bins)
    raw = F.floor(ratio(F.col(score) - s["lo"], width)).cast("int")
    binned = out.select(
        F.col(label).alias("label"),
        F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).alias("bin"),
        s["lo"].alias("lo"), width.alias("width"),
    )
    counts = binned.groupBy("label", "bin", "lo", "width").agg(F.count(F.lit(1)).alias("n"))
    per_label = counts.groupBy("label").agg(F.sum("n").alias("total"))
    joined = counts.join(F.broadcast(per_label), "label")  # two labels
    return joined.select(
        "label", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), "n",
        ratio(F.col("n").cast("double"), F.col("total") * F.col("width")).alias("density"),
    )


def concat_frames(*frames: DataFrame) -> DataFrame:
    """Row-wise concatenation; absent columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
