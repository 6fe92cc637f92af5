"""Micro-batch jobs. Each batch may be replayed after a failure, so every sink is either
keyed (insert if absent), or written to a folder named by its batch and overwritten.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from rigsense import schema as S
from rigsense.operators import scoring
from rigsense.operators.alerts import alert_generate
from rigsense.operators.kpi import POWER_WINDOW, efficiency, hashrate_deviation_by_mode, power_instability, te_worker
from rigsense.operators.scale import latest_per_key, materialize, null_safe_join
from rigsense.operators.tables import absent_rows, write_by_date

KEY = ["miner_id", "timestamp"]


def read_folder(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there now, batch by batch, and stop."""
    query = (
        stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    query.awaitTermination()


def table_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet folder, or no rows while it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# --------------------------------------------------------------------------- ingest
def _by_id(df: DataFrame) -> list[str]:
    return ["id"] if "id" in df.columns else []


def _timed(batch: DataFrame, aside: str, n: int) -> DataFrame:
    """Rows with a time; the others are written to a folder of the batch."""
    batch.filter(F.col("timestamp").isNull()).write.mode("overwrite").parquet(f"{aside}/batch={n}")
    return batch.filter(F.col("timestamp").isNotNull())


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Rows whose key is new into a date-partitioned table, however late they come.

    The keyed insert catches repeats and replays; it reads only the dates the batch touches and
    keeps no state. Of repeats within a batch the one with the smallest id stays. Rows without a
    time have no key: each batch puts its own aside in ``<path>-untimed``.
    """
    schema = StructType(stream.schema.fields)

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = _timed(batch, f"{path}-untimed", n)
        days = batch.select(F.to_date("timestamp").alias("event_date")).distinct()
        stored = table_or_empty(spark, path, StructType([*schema.fields, StructField("event_date", DateType())]))
        scoped = stored.join(F.broadcast(days), "event_date", "left_semi")  # one row per day
        write_by_date(absent_rows(batch, scoped, KEY, _by_id(batch)), path)

    run_available(stream, write, checkpoint)


# --------------------------------------------------------------------------- KPIs
def _near(days: DataFrame, touched: DataFrame, rows: int) -> DataFrame:
    """Device days that a change on the touched ones concerns, from ``days`` (miner_id, event_date, n).

    ``_after``: the day is touched, or holds some of the next ``rows`` rows, whose windows change. The other
    days returned hold some of the ``rows`` rows before, which these windows read.
    """
    marked = days.join(touched.withColumn("_hit", F.lit(True)), ["miner_id", "event_date"], "left")
    order = Window.partitionBy("miner_id").orderBy("event_date")  # a row per day
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    marked = marked.withColumn("_e", F.sum("n").over(order)).withColumn("_s", F.col("_e") - F.col("n"))
    marked = marked.withColumns({
        "_after": F.coalesce(F.col("_s") < F.max(F.when(F.col("_hit"), F.col("_e"))).over(before) + rows, F.lit(False)),
        "_before": F.coalesce(F.col("_e") > F.min(F.when(F.col("_hit"), F.col("_s"))).over(after) - rows, F.lit(False)),
    })
    return marked.filter("_after or _before").select("miner_id", "event_date", "_after")


def kpi_job(stream: DataFrame, path: str, checkpoint: str, cooling_ratio: float = S.COOLING_RATIO) -> None:
    """KPI rows for telemetry whose key has none yet; a reading that comes again is left out.

    A reading may come late: its rolling window takes the rows before it from the stored table, and the
    windows of the rows after it are computed anew, so values do not depend on the order of arrival. A table
    of row counts per device and day says which days hold these neighbours; only they are read, and only
    dates with changed rows are rewritten. A replayed batch finds its keys stored and repairs the same rows
    again. Mode medians are those of the batch, which is all a batch can know. Rows without a time go to
    ``untimed``.
    """
    names = list(stream.columns)

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        day = F.to_date("timestamp")
        batch = _timed(batch, f"{path}/untimed", n).withColumn("event_date", day)
        derived = {"efficiency_j_per_th", "power_instability_index", "hashrate_deviation_pct", "true_efficiency_te", S.TARGET}
        shape = power_instability(batch, split=False).withColumns({c: F.lit(None).cast(S.KPI_TYPES[c]) for c in derived if c != "power_instability_index"})
        columns = [c for c in S.KPI_TYPES if c in derived or c in names]
        schema = shape.select(*columns, "event_date").schema
        stored = table_or_empty(spark, f"{path}/kpi", schema)
        touched = batch.select("miner_id", "event_date").distinct()
        same_days = stored.join(F.broadcast(batch.select("event_date").distinct()), "event_date", "left_semi")  # one row per day
        fresh = materialize(absent_rows(batch, same_days, KEY, _by_id(batch)), "stream-fresh")

        # Counts of the touched dates come from the rows, those of other dates from the table of counts.
        known = table_or_empty(spark, f"{path}/days", StructType([schema["miner_id"]]).add("n", "long").add("event_date", "date"))
        counts = same_days.select("miner_id", "event_date").unionByName(fresh.select("miner_id", "event_date")).groupBy("miner_id", "event_date").agg(F.count("*").alias("n"))
        others = known.join(F.broadcast(batch.select("event_date").distinct()), "event_date", "left_anti").join(touched.select("miner_id").distinct(), "miner_id", "left_semi")
        near = materialize(_near(others.unionByName(counts), touched, POWER_WINDOW - 1), "stream-near")

        dates = F.broadcast(near.select("event_date").distinct())
        inputs = ["miner_id", "timestamp", "event_date", "asic_power_w"]  # keys are unique, so no tie needs an id
        around = stored.join(dates, "event_date", "left_semi").select(*inputs).unionByName(fresh.select(*inputs)).join(near, ["miner_id", "event_date"])
        rolled = power_instability(around).filter("_after").select(*KEY, "power_instability_index")
        rows = hashrate_deviation_by_mode(fresh).withColumns({
            "efficiency_j_per_th": efficiency(), "true_efficiency_te": te_worker(cooling_ratio), S.TARGET: F.lit(0).cast(S.KPI_TYPES[S.TARGET]),
        }).select(*[c for c in [*columns, "event_date"] if c != "power_instability_index"])
        changed = F.broadcast(near.filter("_after").select("event_date").distinct())
        before = stored.join(changed, "event_date", "left_semi")
        kept = before.withColumnRenamed("power_instability_index", "_was").join(rolled, KEY, "left").withColumn(
            "power_instability_index", F.coalesce("power_instability_index", "_was")).drop("_was")
        content = materialize(kept.unionByName(rows.join(rolled, KEY)).select(*columns, "event_date"), "stream-kpi")
        write_by_date(content.drop("event_date"), f"{path}/kpi", mode="overwrite")
        sizes = content.groupBy("event_date", "miner_id").agg(F.count("*").alias("n"))
        sizes.hint("rebalance", "event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{path}/days")

    run_available(stream, write, checkpoint)


# --------------------------------------------------------------------------- rollup
def windowed_rollup(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Hourly rollup kept in streaming state; rows later than the watermark are ignored."""
    return (
        stream.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", "1 hour"), "miner_id")
        .agg(
            *[F.avg(src).alias(name) for name, src in S.ROLLUP_SOURCES.items()],
            F.min("operating_mode").alias("operating_mode_sample"), F.count(F.lit(1)).alias("samples"),
        )
        .select(F.col("window.start").alias("bucket"), "miner_id", *S.ROLLUP_SOURCES, "operating_mode_sample", "samples")
    )


def partial_rollup(rows: DataFrame) -> DataFrame:
    """Sums and counts per hour and device, which can be added up later."""
    return rows.groupBy(F.date_trunc("hour", F.col("timestamp")).alias("bucket"), "miner_id").agg(
        *[F.sum(src).alias(f"sum_{name}") for name, src in S.ROLLUP_SOURCES.items()],
        *[F.count(src).alias(f"n_{name}") for name, src in S.ROLLUP_SOURCES.items()],
        F.min("operating_mode").alias("operating_mode_sample"), F.count(F.lit(1)).alias("samples"),
    )


def merge_rollup(partials: DataFrame) -> DataFrame:
    """Partial rollups of all batches to the hourly rollup."""
    return partials.groupBy("bucket", "miner_id").agg(
        *[F.try_divide(F.sum(f"sum_{n}"), F.sum(f"n_{n}")).alias(n) for n in S.ROLLUP_SOURCES],
        F.min("operating_mode_sample").alias("operating_mode_sample"), F.sum("samples").alias("samples"),
    )


def rollup_job(stream: DataFrame, path: str, checkpoint: str, as_of: datetime | None = None, late_days: int = 30) -> None:
    """Hourly rollup as one small partial table per batch, added up when read.

    No state grows with the 30-day lateness and no raw row is read twice. Rows older than the
    lateness, or without a time, never reach the rollup; they are kept aside. Lateness counts from ``as_of``, or
    from the newest time the batch has seen.
    """
    def write(batch: DataFrame, n: int) -> None:
        newest = F.lit(as_of) if as_of else batch.agg(F.max("timestamp")).scalar()
        late = F.col("timestamp") < newest - F.expr(f"INTERVAL {late_days} DAYS")
        tagged = batch.withColumn("_late", F.coalesce(late, F.lit(True)))
        partial_rollup(tagged.filter("not _late")).write.mode("overwrite").parquet(f"{path}/partials/batch={n}")
        tagged.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={n}")

    run_available(stream, write, checkpoint)


# --------------------------------------------------------------------------- scores and alerts
RING = 26  # slots of the lookback store: a window covers at most RING - 1 of them


def keep_lookback(rows: DataFrame, path: str, as_of: datetime, hours: float) -> DataFrame:
    """Add readings to a ring of time slots and return all of the last ``hours`` before ``as_of``.

    A slot holds a 24th of the window. Only the slots of the given rows are rewritten, and a slot
    that is rewritten loses what has expired, so the store never grows beyond RING slots. Of readings with the
    same device and time the one stored first stays, within ``rows`` the one with the smallest id; so a batch
    that comes again changes nothing. Readings outside the window are not kept.
    """
    spark = rows.sparkSession
    width = max(1, int(hours * 3.6e9 / (RING - 2)))
    within = F.col("timestamp").between(F.lit(as_of - timedelta(hours=hours)), F.lit(as_of))
    rows = rows.filter(within).withColumn("slot", F.pmod(F.floor(F.unix_micros("timestamp") / width), F.lit(RING)).cast("int"))
    schema = StructType([*[f for f in rows.schema.fields if f.name != "slot"], rows.schema["slot"]])
    stored = table_or_empty(spark, path, schema).filter(within)
    same = stored.join(F.broadcast(rows.select("slot").distinct()), "slot", "left_semi")  # at most RING rows
    both = same.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    content = materialize(latest_per_key(both, KEY, [F.col("_new"), *_by_id(rows)]).drop("_new"), "stream-lookback")
    content.hint("rebalance", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)
    return table_or_empty(spark, path, schema).filter(within).drop("slot")


def score_job(
    stream: DataFrame, path: str, checkpoint: str, as_of: datetime, lookback_hours: float, score: Callable[[DataFrame], DataFrame] = scoring.risk_heuristic,
    version: str = "v1", peers: bool = False,
) -> None:
    """Rescore the devices of each batch over their stored lookback and merge the result into the prediction table.

    ``score`` gets all readings of the lookback, those of earlier batches included, so windows do not end at
    the border of a batch. With ``peers`` it gets, and rescores, every device of the lookback: a model whose
    features compare devices needs that. The table holds one row per device and version, that of its newest
    reading, so a reading that arrives late does not replace it; each batch writes its next state.
    """
    fields = "miner_id string, model_version string, predicted_at timestamp, reading_at timestamp, risk_score double, risk_band string, predicted_failure boolean"

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        schema = spark.createDataFrame([], fields).schema
        history = keep_lookback(batch, f"{path}/lookback", as_of, lookback_hours)
        if not peers:
            history = null_safe_join(history, batch.select("miner_id").distinct(), ["miner_id"], "left_semi")
        fresh = score(history).select(
            "miner_id", F.lit(version).alias("model_version"), F.lit(as_of).alias("predicted_at"), F.col("timestamp").alias("reading_at"),
            "risk_score", "risk_band", "predicted_failure")
        before = table_or_empty(spark, f"{path}/{(n - 1) % 3}", schema) if n else spark.createDataFrame([], schema)
        both = before.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
        newest = latest_per_key(both, ["miner_id", "model_version"], [F.col("reading_at").desc_nulls_last(), F.col("_new").desc()])
        newest.drop("_new").write.mode("overwrite").parquet(f"{path}/{n % 3}")
        spark.createDataFrame([(n % 3,)], "slot int").coalesce(1).write.mode("overwrite").json(f"{path}/current")

    run_available(stream, write, checkpoint)


def current_predictions(spark: SparkSession, path: str) -> DataFrame:
    slot = spark.read.json(f"{path}/current").first()["slot"]
    return spark.read.parquet(f"{path}/{slot}")


def recent_alerts(spark: SparkSession, path: str, schema: StructType, since: datetime) -> DataFrame:
    """Stored alerts of the day of ``since`` and later ones; folders of other days are not read."""
    stored = table_or_empty(spark, path, StructType([*schema.fields]).add("created_date", "date").add("batch", "integer"))
    return stored.filter(F.col("created_date") >= F.lit(since.date()))


def alert_job(stream: DataFrame, path: str, checkpoint: str, as_of: datetime, cooldown_hours: float = 1, threshold: float = 0.55, control_mode: str = "advisory") -> None:
    """Alerts for risky devices, at most one unresolved alert per device and cooldown.

    The cooldown is an anti join with the stored alerts, so resolving an alert lifts it. Alerts lie in folders
    by day of creation, and a batch reads only the days that the cooldown reaches.
    """
    fields = "created_at timestamp, miner_id string, severity string, risk_score double, trigger_reason string, message string, recommended_action string, automation_triggered boolean, resolved boolean"

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        schema = StructType(spark.createDataFrame([], fields).schema.fields)
        earlier = recent_alerts(spark, path, schema, as_of - timedelta(hours=cooldown_hours)).filter(
            (F.col("created_date") < F.lit(as_of.date())) | (F.col("batch") != n))  # not those of this batch, when it comes again
        new = alert_generate(scoring.risk_heuristic(batch), earlier, as_of, threshold, cooldown_hours, control_mode)
        new.withColumn("resolved", F.lit(False)).write.mode("overwrite").parquet(f"{path}/created_date={as_of.date()}/batch={n}")

    run_available(stream, write, checkpoint)
