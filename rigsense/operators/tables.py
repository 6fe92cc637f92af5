"""Keyed writes as DataFrame algebra, and their file-based counterparts.

The functions return the new content of a table. ``append_absent`` and ``overwrite_dates``
apply it to date-partitioned Parquet, touching only the partitions concerned.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigsense.operators.quality import KEY, clean_upload, dropped_counts
from rigsense.operators.scale import attach_row, latest_per_key
from rigsense import schema as S


def absent_rows(batch: DataFrame, target: DataFrame, keys: Sequence[str] = tuple(KEY), order: Sequence[str] = ()) -> DataFrame:
    """Rows of the batch whose key is new: the first of each key that the target lacks."""
    keys = list(keys)
    first = latest_per_key(batch, keys, [F.col(o).asc() for o in order] or [F.lit(1)])
    return first.join(target.select(*keys), keys, "left_anti")


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str] = tuple(KEY), order: Sequence[str] = ()) -> DataFrame:
    return target.unionByName(absent_rows(batch, target, keys, order), allowMissingColumns=True)


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Batch rows replace target rows of the same key; within the batch the last one wins.

    Only keys meet in the join, so no row of the target is compared more than once.
    """
    keys = list(keys)
    last = latest_per_key(batch, keys, [F.col(o).desc() for o in order] or [F.lit(1)])
    kept = target.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.select(*[c for c in last.columns if c in target.columns]), allowMissingColumns=True)


def upsert_columns(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Like ``upsert``, but an existing row keeps its other columns, such as its id."""
    keys = list(keys)
    last = latest_per_key(batch, keys, [F.col(o).desc() for o in order] or [F.lit(1)])
    new = last.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    merged = target.join(new, keys, "full_outer")
    return merged.select(*[
        (F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
        for c in target.columns
    ])


def replace_by_keys(target: DataFrame, batch: DataFrame, key: str, fixed: dict[str, object]) -> DataFrame:
    """Drop the target rows of the batch's keys that carry the fixed values, then add the batch.

    Blank keys delete nothing; duplicate batch rows are all kept.
    """
    ids = batch.select(F.trim(key).alias(key)).filter(F.col(key) != "").distinct()
    marked = target
    same = F.lit(True)
    for c, v in fixed.items():
        same = same & F.coalesce(F.col(c) == F.lit(v), F.lit(False))
    doomed = ids.withColumn("_doomed", F.lit(True))
    kept = marked.join(doomed, key, "left").filter(~(F.coalesce("_doomed", F.lit(False)) & same))
    return kept.select(*target.columns).unionByName(batch, allowMissingColumns=True)


def keep_newest_id(df: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    return latest_per_key(df, list(keys), [F.col("id").desc()])


def keep_latest_predictions(df: DataFrame) -> DataFrame:
    """A missing model version counts as 'v1'; the newest prediction of each device stays."""
    versioned = df.withColumn("model_version", F.coalesce("model_version", F.lit("v1")))
    return latest_per_key(
        versioned, ["miner_id", "model_version"], [F.col("predicted_at").desc(), F.col("id").desc()])


def retention(df: DataFrame, as_of: datetime, days: int = 180, time: str = "timestamp", date_column: str | None = None) -> DataFrame:
    """Rows young enough to keep. With a date partition column, old folders are not even listed."""
    edge = as_of - timedelta(days=days)
    out = df.filter(F.col(time) >= F.lit(edge))
    return out.filter(F.col(date_column) >= F.lit(edge.date())) if date_column else out


def ingest_result(raw: DataFrame, target: DataFrame, ordinal: Sequence[str], list_devices: bool = False) -> DataFrame:
    """What a load would do: rows received and inserted, devices found, rows dropped.

    ``list_devices`` names the devices in one array; it is for uploads within the row limit of
    ``upload_guard``. Larger loads get their number here and the names from ``ingest_devices``.
    """
    clean = clean_upload(raw, ordinal)
    new = absent_rows(clean, target, order=ordinal)
    names = F.array_sort(F.collect_set("miner_id")) if list_devices else F.count_distinct("miner_id")
    parts = [
        new.agg(F.count(F.lit(1)).alias("rows_inserted")),
        clean.agg(names.alias("miners_found"), F.count(F.lit(1)).alias("rows_clean")),
        dropped_counts(raw),
    ]
    out = raw.agg(F.count(F.lit(1)).alias("rows_received"))
    for extra in parts:
        joined, row = attach_row(out, extra)
        out = joined.select(*out.columns, *[row[c].alias(c) for c in extra.columns])
    bad, lost = F.col("bad_timestamps"), F.col("missing_ids")
    errors = F.array_compact(F.array(
        F.when(bad > 0, F.format_string("Dropped %d rows with unparseable timestamps", bad)),
        F.when(lost > 0, F.format_string("Dropped %d rows with missing miner_id", lost)),
        F.when(F.col("rows_clean") == 0, F.lit("No valid rows to insert")),
    ))
    return out.select("rows_received", "rows_inserted", "miners_found", errors.alias("errors"))


def ingest_devices(raw: DataFrame, target: DataFrame, ordinal: Sequence[str]) -> DataFrame:
    """Rows kept and inserted per device, for loads too large for one device list."""
    clean = clean_upload(raw, ordinal)
    known = target.select(*KEY).distinct().withColumn("_known", F.lit(True))
    return clean.join(known, KEY, "left").groupBy("miner_id").agg(
        F.count(F.lit(1)).alias("rows_clean"),
        F.count(F.when(F.col("_known").isNull(), F.lit(1))).alias("rows_inserted"))


def upload_guard(df: DataFrame, max_bytes: int = S.MAX_UPLOAD_BYTES, max_rows: int = S.MAX_UPLOAD_ROWS, total_bytes: int | None = None) -> DataFrame:
    """Verdict on an upload: its size, its rows and whether it is accepted.

    ``total_bytes`` is the size of its files; without it only the rows are checked.
    """
    size = F.lit(total_bytes).cast("long")
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    verdict = (
        F.when(size > max_bytes, F.lit("too_many_bytes"))
        .when(F.col("n_rows") > max_rows, F.lit("too_many_rows")).otherwise(F.lit("accepted")))
    return rows.select(size.alias("n_bytes"), "n_rows", verdict.alias("verdict"))


# --------------------------------------------------------------------------- files
def write_by_date(df: DataFrame, path: str, time: str = "timestamp", mode: str = "append") -> None:
    """Append or overwrite a table partitioned by event date.

    Rebalancing by date gives few files per day, and adaptive execution cuts a heavy day into
    as many tasks as its size asks for.
    """
    dated = df.withColumn("event_date", F.to_date(time))
    writer = dated.hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date")
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_by_date(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def append_absent(batch: DataFrame, path: str, keys: Sequence[str] = tuple(KEY), order: Sequence[str] = (), time: str = "timestamp") -> None:
    """Insert-if-absent into a date-partitioned table. Only the dates of the batch are read."""
    spark = batch.sparkSession
    dated = batch.withColumn("event_date", F.to_date(time))
    target = read_by_date(spark, path)
    days = dated.select("event_date").distinct()
    scoped = target.join(F.broadcast(days), "event_date", "left_semi")  # one row per day
    write_by_date(absent_rows(batch, scoped, keys, order), path, time)
