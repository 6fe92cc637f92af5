"""Several micro-batches must give what one batch run over all rows gives."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rigsense.operators import kpi
from rigsense.operators.alerts import alert_generate
from rigsense.operators.analytics import hourly_rollup
from rigsense.sources import views
from rigsense.streaming import jobs


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The events in three files by time, written oldest first."""
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    for part in range(3):
        day = F.dayofmonth("ts")
        rows = e.filter((day > part * 10) & ((day <= part * 10 + 10) | F.lit(part == 2)))
        rows.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = jobs.read_folder(spark, folder, schema, files_per_batch=1)
    return views.mode_normalize(views.telemetry_from(events))


def rows(df):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_kpi_windows_reach_over_batches(spark, folder, sf_dir, tmp_path):
    jobs.kpi_job(stream(spark, folder, sf_dir), str(tmp_path), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "kpi"))
    assert len(list((tmp_path / "untimed").glob("batch=*"))) == 3  # a folder per batch
    cols = ["miner_id", "timestamp", "power_instability_index", "true_efficiency_te"]
    assert rows(got.select(*cols)) == rows(kpi.kpi_rows(views.clean(spark, sf_dir)).select(*cols))


def test_partial_rollups_add_up(spark, folder, sf_dir, tmp_path):
    jobs.rollup_job(views.as_kpi(stream(spark, folder, sf_dir)), str(tmp_path), str(tmp_path / "ck"), views.AS_OF, late_days=90)
    got = jobs.merge_rollup(spark.read.parquet(str(tmp_path / "partials")))
    assert rows(got) == rows(hourly_rollup(views.kpi(spark, sf_dir)))
    assert spark.read.parquet(str(tmp_path / "late")).isEmpty()


def test_windowed_rollup_in_state(spark, folder, sf_dir, tmp_path):
    query = (jobs.windowed_rollup(views.as_kpi(stream(spark, folder, sf_dir))).writeStream.format("memory").queryName("windowed")
             .outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows(spark.table("windowed")) == rows(hourly_rollup(views.kpi(spark, sf_dir)))


def test_ingest_again_changes_nothing(spark, folder, sf_dir, tmp_path):
    for run in (1, 2):
        s = stream(spark, folder, sf_dir).select("id", "miner_id", "timestamp", "asic_power_w")
        jobs.ingest(s, str(tmp_path / "t"), str(tmp_path / f"ck{run}"))
    got = spark.read.parquet(str(tmp_path / "t")).select("id")
    assert rows(got) == rows(views.telemetry(spark, sf_dir).select("id"))


def test_scores_keep_one_row_per_device(spark, folder, sf_dir, tmp_path):
    jobs.score_job(views.as_kpi(stream(spark, folder, sf_dir)), str(tmp_path), str(tmp_path / "ck"), views.AS_OF, 24 * 40)
    got = jobs.current_predictions(spark, str(tmp_path))
    devices = views.telemetry(spark, sf_dir).select("miner_id").distinct().count()
    assert got.count() == got.select("miner_id").distinct().count() == devices


def test_alert_cooldown_over_batches(spark, folder, sf_dir, tmp_path):
    jobs.alert_job(views.as_kpi(stream(spark, folder, sf_dir)), str(tmp_path / "a"), str(tmp_path / "ck"), views.AS_OF, threshold=0.2)
    got = spark.read.parquet(str(tmp_path / "a"))
    assert got.count() == got.select("miner_id").distinct().count() > 0
    open_alerts = got.withColumn("resolved", F.lit(False))
    from rigsense.operators.scoring import risk_heuristic

    scored = risk_heuristic(views.kpi(spark, sf_dir))
    known = got.select("miner_id").distinct()
    again = alert_generate(scored.join(known, "miner_id"), open_alerts, views.AS_OF + timedelta(minutes=30), 0.2, 1)
    assert again.isEmpty()
    assert not alert_generate(scored, open_alerts.withColumn("resolved", F.lit(True)), views.AS_OF, 0.2, 1).isEmpty()


@pytest.fixture(scope="module")
def newest_first(spark, sf_dir, tmp_path_factory):
    """The events in three files, newest first, and the newest file a second time."""
    path = str(tmp_path_factory.mktemp("late"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.dayofmonth("ts")
    for lo, hi in ((20, 40), (10, 20), (0, 10), (20, 40)):
        e.filter((day > lo) & (day <= hi)).coalesce(1).write.mode("append").parquet(path)
    return path


def test_late_and_repeated_files_lose_and_double_nothing(spark, newest_first, sf_dir, tmp_path):
    s = stream(spark, newest_first, sf_dir)
    jobs.ingest(s.select("id", "miner_id", "timestamp", "asic_power_w"), str(tmp_path / "t"), str(tmp_path / "ck1"))
    assert rows(spark.read.parquet(str(tmp_path / "t")).select("id")) == rows(views.telemetry(spark, sf_dir).select("id"))
    jobs.kpi_job(s, str(tmp_path / "k"), str(tmp_path / "ck2"))
    got = spark.read.parquet(str(tmp_path / "k" / "kpi"))
    assert got.count() == got.select("miner_id", "timestamp").distinct().count() == views.telemetry(spark, sf_dir).count()


def test_an_older_reading_keeps_the_newer_score(spark, newest_first, sf_dir, tmp_path):
    jobs.score_job(views.as_kpi(stream(spark, newest_first, sf_dir)), str(tmp_path), str(tmp_path / "ck"), views.AS_OF, 24 * 40)
    got = jobs.current_predictions(spark, str(tmp_path)).groupBy("miner_id").agg(F.max("reading_at").alias("t"))
    newest = views.telemetry(spark, sf_dir).filter(F.col("timestamp") <= F.lit(views.AS_OF)).groupBy("miner_id").agg(F.max("timestamp").alias("t"))
    assert rows(got) == rows(newest)


def test_late_readings_repair_their_neighbours(spark, newest_first, sf_dir, tmp_path):
    jobs.kpi_job(stream(spark, newest_first, sf_dir), str(tmp_path / "k"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "k" / "kpi")).select("miner_id", "timestamp", "power_instability_index", "efficiency_j_per_th")
    from rigsense.operators.kpi import kpi_rows

    want = kpi_rows(views.mode_normalize(views.telemetry(spark, sf_dir))).select("miner_id", "timestamp", "power_instability_index", "efficiency_j_per_th")
    assert rows(got) == rows(want)


def test_rows_without_a_time_are_put_aside(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.createDataFrame([(1, "a", None, 1.0), (2, "a", None, 2.0)], "id long, miner_id string, timestamp timestamp, asic_power_w double")
    df.coalesce(1).write.parquet(src)
    df.coalesce(1).write.mode("append").parquet(src)
    jobs.ingest(jobs.read_folder(spark, src, df.schema, files_per_batch=1), str(tmp_path / "t"), str(tmp_path / "ck"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t-untimed")).collect()) == [1, 1, 2, 2]


def _window_score(rows):
    """A score that needs each device's earlier readings."""
    from pyspark.sql import Window

    from rigsense.operators.scale import latest_per_key

    run = Window.partitionBy("miner_id").orderBy("timestamp").rowsBetween(-12, 0)
    scored = rows.withColumns({
        "risk_score": F.round(F.avg("asic_temperature_c").over(run) / 200, 9), "risk_band": F.lit("low"), "predicted_failure": F.lit(False)})
    return latest_per_key(scored, ["miner_id"], [F.col("timestamp").desc()])


def test_scores_over_several_files_equal_the_batch(spark, newest_first, sf_dir, tmp_path):
    hours = 24 * 20
    jobs.score_job(views.as_kpi(stream(spark, newest_first, sf_dir)), str(tmp_path), str(tmp_path / "ck"), views.AS_OF, hours, _window_score)
    got = jobs.current_predictions(spark, str(tmp_path)).select("miner_id", "reading_at", "risk_score")
    recent = views.telemetry(spark, sf_dir).filter(F.col("timestamp").between(F.lit(views.AS_OF - timedelta(hours=hours)), F.lit(views.AS_OF)))
    want = _window_score(recent).select("miner_id", F.col("timestamp").alias("reading_at"), "risk_score")
    assert rows(got) == rows(want)


def test_a_stored_model_scores_the_stream_like_the_table(spark, sf_dir, tmp_path):
    from rigsense.plans import training as tr
    from rigsense.operators.features import feature_set

    kpi, hours = views.kpi(spark, sf_dir), 24 * 20
    feats = feature_set(kpi).withColumn(tr.S.TARGET, F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    weights = {"weight_neg": 1.0, "weight_pos": 1.0, "scale_pos_weight": 1.0}
    model = tr.fit(tr.with_weights(feats, weights), tr.logistic(100.0))
    model.write().overwrite().save(str(tmp_path / "m" / "model"))
    spark.createDataFrame([(0.24, ",".join(tr.S.NUMERIC_FEATURES))], "cooling_power_ratio double, feature_columns string").coalesce(1).write.json(str(tmp_path / "m" / "meta"))
    score = lambda d: tr.score_model(d, views.AS_OF, str(tmp_path / "m"), hours)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for late in (False, True):  # two files, the newer days first
        events.filter((F.dayofmonth("ts") < 21) == late).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    source = views.as_kpi(stream(spark, str(tmp_path / "src"), sf_dir))
    jobs.score_job(source, str(tmp_path / "s"), str(tmp_path / "ck"), views.AS_OF, hours, score, peers=True)
    got = {r["miner_id"]: r["risk_score"] for r in jobs.current_predictions(spark, str(tmp_path / "s")).collect()}
    # The same rows as one table: medians of KPI columns made per batch differ, so read what the stream stored.
    stored = spark.read.parquet(str(tmp_path / "s" / "lookback")).drop("slot")
    want = {r["miner_id"]: r["risk_score"] for r in score(stored).collect()}
    assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-9 for m in want) and len(set(want.values())) > 3


def test_lookback_store_expires_and_takes_repeats(spark, tmp_path):
    start, path = datetime(2024, 1, 1), str(tmp_path / "l")
    make = lambda hs: spark.createDataFrame([(i, d, start + timedelta(hours=h), float(h)) for i, h in enumerate(hs) for d in ("a", None)], "id int, miner_id string, timestamp timestamp, v double")
    for day in range(4):
        hs = [24 * day + h for h in (20, 3, 3, 11)]
        for _ in (1, 2):  # each batch comes twice
            got = jobs.keep_lookback(make([*hs, 24 * day - 30]), path, start + timedelta(hours=24 * (day + 1)), 24)
            assert sorted((r["miner_id"] or "", r["v"]) for r in got.collect()) == sorted((d, float(h)) for h in set(hs) for d in ("a", ""))
    assert spark.read.parquet(path).select("slot").distinct().count() <= jobs.RING and spark.read.parquet(path).count() <= 4 * 6
    none = spark.createDataFrame([], "id int, miner_id string, timestamp timestamp, v double")
    assert jobs.keep_lookback(none, str(tmp_path / "none"), start, 24).isEmpty()


def test_a_batch_reads_only_alert_days_of_the_cooldown(spark, tmp_path):
    from pyspark.sql.types import StructType

    fields = StructType().add("created_at", "timestamp").add("miner_id", "string")
    for day in (1, 2, 3):
        at = datetime(2024, 1, day, 12)
        spark.createDataFrame([(at, "a")], fields).write.parquet(str(tmp_path / f"created_date={at.date()}" / "batch=0"))
    got = jobs.recent_alerts(spark, str(tmp_path), fields, datetime(2024, 1, 3, 1))
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 1 and "created_date" in scan.split("PartitionFilters: [")[1].split("]")[0]
