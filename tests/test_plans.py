"""The physical plans are the intended ones."""

import pytest
from pyspark.sql import functions as F

from rigsense.operators import analytics, features, fleet, kpi, tables
from rigsense.operators.scale import work_dir
from rigsense.sources import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]


def test_all_device_windows_share_one_shuffle(spark, sf_dir):
    p = plan(features.temporal_features(features.ensure_inputs(views.kpi(spark, sf_dir))))
    assert p.count("Exchange hashpartitioning(miner_id") == 1 and p.count("Exchange") == 1


def test_peers_do_not_shuffle_the_rows(spark, sf_dir):
    df = features.peer_features(features.ensure_inputs(views.kpi(spark, sf_dir)))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert p.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in p


def test_latest_row_is_limited_before_the_shuffle(spark, sf_dir):
    assert plan(fleet.newest(views.kpi(spark, sf_dir))).count("WindowGroupLimit") == 2


def test_top_n_does_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(analytics.anomaly_zscore(views.kpi(spark, sf_dir)))


def test_incremental_kpi_is_an_anti_join(spark, sf_dir):
    p = plan(kpi.kpi_incremental(views.clean(spark, sf_dir), views.kpi(spark, sf_dir)))
    assert "LeftAnti" in p


def test_unused_columns_are_not_read(spark, sf_dir):
    p = plan(analytics.time_window(views.kpi(spark, sf_dir), views.AS_OF, hours=24).select("miner_id", "timestamp"))
    schema = p.split("ReadSchema: ")[1]
    assert "props" not in schema and "value" not in schema


@pytest.fixture(scope="module")
def dated(spark, sf_dir):
    path = work_dir(spark, "dated")
    tables.write_by_date(views.telemetry(spark, sf_dir).select("id", "miner_id", "timestamp", "asic_power_w"), path)
    return path


def test_time_predicates_reach_the_scan_and_the_folders(spark, dated):
    p = plan(analytics.time_window(tables.read_by_date(spark, dated), views.AS_OF, hours=48, date_column="event_date"))
    assert "event_date" in p.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in p.split("PushedFilters: [")[1]


def test_append_absent_reads_only_the_days_of_the_batch(spark, dated):
    day = tables.read_by_date(spark, dated).filter("event_date = date'2024-01-05'").drop("event_date")
    more = day.limit(1).withColumns({"miner_id": F.lit("new"), "id": F.lit(-1).cast("long")})
    before = tables.read_by_date(spark, dated).count()
    tables.append_absent(day.unionByName(more), dated, order=["id"])
    assert tables.read_by_date(spark, dated).count() == before + 1
