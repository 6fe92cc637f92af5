"""Every query with an SQL counterpart gives the same values in DuckDB, on the smallest tables."""

import pytest

from compare import compare, connect
from rigsense.queries import load

QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, sf_dir, name):
    problem, _ = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
    assert problem is None, problem


def test_names_are_unique_and_oracles_have_queries():
    assert set(ORACLE) <= set(QUERIES)


LARGE = ["impute_ffill_bfill_median", "recompute_hashrate_deviation", "kpi_power_instability", "feature_set",
         "future_failure_label", "anomaly_multi_signal", "tradeoff_summary", "pr_curve", "time_split_fallback"]


@pytest.mark.parametrize("name", LARGE)
def test_routes_for_large_input(spark, con, sf_dir, name, monkeypatch):
    """The same values when every device is cut into blocks."""
    from rigsense.operators import features, scale

    monkeypatch.setattr(scale, "fits_one_task", lambda df: False)
    monkeypatch.setattr(features, "fits_one_task", lambda df: False)
    monkeypatch.setattr(scale, "BLOCK_ROWS", 25)
    problem, _ = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
    assert problem is None, problem
