"""Boosted trees: the two ways to grow a node give one tree, and the model learns, scores and is stored."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rigsense.plans import boosting


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("double")
    df = e.select(F.col("value").alias("a"), k.alias("b"), (F.col("event_id") % 7).cast("double").alias("c"))
    df = df.withColumn("label", ((F.col("a") > 60) != (F.col("b") > 40)).cast("double")).withColumn("weight", F.lit(1.0) + F.col("label"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def trees(model):
    import json

    return json.loads(model.getOrDefault(model.model))["trees"]


def test_large_and_small_nodes_make_the_same_trees(rows, monkeypatch):
    make = lambda: boosting.HistogramBoosting(4, 4, 0.3, weight="weight").fit(rows)
    small = make()
    monkeypatch.setattr(boosting, "STAGED_ROUNDS", 2)
    for limit in (0, 200):  # every node by sums; large ones by sums and the rest in one task each
        monkeypatch.setattr(boosting, "IN_TASK", limit)
        for one, other in zip(trees(small), trees(make())):
            assert one["node"] == other["node"] and one["feature"] == other["feature"] and one["limit"] == other["limit"]
            assert np.allclose(one["value"], other["value"])


def test_it_learns_and_is_stored(spark, rows, tmp_path):
    model = Pipeline(stages=[boosting.HistogramBoosting(20, 3, 0.3)]).fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    p = F.get(vector_to_array("probability"), F.lit(1))
    scored = again.transform(rows).select("label", p.alias("p"))
    right = scored.agg(F.avg(((F.col("p") > 0.5).cast("double") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.95
    assert rows.count() == scored.filter("p between 0 and 1").count()
    gain = model.stages[-1].featureImportances.toArray()
    assert gain.sum() == pytest.approx(1) and gain[2] < gain[0] and gain[2] < gain[1]


def test_a_branch_adds_up_the_smaller_children_only(monkeypatch):
    rng = np.random.default_rng(3)
    bins = rng.integers(0, boosting.BINS, (4000, 5)).astype(np.uint8)
    y = ((bins[:, 0] > 30) != (bins[:, 3] > 40)).astype(float)
    g, h = boosting._slopes(y, np.ones(4000), np.zeros(4000))
    added, direct = [], boosting.sums

    def counted(columns, node, *rest):
        added.append(len(node))
        return direct(columns, node, *rest)

    monkeypatch.setattr(boosting, "sums", counted)
    tree, features = boosting.Tree(6), np.array([0, 1, 3, 4])
    leaf = tree.grow(0, bins.T[features], g, h, features, 0.3)
    assert sum(added) <= 4000 * (1 + 5 / 2)  # the root, then at most half of the rows a level, none for the last
    assert (leaf == tree.descend(bins)).all()
    for node in np.unique(leaf):  # values come from differences of sums, yet are exact
        own = leaf == node
        assert tree.value[node] == -0.3 * g[own].sum() / (h[own].sum() + boosting.LAMBDA)


def test_tasks_that_share_the_rows_make_the_same_trees(rows, monkeypatch):
    make = lambda: boosting.HistogramBoosting(5, 4, 0.3, weight="weight").fit(rows)
    alone = make()
    monkeypatch.setattr(boosting, "IN_TASK", 0)
    monkeypatch.setattr(boosting, "SHARE", 150, raising=False)

    def a_job_per_level(*args):
        raise AssertionError("more rows than one task holds took jobs for every tree")

    monkeypatch.setattr(boosting.HistogramBoosting, "_round", a_job_per_level)
    assert trees(alone) == trees(make())


def test_features_added_up_in_pairs():
    rng = np.random.default_rng(4)
    columns = rng.integers(0, boosting.BINS, (5, 20_000)).astype(np.uint8)
    node, g = rng.integers(0, 2, 20_000), rng.integers(-9, 9, 20_000).astype(float)
    total = boosting.sums(columns, node, g, g ** 2, 2)
    for k, values in enumerate((g, g ** 2)):
        for f, column in enumerate(columns):
            for n in range(2):
                assert (total[k, n, f] == np.bincount(column[node == n], values[node == n], boosting.BINS)).all()
