"""Forests on binned rows: dealing trees to tasks changes nothing, and the model learns, scores and is stored."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rigsense.plans import forest


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).selectExpr(
        "id", "CAST(id * 7919 % 101 AS DOUBLE) AS a", "CAST(id * 104729 % 97 AS DOUBLE) AS b", "CAST(id % 7 AS DOUBLE) AS c")
    df = df.withColumn("label", ((F.col("a") > 60) != (F.col("b") > 40)).cast("double")).withColumn("weight", F.lit(1.0) + F.col("label"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def probabilities(model, rows):
    p = F.get(vector_to_array("probability"), F.lit(1))
    return {r["id"]: (r["label"], r["p"]) for r in model.transform(rows).select("id", "label", p.alias("p")).collect()}


def test_trees_do_not_depend_on_their_task(rows, monkeypatch):
    make = lambda: probabilities(forest.HistogramForest(7, 5, 3, weight="weight").fit(rows), rows)
    many = make()
    monkeypatch.setattr(forest, "COPIES", 1)
    assert many == make()


def test_it_learns_and_is_stored(rows, tmp_path):
    model = Pipeline(stages=[forest.HistogramForest(20, 6, weight="weight")]).fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    scored = probabilities(PipelineModel.load(str(tmp_path / "m")), rows)
    assert len(scored) == 3000 and np.mean([(p > 0.5) == label for label, p in scored.values()]) > 0.95
    gain = model.stages[-1].featureImportances.toArray()
    assert gain.sum() == pytest.approx(1) and gain[2] < gain[0] and gain[2] < gain[1]


def test_leaves_are_shares_of_enough_rows():
    rng = np.random.default_rng(1)
    bins, w = rng.integers(0, 32, (2000, 4)).astype(np.uint8), rng.random(2000) + 0.5
    y = (bins[:, 1] > 20).astype(np.uint8)
    feature, cut, value, gain = forest.grow(bins, y, w, np.random.default_rng(5), 4, 30)
    count = np.random.default_rng(5).poisson(1.0, 2000)
    leaf = forest.descend(bins, feature, cut, 4)
    for node in np.unique(leaf[count > 0]):
        own, weight = leaf == node, count * w
        assert count[own].sum() >= 30 and value[node] == pytest.approx((weight * y)[own].sum() / weight[own].sum())
    assert gain.argmax() == 1
    for node in np.flatnonzero(feature[:15] >= 0):  # no two sibling leaves of one class
        left, right = 2 * node + 1, 2 * node + 2
        assert feature[left] >= 0 or feature[right] >= 0 or (value[left] > 0.5) != (value[right] > 0.5)


def test_more_rows_than_a_task_holds(rows, monkeypatch):
    monkeypatch.setattr(forest, "IN_TASK", 100)
    model = forest.HistogramForest(3, 4, weight="weight").fit(rows)
    assert isinstance(model, RandomForestClassificationModel) and model.getNumTrees == 3


def test_classes_counted_in_one_sum_make_the_same_tree(monkeypatch):
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 32, (200_000, 9)).astype(np.uint8)
    y = (bins[:, 1].astype(int) + bins[:, 4] + rng.integers(0, 9, 200_000) > 35).astype(np.uint8)
    w = np.where(y == 1, 2.0, 0.5)  # sums of these are exact either way
    make = lambda: forest.grow(bins, y, w, np.random.default_rng(5), 7, 5)
    monkeypatch.setattr(forest, "LEAST_COUNTED", 0)
    one = make()
    for name in ("PAIRED", "MOST_COUNTED"):  # features one by one; three sums instead of one
        monkeypatch.setattr(forest, name, 0)
        for a, b in zip(one, make()):
            assert (a == b).all()


def test_tasks_map_one_file_of_the_rows(rows, monkeypatch):
    make = lambda: probabilities(forest.HistogramForest(7, 5, 3, weight="weight").fit(rows.repartition(5, "id")), rows)
    copied, mapped = [], make()
    monkeypatch.setattr(forest, "shared_folder", lambda *args: copied.append(args))
    assert make() == mapped and copied


def test_a_table_of_six_gigabytes_is_grown_here():
    assert forest.IN_TASK >= 36_000_000
