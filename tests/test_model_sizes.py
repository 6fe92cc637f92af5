"""The registered model queries ask for the operators' own models; nothing is fitted here."""

import pytest

from rigsense.plans import training
from rigsense.queries import load


QUERIES, _ = load()


class Asked(Exception):
    pass


def asked(spark, sf_dir, monkeypatch, name):
    """The first tree model, or the models to compare, that a query hands to training."""
    def stop(*args, **kw):
        raise Asked(args[1] if len(args) > 1 else kw.get("models"))

    target = "fit" if name in ("train_rf", "train_gbt", "feature_importance") else "train_and_compare"
    monkeypatch.setattr(training, target, stop)
    with pytest.raises(Asked) as got:
        QUERIES[name](spark, sf_dir)
    return got.value.args[0]


@pytest.mark.parametrize("name", ["train_rf", "feature_importance"])
def test_forest_size(spark, sf_dir, monkeypatch, name):
    model = asked(spark, sf_dir, monkeypatch, name)
    assert (model.getNumTrees(), model.getMaxDepth()) == (300, 12)


def test_boosting_size(spark, sf_dir, monkeypatch):
    model = asked(spark, sf_dir, monkeypatch, "train_gbt")
    assert (model.getMaxIter(), model.getMaxDepth()) == (400, 8)


@pytest.mark.parametrize("name", ["model_select", "retrain_job", "score_model"])
def test_all_models_are_compared(spark, sf_dir, monkeypatch, name):
    assert asked(spark, sf_dir, monkeypatch, name) is None  # None: the three of default_models
