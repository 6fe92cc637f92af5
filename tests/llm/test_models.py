"""Trained operators: gradients, accuracy on rows the fit has not seen, and defined results for odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rigsense.llm import language_id, mil, quality_mil, toxicity
from rigsense.llm.base import crc_remainder


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language_id.fit_network(["abcabc", "xyzxyz"], ["a", "b"], steps=0)
    windows = np.array([[97, 98, 120, 121], [122, 97, language_id.PAD, language_id.PAD]], np.intp)
    target = np.array([0, 1])

    def loss(n):
        prob = language_id.run_network(n, windows)
        live = windows.T != language_id.PAD
        return -np.log(prob[:, np.arange(2), target])[live].mean()

    for k, (weight, slope) in enumerate(zip([net.inputs, net.recur, net.out, net.bias], language_id._gradients(net, windows, target))):
        flat, where = weight.reshape(-1), np.argsort(-np.abs(slope).reshape(-1))[:4]
        for i in [*where, *rng.integers(0, flat.size, 2)]:
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss(net)
            flat[i] = old - step
            down = loss(net)
            flat[i] = old
            assert abs((up - down) / (2 * step) - slope.reshape(-1)[i]) < 2e-3, k


def test_language_held_out(spark, documents, odd_documents, empty_documents):
    net = language_id.learn(documents, crc_remainder(F.col("doc_id"), 4) != 2)
    held = language_id.predict(documents, net).filter(crc_remainder(F.col("doc_id"), 4) == 2)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    found = language_id.predict(odd_documents.withColumn("score", F.lit("old")), net)
    rows = found.collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language_id.predict(empty_documents, net).count() == 0
    none = language_id.learn(documents, F.lit(False))
    assert {r["lang_pred"] for r in language_id.predict(odd_documents, none).collect()} == {"und"}
    text = "La été une " * 40
    assert len(language_id.label_bytes(net, text)) == len(text.encode())
    one = language_id.pooled(net, *language_id.text_bytes(pa.array([text])))[0]
    assert net.labels[int(one.argmax())] == max(set(language_id.label_bytes(net, text)), key=language_id.label_bytes(net, text).count)


def test_every_language_is_fitted(spark):
    """150 languages, the rarest with one row: all are labels of the network and in a sample of bounded size."""
    rows = [(i, chr(0x4E00 + i % 150) * 40, f"l{i % 150:03d}") for i in range(3000)] + [(5000, "\u0531" * 40, "rare"), (None, "\u0562" * 40, "keyless"), (None, "\u0562" * 9, "keyless")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.learn(docs, F.lit(True))
    assert net.labels == sorted({r[2] for r in rows})


def test_a_rare_language_is_found(spark, monkeypatch):
    """With more languages than share the full sample, the rarest still gets its own label."""
    monkeypatch.setattr(language_id, "SAMPLE_LABELS", 2)
    words = {"aa": "ababab abab ", "bb": "cdcdcd cdcd ", "rare": "xyxyxy xyxy "}
    rows = [(i, words["aa" if i % 2 else "bb"] * 8, "aa" if i % 2 else "bb") for i in range(400)] + [(1000, words["rare"] * 8, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.predict(docs, language_id.learn(docs, F.lit(True)))
    assert found.filter("lang != lang_pred").count() == 0


def test_quality_held_out(documents, labels, odd_documents, empty_documents):
    weights = quality_mil.learn(documents, labels, crc_remainder(F.col("doc_id"), 5) != 0)
    held = quality_mil.predict(documents, weights).filter(crc_remainder(F.col("doc_id"), 5) == 0).join(labels, "doc_id")
    rates = {r["quality"]: r["p"] for r in held.groupBy("quality").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.35
    rows = quality_mil.predict(odd_documents, weights).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert quality_mil.predict(empty_documents, weights).count() == 0
    spans = quality_mil.attention(weights, "good words here.\n*** $$$ ###")
    assert len(spans) == 2 and sum(w for _, _, w in spans) == pytest.approx(1, abs=1e-5)


def test_quality_gradients():
    texts, label = ["one two three\nfour *** $$$", "five SIX!! seven"], np.array([1, 0], np.float32)
    w = quality_mil.fit(texts, label, rounds=0)
    for k, x in enumerate(w.all()):
        x[...] = np.random.default_rng(k).normal(0, 0.5, x.shape)
    bags = quality_mil._joined([(*quality_mil._bags(pa.array([t])), y) for t, y in zip(texts, label)])

    def loss():
        p = quality_mil.scores(w, pa.array(texts))
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for x, slope in zip(w.all(), quality_mil._gradients(w, *bags)):
        flat = x.reshape(-1)
        for i in np.argsort(-np.abs(slope).reshape(-1))[:4]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - slope.reshape(-1)[i]) < 2e-3


def test_toxicity(spark, odd_documents, empty_documents):
    """The held-out part of a corpus in which toxic texts have one offending sentence."""
    rng = np.random.default_rng(4)
    plain = ["river", "stone", "walks", "green", "under", "night", "table", "paper", "seven", "cloud", "harbour", "winter"]
    texts = []
    for i in range(600):
        parts = [" ".join(rng.choice(plain, 8)) for _ in range(rng.integers(2, 30))]
        if i % 5 == 0:
            parts.insert(int(rng.integers(len(parts))), "you " + str(rng.choice(["nastyword", "VILEONE", "vileother"])) + " person")
        texts.append(". ".join(parts) + ".")
    label = np.array([float(i % 5 == 0) for i in range(600)])
    model = toxicity.fit(texts[:400], label[:400])
    score, spans = toxicity.scores(model, pa.array(texts[400:]))
    assert ((score >= toxicity.THRESHOLD) == (label[400:] > 0)).all()
    for text, places, y in zip(texts[400:], spans, label[400:]):
        found = [text.encode()[a:b].decode() for a, b in zip(places[::2], places[1::2])]
        assert len(found) == int(y) and all("person" in f for f in found)
    rows = toxicity.predict(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
    assert toxicity.predict(empty_documents, model).count() == 0
    assert (toxicity.scores(toxicity.fit([], np.zeros(0)), pa.array(texts[:9]))[0] == 0).all()


def test_toxic_labels_held_out(documents, labels):
    model = toxicity.learn(documents, labels, crc_remainder(F.col("doc_id"), 4) != 2)
    held = toxicity.predict(documents, model).filter(crc_remainder(F.col("doc_id"), 4) == 2).join(labels, "doc_id")
    rates = {r["toxic"]: r["p"] for r in held.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[0] < 0.05 and rates[1] > 0.4


def test_the_sample_is_bounded(documents, labels):
    texts, marks = mil.labelled_sample(documents, labels, "toxic", F.lit(True), rows=20)
    assert len(texts) == len(marks) <= 20
