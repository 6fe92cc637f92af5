"""The pipeline, stage by stage, on texts whose fate is known, and with odd and empty tables."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rigsense.llm import mil
from test_exact import brute_hits, brute_pii, brute_print, brute_roots


@pytest.fixture(scope="module")
def stages(spark, small, odd_documents):
    """The input and the result of every stage."""
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd_documents.filter("doc_id > 3").withColumn("doc_id", F.col("doc_id") + 100_000))
    out = [docs.collect()]
    for _, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, small), "test-pipeline")
        out.append(docs.collect())
    return out


def test_stages(stages, spark, small):
    given, spoken, single, clean, masked, packed = stages
    assert {r["doc_id"] for r in given} - {r["doc_id"] for r in spoken} == {r["doc_id"] for r in given if not any(c.isalpha() for c in r["text"] or "")}
    prints = {r: brute_print(r["text"]) for r in spoken}
    roots = brute_roots(set(prints.values()))
    least = {}
    for r, p in prints.items():
        least[roots[p]] = min(r["doc_id"], least.get(roots[p], r["doc_id"]))
    assert sorted(r["doc_id"] for r in single) == sorted(least.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single if brute_hits(r["text"], items)[1] == 0}
    assert {r["doc_id"] for r in masked} == {r["doc_id"] for r in clean}
    before = {r["doc_id"]: r["text"] for r in clean}
    for r in masked:
        assert not [s for s in brute_pii(r["text"]) if s[0] != "card"] and r["n_chars"] == len(r["text"])
        if not any(c.isdigit() or c == "@" for c in before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in masked}


def test_empty(spark, small, empty_documents):
    docs = empty_documents
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, small)
        assert docs.count() == 0


def test_run_packs_what_the_stages_leave(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, small), "test-pipeline")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    places, pieces = defaultdict(list), set()
    for r in corpus_pipeline.run(spark, small).collect():
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(own) == r["length"] and r["start"] == 2048 * r["piece"] and zlib.crc32(np.asarray(own, "<u4").tobytes()) == r["ids_crc32"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces.add((r["doc_id"], r["piece"]))
    assert pieces == {(k, i) for k, v in ids.items() for i in range(-(-len(v) // 2048))}
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048


def test_no_known_language(spark, small, small_documents):
    docs = small_documents.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, docs, small)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}


def test_a_missing_language_is_filled(spark, small, small_documents):
    docs = small_documents.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, small).collect()}
    want = {r["doc_id"]: r["lang"] for r in small_documents.collect()}
    filled = [k for k in got if k % 7 == 0]
    assert all(got[k] for k in got) and sum(got[k] == want[k] for k in filled) > 0.9 * len(filled)
    assert all(got[k] == want[k] for k in got if k % 7)


def test_columns_of_clashing_names_come_through(spark, small, small_documents):
    mine = {"_row": F.lit(7), "score": F.lit(0.5), "n_words": F.lit("mine"), "lang_pred": F.lit("x"), "_cut": F.lit(1)}
    docs = small_documents.withColumns(mine)
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, small)
    assert {tuple(r) for r in docs.select(*mine).collect()} == {(7, 0.5, "mine", "x", 1)} and docs.columns == [*small_documents.columns, *mine]


def test_long_texts_are_sampled_by_a_piece(spark):
    docs = spark.createDataFrame([(i, "long text " * 5000 if i % 2 else "short") for i in range(10)] + [(10, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    texts, marks = mil.labelled_sample(docs, labels, "toxic", F.lit(True), rows=10)
    assert len(texts) == 10 and sorted(marks) == [0] * 5 + [1] * 5 and max(map(len, texts)) == mil.SAMPLE_CHARS
