"""Texts as bags of parts for multiple-instance learning: word spans, parts, and a bounded labelled sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigsense.llm.base import first_of_runs, text_bytes, word_spans

SAMPLE_ROWS = 3000  # labelled documents that a fit reads
SAMPLE_CHARS = 20_000  # of a longer text the fit reads so many characters, from a place drawn by hash


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, fold: Column, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS,
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``rows`` labelled documents in the fold, the first by a hash of the key.

    Only keys that have a text are drawn, and only a bounded list of keys meets the texts.
    """
    known = labels.filter(fold & F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("label")).distinct()
    known = known.join(documents.filter(F.col(text).isNotNull()).select(key).distinct(), key, "left_semi")
    drawn = known.withColumn("at", F.xxhash64(key)).orderBy("at", key, "label").limit(rows)
    room = F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0))
    piece = F.substring(F.col(text), (F.pmod(F.xxhash64(F.lit(1), key), room + 1) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    texts = documents.select(key, piece.alias("text")).filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(drawn), key).select("at", "label", "text").orderBy("at", "label", "text").limit(rows).collect()
    return [r["text"] for r in found], np.array([r["label"] for r in found], np.float32)


class Bags:
    """Word spans of a batch of texts and the part that each word belongs to."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray, is_break: np.ndarray, limit: int):
        self.data, self.offsets = text_bytes(texts)
        self.size = len(texts)
        self.starts, self.ends, self.owner = word_spans(self.data, self.offsets, is_word)
        breaks = np.concatenate([[0], np.cumsum(is_break[self.data])])
        line = breaks[self.starts]
        change = np.zeros(self.starts.size, bool)
        change[1:] = (line[1:] != line[:-1]) | (self.owner[1:] != self.owner[:-1])
        change[:1] = True
        head = np.flatnonzero(change)
        nth = np.arange(self.starts.size) - np.repeat(head, np.diff(np.append(head, self.starts.size)))
        self.part_first = np.flatnonzero(nth % limit == 0)  # first word of each part
        self.part_owner = self.owner[self.part_first]
        self.words_in = np.diff(np.append(self.part_first, self.starts.size))
        self.text_first = first_of_runs(self.part_owner)  # first part of each text that has one
        self.text_owner = self.part_owner[self.text_first]
