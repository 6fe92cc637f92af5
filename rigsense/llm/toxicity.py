"""Toxicity by multiple-instance learning with noisy-or.

A text is a bag of sentences. A sentence is toxic with probability sigmoid(bias + sum of the weights of
its different features); a document is toxic unless no sentence is: 1 - prod(1 - p). Features are words
and beginnings of words, known by 64-bit hashes; one that the fit has not kept counts nothing. Weights
are learned from document labels by gradient descent in numpy, on a bounded sample: first, features
are kept that occur in at least ``MIN_TEXTS`` toxic texts and make a text much likelier to be toxic,
then their weights are fitted, with a penalty on their size.

Defined results: a null text or one without words has no sentence and score 0. Without toxic labelled
rows every score is 0. Equal texts get equal scores. An empty table gives an empty result; columns named
like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from rigsense.llm.base import byte_hashes, list_of, map_texts
from rigsense.llm.decontamination import IS_WORD, LOWER
from rigsense.llm.mil import Bags, labelled_sample

SENTENCE_WORDS = 64  # a longer sentence is cut
SAMPLE_ROWS = 8000  # labelled documents that a fit reads
BEGINNINGS = range(4, 11)  # bytes
MIN_TEXTS = 4  # toxic texts that a feature must occur in
LIFT = 4.0  # how much likelier a feature must make the toxic label
THRESHOLD = 0.3
LOCATED = 0.3  # probability from which a sentence is reported
SLOTS = 1 << 22  # of the table that first counts features
_STEP = 200  # texts that a fit takes apart at once
_BREAK = np.zeros(256, bool)
_BREAK[[10, 33, 46, 63]] = True  # line feed ! . ?
_LETTER = IS_WORD[LOWER]


@dataclass
class Lexicon:
    hashes: np.ndarray  # in ascending order
    weights: np.ndarray
    bias: float
    sieve: np.ndarray | None = None  # which values of the hashes' upper 20 bits occur

    def __post_init__(self):
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True


def _bags(texts: pa.Array) -> Bags:
    bags = Bags(texts, _LETTER, _BREAK, SENTENCE_WORDS)
    bags.data = LOWER[bags.data]
    return bags


def _features(bags: Bags) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and their feature hashes, one kind of feature after the other: whole words, then beginnings."""
    hashes = byte_hashes(bags.data)
    every = np.arange(bags.starts.size)
    yield every, hashes.of(bags.starts, bags.ends)
    for n in BEGINNINGS:
        long = every[bags.ends - bags.starts >= n]
        yield long, ~hashes.of(bags.starts[long], bags.starts[long] + n)


class _Sentences:
    """Sentences of a batch, and the features in each that the lexicon knows, counted once."""

    def __init__(self, texts: pa.Array, model: Lexicon):
        self.bags = bags = _bags(texts)
        part = np.repeat(np.arange(bags.part_first.size), bags.words_in)
        pairs = [np.empty(0, np.int64)]
        for word, found in _features(bags) if model.hashes.size else ():
            maybe = model.sieve[(found >> np.uint64(44)).astype(np.int64)]
            word, found = word[maybe], found[maybe]
            place = np.minimum(np.searchsorted(model.hashes, found), model.hashes.size - 1)
            known = model.hashes[place] == found
            pairs.append(part[word[known]] * model.hashes.size + place[known])
        self.part, self.word = np.divmod(np.unique(np.concatenate(pairs)), max(1, model.hashes.size))

        self.owner, self.size = bags.part_owner, bags.size

    def log_clean(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each sentence, and the log of each text's chance that no sentence is toxic."""
        logit = bias + np.bincount(self.part, weights[self.word], self.owner.size)
        prob = 1 / (1 + np.exp(-np.clip(logit, -40, 30)))
        return prob, np.bincount(self.owner, np.log1p(-np.minimum(prob, 1 - 1e-9)), self.size)


class _Sample(_Sentences):
    """The sentences of all texts of a sample, taken apart some texts at a time; without their bags."""

    def __init__(self, texts: list[str], model: Lexicon):
        parts, words, owners, before = [], [], [], 0
        for lo in range(0, len(texts), _STEP):
            some = _Sentences(pa.array(texts[lo:lo + _STEP], pa.string()), model)
            parts.append(some.part + before)
            words.append(some.word)
            owners.append(some.owner + lo)
            before += some.owner.size
        self.part, self.word, self.owner = (np.concatenate(x) for x in (parts, words, owners))
        self.size = len(texts)


def _per_text(texts: list[str], rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and hashes of the different features of each of the given texts, some texts at a time."""
    for lo in range(0, rows.size, _STEP):
        bags = _bags(pa.array([texts[i] for i in rows[lo:lo + _STEP]], pa.string()))
        for word, found in _features(bags):
            order = np.lexsort((found, bags.owner[word]))
            owner, found = bags.owner[word][order], found[order]
            new = np.ones(found.size, bool)
            new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
            yield rows[owner[new] + lo], found[new]


def _screen(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Hashes of the features worth a weight: counted in toxic texts in slots, then exactly, then in the others."""
    toxic = labels > 0

    def telling(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
        rate = (no + 0.5) / max(1, (~toxic).sum())
        return (yes >= MIN_TEXTS) & (yes / max(1, toxic.sum()) >= LIFT * rate)

    slot = lambda found: (found >> np.uint64(42)).astype(np.int64)
    counts = np.zeros(SLOTS, np.int64)
    for _, found in _per_text(texts, np.flatnonzero(toxic)):
        counts += np.bincount(slot(found), minlength=SLOTS)
    busy = counts >= MIN_TEXTS
    kept = [np.empty(0, np.uint64)]
    for _, found in _per_text(texts, np.flatnonzero(toxic)):
        kept.append(found[busy[slot(found)]])
    hashes, yes = np.unique(np.concatenate(kept), return_counts=True)
    many = yes >= MIN_TEXTS
    hashes, yes = hashes[many], yes[many]
    no = np.zeros(hashes.size, np.int64)
    for _, found in _per_text(texts, np.flatnonzero(~toxic)) if hashes.size else ():
        place = np.minimum(np.searchsorted(hashes, found), hashes.size - 1)
        no += np.bincount(place[hashes[place] == found], minlength=hashes.size)
    return hashes[telling(yes, no)]


def fit(texts: list[str], labels: np.ndarray, steps: int = 300, rate: float = 0.1, shrink: float = 0.002) -> Lexicon:
    """Train on texts and their 0/1 labels; the same input gives the same lexicon."""
    none = Lexicon(np.empty(0, np.uint64), np.empty(0), -40.0)
    hashes = _screen(texts, labels) if len(texts) else none.hashes
    if not hashes.size:
        return none
    sentences = _Sample(texts, Lexicon(hashes, np.zeros(hashes.size), 0))
    weights, bias = np.zeros(hashes.size), -6.0
    first, second = np.zeros(hashes.size + 1), np.zeros(hashes.size + 1)
    owner = sentences.owner
    for step in range(1, steps + 1):
        prob, log_clean = sentences.log_clean(weights, bias)
        # The slope by a sentence's logit is its probability times this: 1 for a clean text, below 0 for a toxic one.
        pull = np.where(labels > 0, 1 - 1 / np.maximum(-np.expm1(log_clean), 1e-6), 1.0)
        at = prob * pull[owner] / labels.size
        slope = np.append(np.bincount(sentences.word, at[sentences.part], hashes.size), at.sum())
        first += 0.1 * (slope - first)
        second += 0.01 * (slope * slope - second)
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        bias -= float(move[-1])
        weights = (weights - move[:-1]) * (1 - rate * shrink)
    return Lexicon(hashes, weights, bias)


def scores(model: Lexicon, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
    """Score of each text, and per text the byte spans of sentences with at least LOCATED, as flat start-end lists."""
    if not model.hashes.size:
        return np.zeros(len(texts)), [[] for _ in range(len(texts))]
    sentences = _Sentences(texts, model)
    prob, log_clean = sentences.log_clean(model.weights, model.bias)
    bags = sentences.bags
    spans: list[list[int]] = [[] for _ in range(bags.size)]
    last = np.append(bags.part_first[1:], bags.starts.size) - 1
    for k in np.flatnonzero(prob >= LOCATED):
        at = bags.offsets[bags.part_owner[k]]
        spans[bags.part_owner[k]] += [int(bags.starts[bags.part_first[k]] - at), int(bags.ends[last[k]] - at)]
    return -np.expm1(log_clean), spans


def learn(documents: DataFrame, labels: DataFrame, fold: Column, label: str = "toxic", text: str = "text", key: str = "doc_id") -> Lexicon:
    """Fit on the bounded sample of ``mil.labelled_sample``."""
    return fit(*labelled_sample(documents, labels, label, fold, text, key, SAMPLE_ROWS))


def predict(documents: DataFrame, model: Lexicon, text: str = "text") -> DataFrame:
    """``documents`` with score, predicted and toxic_spans (byte spans of offending sentences, a flat start-end list)."""
    share = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        score, spans = scores(share.value, batch.column(batch.schema.get_field_index(text)))
        flat = list_of(pa.array([x for row in spans for x in row], pa.int64()), np.array([len(row) for row in spans]))
        return [pa.array(np.clip(score, 0, 1)), pa.array((score >= THRESHOLD).astype(np.int32)), flat]

    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_spans", T.ArrayType(T.LongType()))]
    return map_texts(documents, run, new, text)
