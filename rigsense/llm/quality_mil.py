"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages: lines, cut after ``PASSAGE_WORDS`` words. A passage is encoded as the tanh
of the mean embedding of its words, where a word has two embeddings, one by a hash of its bytes and one
by the kinds of characters in it and whether it repeats the word before. Gated attention, w . (tanh(V e) * sigmoid(U e)), weighs the passages,
and the weighted sum is scored by a logistic unit. All weights are learned together from document labels
by gradient descent in numpy, on a bounded sample of labelled rows.

Defined results: a null text or one without words has no passage and gets the score of an empty bag.
Without labelled rows every score is 0.5. Equal texts get equal scores. An empty table gives an empty
result; columns named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from rigsense.llm.base import WHITE, map_texts, word_hashes
from rigsense.llm.mil import Bags, labelled_sample

PASSAGE_WORDS = 64
WORD_SLOTS = 1 << 13
KIND_SLOTS = 1 << 10
WIDTH = 12  # of the passage encoding
ATTENTION = 8  # hidden units of the attention
THRESHOLD = 0.3
_BREAK = np.zeros(256, bool)
_BREAK[10] = True
_CHARS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "#$%&*", "|", "<>", "\"'", "()[]{}", "/\\", "@_^~+=-"]
_KIND = np.full(256, 1 << len(_CHARS), np.uint16)
for _i, _set in enumerate(_CHARS):
    _KIND[[ord(c) for c in _set]] = 1 << _i


@dataclass
class Weights:
    words: np.ndarray
    tanh_in: np.ndarray
    gate_in: np.ndarray
    attend: np.ndarray
    score: np.ndarray
    bias: np.ndarray

    def all(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def _bags(texts: pa.Array) -> tuple[Bags, np.ndarray]:
    """The bags and, per word, the two rows of the embedding table."""
    bags = Bags(texts, ~WHITE, _BREAK, PASSAGE_WORDS)
    if bags.starts.size == 0:
        return bags, np.empty((0, 2), np.int64)
    whole = word_hashes(bags.data, bags.starts, bags.ends)
    word = whole >> np.uint64(64 - 13)
    again = np.zeros(whole.size, bool)
    again[1:] = (whole[1:] == whole[:-1]) & (bags.owner[1:] == bags.owner[:-1])
    ends = np.empty(2 * bags.starts.size, np.int64)
    ends[::2], ends[1::2] = bags.starts, bags.ends
    if ends[-1] == bags.data.size:
        ends = ends[:-1]
    kind = np.bitwise_or.reduceat(_KIND[bags.data], ends)[::2].astype(np.int64)
    kind += again * (2 << len(_CHARS))
    return bags, np.stack([word.astype(np.int64), WORD_SLOTS + (kind * 2654435761 % (1 << 32) >> 22)], axis=1)


def _per_text(bags: Bags, values: np.ndarray) -> np.ndarray:
    """Sum of passage values for each text that has passages."""
    return np.add.reduceat(values, bags.text_first, axis=0)


def _forward(w: Weights, bags: Bags, rows: np.ndarray):
    summed = np.add.reduceat(w.words[rows[:, 0]] + w.words[rows[:, 1]], bags.part_first, axis=0)
    code = np.tanh(summed / bags.words_in[:, None])
    wide, gate = np.tanh(code @ w.tanh_in), 1 / (1 + np.exp(-np.clip(code @ w.gate_in, -30, 30)))
    raw = (wide * gate) @ w.attend
    per = np.diff(np.append(bags.text_first, bags.part_first.size))
    raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, bags.text_first), per))
    weight = raw / np.repeat(_per_text(bags, raw), per)
    bag = _per_text(bags, code * weight[:, None])
    return code, wide, gate, weight, bag, per


def scores(w: Weights, texts: pa.Array) -> np.ndarray:
    bags, rows = _bags(texts)
    logit = np.full(bags.size, w.bias[0], np.float64)
    if len(rows):
        logit[bags.text_owner] += _forward(w, bags, rows)[4] @ w.score
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def attention(w: Weights, text: str) -> list[tuple[int, int, float]]:
    """Byte span and attention weight of each passage of one text."""
    bags, rows = _bags(pa.array([text]))
    if not len(rows):
        return []
    weight = _forward(w, bags, rows)[3]
    last = np.append(bags.part_first[1:], bags.starts.size) - 1
    return [(int(bags.starts[a]), int(bags.ends[b]), float(x)) for a, b, x in zip(bags.part_first, last, weight)]


def _gradients(w: Weights, bags: Bags, rows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    code, wide, gate, weight, bag, per = _forward(w, bags, rows)
    logit = bag @ w.score + w.bias[0]
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[bags.text_owner]) / max(1, len(bag))
    d_bag = error[:, None] * w.score
    spread = np.repeat(d_bag, per, axis=0)
    d_weight = (spread * code).sum(1)
    d_raw = weight * (d_weight - np.repeat(_per_text(bags, weight * d_weight), per))
    d_both = d_raw[:, None] * w.attend
    d_wide, d_gate = d_both * gate * (1 - wide**2), d_both * wide * gate * (1 - gate)
    d_code = (spread * weight[:, None] + d_wide @ w.tanh_in.T + d_gate @ w.gate_in.T) * (1 - code**2) / bags.words_in[:, None]
    d_words = np.zeros_like(w.words)
    each = np.repeat(d_code, bags.words_in, axis=0)
    for column in rows.T:
        order = np.argsort(column, kind="stable")
        first = np.flatnonzero(np.diff(column[order], prepend=-1))
        d_words[column[order][first]] += np.add.reduceat(each[order], first, axis=0)
    return [d_words, code.T @ d_wide, code.T @ d_gate, (wide * gate).T @ d_raw, bag.T @ error, np.array([error.sum()])]


def fit(texts: list[str], labels: np.ndarray, rounds: int | None = None, batch: int = 64, seed: int = 3) -> Weights:
    """Train on texts and their 0/1 labels; the same input gives the same weights."""
    rng = np.random.default_rng(seed)
    w = Weights(*[x.astype(np.float32) for x in (
        rng.normal(0, 0.1, (WORD_SLOTS + KIND_SLOTS, WIDTH)), rng.normal(0, 0.3, (WIDTH, ATTENTION)), rng.normal(0, 0.3, (WIDTH, ATTENTION)),
        rng.normal(0, 0.3, ATTENTION), rng.normal(0, 0.3, WIDTH), np.zeros(1),
    )])
    made = [(*_bags(pa.array([t])), y) for t, y in zip(texts, labels) if t]
    made = [x for x in made if len(x[1])]
    if rounds is None:  # a small sample is gone through more often
        rounds = max(6, -(-300 * batch // max(1, len(made))))
    first, second, step = [np.zeros_like(x) for x in w.all()], [np.zeros_like(x) for x in w.all()], 0
    for _ in range(rounds if made else 0):
        order = rng.permutation(len(made))
        for lo in range(0, len(order), batch):
            chosen = [made[i] for i in order[lo:lo + batch]]
            step += 1
            for x, g, m, v in zip(w.all(), _gradients(w, *_joined(chosen)), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def _joined(chosen: list) -> tuple[Bags, np.ndarray, np.ndarray]:
    """Several one-text bags as one."""
    out = Bags.__new__(Bags)
    sizes = [x[0].starts.size for x in chosen]
    shift = np.cumsum([0, *sizes[:-1]])
    parts = [x[0].part_first.size for x in chosen]
    out.size = len(chosen)
    out.part_first = np.concatenate([x[0].part_first + s for x, s in zip(chosen, shift)])
    out.words_in = np.concatenate([x[0].words_in for x in chosen])
    out.part_owner = np.repeat(np.arange(len(chosen)), parts)
    out.text_first = np.cumsum([0, *parts[:-1]])
    out.text_owner = np.arange(len(chosen))
    return out, np.concatenate([x[1] for x in chosen]), np.array([x[2] for x in chosen], np.float32)


def learn(documents: DataFrame, labels: DataFrame, fold: Column, label: str = "quality", text: str = "text", key: str = "doc_id") -> Weights:
    """Fit on the bounded sample of ``mil.labelled_sample``."""
    return fit(*labelled_sample(documents, labels, label, fold, text, key))


def predict(documents: DataFrame, weights: Weights, text: str = "text") -> DataFrame:
    """``documents`` with score and predicted."""
    share = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> list:
        score = scores(share.value, batch.column(batch.schema.get_field_index(text)))
        return [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]

    return map_texts(documents, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text)
