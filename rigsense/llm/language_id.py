"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as windows of ``WINDOW`` bytes. In each, one gated recurrent layer runs forward and one
backward; both states of a byte give the label probabilities of that position, and a text's
probabilities are the mean over all its bytes. Gates use x / (1 + |x|) for speed. The network is
trained in numpy by backpropagation through time on a bounded sample of labelled rows.

Defined results: a text that is null or has no letter is ``und`` with score 0. Without a single
labelled row every other text is ``und`` with score 0 as well. Repeated rows get equal results, ties
between labels go to the label that sorts first, an empty table gives an empty result, and columns
named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigsense.llm.base import map_texts, new_name, text_bytes

UNKNOWN = "und"
HIDDEN = 8
WINDOW = 128  # bytes that the network sees together
LANES = 1024  # windows per numpy step
SAMPLE_PER_LABEL = 400  # expected labelled rows per language that the fit reads, fewer beyond SAMPLE_LABELS languages
SAMPLE_CHARS = 512  # characters of each that the fit reads, from a place that depends on a hash
SAMPLE_LABELS = 128  # languages from which on they share one bound on the sample
PAD = 256


@dataclass
class Network:
    labels: list[str]
    inputs: np.ndarray  # 3 gates, 2 directions x 257 byte values, hidden
    recur: np.ndarray  # 3 gates, 2 directions, hidden, hidden
    out: np.ndarray  # 2 directions, hidden, labels
    bias: np.ndarray  # labels


def _soft(x: np.ndarray, spare: np.ndarray) -> None:
    """x / (1 + |x|) in place."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare


def run_network(net: Network, windows: np.ndarray, keep: bool = False):
    """Label probabilities of every byte: (steps, windows, labels). ``windows``: (windows, steps), PAD after the end."""
    count, steps = windows.shape
    hidden = net.recur.shape[-1]
    both = np.empty((steps, 2, count), np.intp)
    both[:, 0] = windows.T
    both[:, 1] = both[::-1, 0] + 257
    live = (both % 257 != PAD)[..., None].astype(np.float32)
    whole = bool(live.all())
    states = np.zeros((steps + 1, 2, count, hidden), np.float32)
    spare, z, r, q, n = (np.empty((2, count, hidden), np.float32) for _ in range(5))
    trace = []
    for t in range(steps):
        h, byte = states[t], both[t]
        np.matmul(h, net.recur[0], out=z)
        z += net.inputs[0].take(byte, axis=0)
        _soft(z, spare)
        z *= 0.5
        z += 0.5
        np.matmul(h, net.recur[1], out=r)
        r += net.inputs[1].take(byte, axis=0)
        _soft(r, spare)
        r *= 0.5
        r += 0.5
        np.matmul(h, net.recur[2], out=q)
        np.multiply(r, q, out=n)
        n += net.inputs[2].take(byte, axis=0)
        _soft(n, spare)
        after = states[t + 1]
        np.subtract(h, n, out=after)
        after *= z
        after += n
        if not whole:
            after *= live[t]
        if keep:
            trace.append((z.copy(), r.copy(), q.copy(), n.copy()))
    logits = states[1:, 0] @ net.out[0]
    logits += states[:0:-1, 1] @ net.out[1]
    logits += net.bias
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return (logits, states, both, live, trace) if keep else logits


def _gradients(net: Network, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over all live bytes, by backpropagation through time."""
    prob, states, both, live, trace = run_network(net, windows, keep=True)
    steps, count, _ = prob.shape
    error = prob.copy()
    error[:, np.arange(count), target] -= 1
    error *= live[:, 0]
    error /= max(live[:, 0].sum(), 1)
    d_inputs, d_recur = np.zeros_like(net.inputs), np.zeros_like(net.recur)
    flat = error.reshape(-1, error.shape[-1])
    d_out = np.stack([states[1:, 0].reshape(len(flat), -1).T @ flat, states[:0:-1, 1].reshape(len(flat), -1).T @ flat])
    into = np.stack([error @ net.out[0].T, (error @ net.out[1].T)[::-1]], axis=1)
    carried = np.zeros_like(states[0])
    at_input = np.empty((3, steps, *carried.shape), np.float32)
    turned = net.recur.transpose(0, 1, 3, 2)
    for t in range(steps - 1, -1, -1):
        z, r, q, n = trace[t]
        h = states[t]
        g = (into[t] + carried) * live[t]
        a_n = g * (1 - z) * (1 - np.abs(n)) ** 2
        a_z = g * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        a_r = a_n * q * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_q = a_n * r
        at_input[0, t], at_input[1, t], at_input[2, t] = a_z, a_r, a_n
        turned_h = h.transpose(0, 2, 1)
        d_recur[0] += turned_h @ a_z
        d_recur[1] += turned_h @ a_r
        d_recur[2] += turned_h @ d_q
        carried = g * z + a_z @ turned[0] + a_r @ turned[1] + d_q @ turned[2]
    byte = both.reshape(-1)
    order = np.argsort(byte, kind="stable")
    first = np.flatnonzero(np.diff(byte[order], prepend=-1))
    for gate in range(3):
        d_inputs[gate, byte[order][first]] = np.add.reduceat(at_input[gate].reshape(byte.size, -1)[order], first)
    return [d_inputs, d_recur, d_out, flat.sum(0)]


def fit_network(texts: list[str], labels: list[str], steps: int = 320, batch: int = 128, width: int = 64, seed: int = 7) -> Network:
    """Train on texts and their labels; the same input gives the same network."""
    names = sorted(set(labels))
    number = {name: i for i, name in enumerate(names)}
    pieces: list[list[np.ndarray]] = [[] for _ in names]
    for text, label in zip(texts, labels):
        raw = np.frombuffer(text.encode(), np.uint8)
        for lo in range(0, raw.size, width):
            cut = np.full(width, PAD, np.intp)
            cut[:len(raw[lo:lo + width])] = raw[lo:lo + width]
            pieces[number[label]].append(cut)
    pools = [np.array(p) for p in pieces]
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt(HIDDEN)
    net = Network(
        names, rng.normal(0, 0.5, (3, 514, HIDDEN)).astype(np.float32), rng.normal(0, scale, (3, 2, HIDDEN, HIDDEN)).astype(np.float32),
        rng.normal(0, scale, (2, HIDDEN, len(names))).astype(np.float32), np.zeros(len(names), np.float32),
    )
    weights = [net.inputs, net.recur, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    filled = [i for i, p in enumerate(pools) if len(p)]
    for step in range(1, steps + 1 if filled else 1):
        target = rng.choice(filled, batch)
        windows = np.stack([pools[i][rng.integers(len(pools[i]))] for i in target])
        rate = 0.03 * (1 - step / (steps + 1)) + 0.002
        for w, g, m, v in zip(weights, _gradients(net, windows, target), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean label probabilities of every text; zeros for an empty one."""
    lengths = np.diff(offsets)
    per_text = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(lengths.size), per_text)
    nth = np.arange(owner.size) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = offsets[:-1][owner] + nth * WINDOW
    size = np.minimum(WINDOW, offsets[1:][owner] - start)
    sums = np.zeros((owner.size, len(net.labels)))
    order = np.argsort(-size, kind="stable")
    for lo in range(0, order.size, LANES):
        rows = order[lo:lo + LANES]
        width = int(size[rows[0]])
        place = start[rows][:, None] + np.arange(width)
        dead = np.arange(width) >= size[rows][:, None]
        windows = np.where(dead, PAD, data[np.minimum(place, data.size - 1)])
        prob = run_network(net, windows)
        prob *= ~dead.T[..., None]
        sums[rows] = prob.sum(0)
    total = np.stack([np.bincount(owner, sums[:, k], lengths.size) for k in range(len(net.labels))], axis=1)
    return total / np.maximum(lengths, 1)[:, None]


def label_bytes(net: Network, text: str) -> list[str]:
    """The label of every byte of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out: list[str] = []
    for lo in range(0, raw.size, WINDOW):
        best = run_network(net, raw[None, lo:lo + WINDOW].astype(np.intp))[:, 0].argmax(-1)
        out += [net.labels[k] for k in best]
    return out


def learn(documents: DataFrame, fold: Column, text: str = "text", label: str = "lang", key: str = "doc_id") -> Network:
    """Fit on rows where ``fold`` holds and the label is known, for every label there is.

    The fit reads about SAMPLE_PER_LABEL rows of each language, chosen by a hash of the key, and of
    each SAMPLE_CHARS characters; the driver holds at most twice that for SAMPLE_LABELS languages. If
    there are more, the share of each shrinks, but each keeps the row whose hash is its smallest.
    """
    rows = documents.filter(fold & F.col(label).isNotNull() & F.col(text).isNotNull())
    at = F.xxhash64(key)
    drawn = F.pmod(at, F.lit(1 << 30)) / float(1 << 30)
    lettered = F.when(F.col(text).rlike(r"\p{L}"), drawn)
    counts = rows.groupBy(label).agg(F.count("*").alias("count"), F.coalesce(F.min(lettered), F.min(drawn)).alias("least")).collect()
    if not counts:
        return fit_network([], [])
    each = min(SAMPLE_PER_LABEL, SAMPLE_PER_LABEL * SAMPLE_LABELS / len(counts))
    spec = T.StructType([T.StructField("_label", T.StringType()), T.StructField("_share", T.DoubleType()), T.StructField("_least", T.DoubleType())])
    shares = documents.sparkSession.createDataFrame([(row[label], each / row["count"], row["least"]) for row in counts], spec)
    room = F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0))
    piece = F.substring(F.col(text), (F.pmod(F.xxhash64(F.lit(1), key), room + 1) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    first = (drawn == F.col("_least")).alias("first")
    sample = rows.join(F.broadcast(shares), F.col(label) == F.col("_label")).filter((drawn < F.col("_share")) | (drawn == F.col("_least")))
    found = sample.select(F.col(label).alias("label"), piece.alias("piece"), at.alias("at"), first)
    # Of rows without a key, which have one hash, a label keeps one as its first.
    firsts = found.filter("first").groupBy("label").agg(F.min(F.struct("at", "piece")).alias("p")).select("label", "p.piece", "p.at", F.lit(True).alias("first"))
    others = found.filter("not first").orderBy("at", "label", "piece").limit(int(2 * each * len(counts)))
    picked = sorted(firsts.union(others).collect(), key=lambda r: (r["at"], r["label"], r["piece"]))
    return fit_network([r["piece"] for r in picked], [r["label"] for r in picked])


def predict(documents: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``, the mean probability of that label over all bytes."""
    lettered = new_name("lettered")
    marked = documents.withColumn(lettered, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    share = documents.sparkSession.sparkContext.broadcast(net)

    def score(batch: pa.RecordBatch) -> list:
        net = share.value
        known = np.asarray(batch.column(batch.schema.get_field_index(lettered)).to_pylist(), bool)
        if not net.labels:
            return [pa.array([UNKNOWN] * batch.num_rows), pa.array(np.zeros(batch.num_rows))]
        prob = pooled(net, *text_bytes(batch.column(batch.schema.get_field_index(text))))
        best = prob.argmax(1)
        names = [net.labels[k] if ok else UNKNOWN for k, ok in zip(best, known)]
        return [pa.array(names, pa.string()), pa.array(np.where(known, np.minimum(prob.max(1), 1.0), 0.0))]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(marked, score, fields, text, keep=documents.columns)
