"""Random forests on binned features, grown tree by tree instead of level by level over all trees.

Features are cut once into at most ``BINS`` bins. A row then takes one byte a feature, so a task reads the binned
rows whole, and every task grows its share of the trees without any exchange: tasks map one file of the rows, or
where the folder for written tables is not in a file system, the rows travel once per task. Tree ``k`` is drawn from (seed, k) over the rows in their order, so the
forest does not depend on how trees are dealt to tasks. Beyond ``IN_TASK`` rows the forest of ``pyspark.ml``
with the same settings takes over, which needs no task with all rows.

As there: Poisson bootstrap, the square root of the features drawn per node, weighted Gini gain, a least number of
drawn rows per child, sibling leaves of one class merged, mean leaf shares as probability, importances normalised
per tree.
"""

from __future__ import annotations

import base64
import io
import json
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigsense.operators.scale import materialize
from rigsense.plans.boosting import cuts, into_bins, shared_folder

BINS = 32
IN_TASK = 40_000_000  # rows that one task reads: some 45 bytes each in a file of all tasks, and 30 of its own for the tree in hand
COPIED = 6_000_000  # the same, where tasks cannot map one file
COPIES = 24  # most tasks that hold the rows
CHUNK = 1 << 17  # rows whose sums are added at once
PAIRED = 64  # nodes up to which two features are added up at once
SECOND = float(1 << 26)  # a drawing of the second class, where both classes are counted in one sum
LEAST_COUNTED = 2_000_000  # rows up to which sums of the weights are rounded one by one, which decides between equal splits
MOST_COUNTED = 60_000_000  # rows whose drawings stay below SECOND
_BLOCK = "first long, y binary, w binary, bins binary"
_TREE = "tree int, node binary, feature binary, cut binary, value binary, gain binary"


def grow(
    bins: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, depth: int, leaf: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree over its own bootstrap: feature (-1: none), last bin to the left, share of label 1, and gain by feature."""
    n, width = bins.shape
    size, kept = 2 ** (depth + 1) - 1, max(1, math.ceil(math.sqrt(width)))
    feature, cut, value, gain_at = np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size), np.zeros(size)
    flat = bins.reshape(-1)
    count = rng.poisson(1.0, n).astype(np.uint8)
    rows = np.flatnonzero(count).astype(np.uint32)
    drawings, ones, weight = count[rows], y[rows] == 1, w[rows]
    del count
    per_class = [np.unique(weight[side]) for side in (~ones, ones)]
    counted = LEAST_COUNTED < n <= MOST_COUNTED and max(c.size for c in per_class) <= 1
    if counted:  # drawings of both classes are counted in one sum
        light, heavy = (float(c[0]) if c.size else 0.0 for c in per_class)
        stats = [drawings.astype(np.float32) * np.where(ones, np.float32(SECOND), np.float32(1))]

        def sums(of: np.ndarray) -> np.ndarray:
            second, first = np.divmod(of[0], SECOND)
            return np.stack([first + second, first * light + second * heavy, second * heavy])
    else:
        stats = [drawings.astype(float)]
        stats.append(stats[0] * weight)
        stats.append(stats[1] * ones)

        def sums(of: np.ndarray) -> np.ndarray:
            return of
    del drawings, ones, weight
    node, ids = np.zeros(rows.size, np.uint16), np.array([0])
    while rows.size:
        all_w, all_p = sums(np.stack([np.bincount(node, v, ids.size) for v in stats]))[1:]
        value[ids] = all_p / np.maximum(all_w, 1e-300)
        if ids[0] >= size // 2:
            break
        drawn = np.asfortranarray(np.sort(np.argsort(rng.random((ids.size, width)), 1)[:, :kept], 1))
        paired = kept // 2 * 2 if counted and ids.size <= PAIRED and rows.size > ids.size * BINS * BINS else 0
        total = np.zeros((len(stats), kept, ids.size * BINS))
        pairs = np.zeros((len(stats), paired // 2, ids.size * BINS * BINS))
        for lo in range(0, rows.size, chunk := max(CHUNK, 2 * total.shape[2])):
            part = slice(lo, lo + chunk)
            at, start, own = node[part].astype(np.int64), rows[part].astype(np.int64) * width, [v[part].astype(float) for v in stats]
            column = [flat.take(start + d.take(at, mode="clip"), mode="clip") for d in drawn.T]  # in bounds: clip spares the check
            if paired:
                base = at * (BINS * BINS)
                for j in range(0, paired, 2):  # the bins of two features are one number, whose sums are then added up by either
                    key = base + (column[j].astype(np.uint16) * np.uint16(BINS) + column[j + 1])
                    for k, v in enumerate(own):
                        pairs[k, j // 2] += np.bincount(key, v, pairs.shape[2])
            if paired < kept:
                base = at * BINS
            for j in range(paired, kept):
                key = base + column[j]
                for k, v in enumerate(own):
                    total[k, j] += np.bincount(key, v, total.shape[2])
        if paired:
            pairs = pairs.reshape(len(stats), paired // 2, ids.size, BINS, BINS)
            total[:, 0:paired:2], total[:, 1:paired:2] = (pairs.sum(axis).reshape(len(stats), paired // 2, -1) for axis in (4, 3))
        total = sums(total)
        left = np.cumsum(total.reshape(3, kept, ids.size, BINS), 3)
        right = left[..., -1:] - left

        def impure(s: np.ndarray) -> np.ndarray:
            return 2 * s[2] * (s[1] - s[2]) / np.maximum(s[1], 1e-300)

        gain = impure(left[..., -1:]) - impure(left) - impure(right)
        gain[(left[0] < leaf) | (right[0] < leaf)] = 0
        gain = gain.transpose(1, 0, 2).reshape(ids.size, -1)
        best = gain.argmax(1)
        most = gain[np.arange(ids.size), best]
        split = most > 1e-9 * np.maximum(all_w, 1e-300)
        chosen, last = drawn[np.arange(ids.size), best // BINS], best % BINS
        feature[ids[split]], cut[ids[split]] = chosen[split], last[split]
        gain_at[ids[split]] = most[split]
        live = split[node]
        node, rows, stats = node[live], rows[live], [v[live] for v in stats]
        below, last = (2 * (np.cumsum(split) - 1)).astype(np.uint16), last.astype(np.uint8)
        for lo in range(0, rows.size, CHUNK):
            part = slice(lo, lo + CHUNK)
            at = node[part].astype(np.int64)
            bin_ = flat.take(rows[part].astype(np.int64) * width + chosen.take(at, mode="clip"), mode="clip")
            node[part] = below.take(at, mode="clip") + (bin_ > last.take(at, mode="clip"))
        ids = np.stack([2 * ids[split] + 1, 2 * ids[split] + 2], 1).reshape(-1)
    for level in range(depth - 1, -1, -1):  # sibling leaves of one class become a leaf
        ids = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
        left, right = 2 * ids + 1, 2 * ids + 2
        one = (feature[ids] >= 0) & (feature[left] < 0) & (feature[right] < 0) & ((value[left] > 0.5) == (value[right] > 0.5))
        feature[ids[one]], cut[ids[one]], value[left[one]], value[right[one]] = -1, 0, 0, 0
    inner, gains = feature >= 0, np.zeros(width)
    np.add.at(gains, feature[inner], gain_at[inner])
    return feature, cut, value, gains


def descend(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of every row."""
    flat, rows = bins.reshape(-1), np.arange(len(bins)) * bins.shape[1]
    node = np.zeros(len(bins), np.int64)
    for _ in range(depth):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (flat[rows + np.maximum(f, 0)] > cut[node]), node)
    return node


def _write_rows(raw: DataFrame, folder: str, n: int, edges: list[np.ndarray]) -> Callable[[], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Write labels, weights and bins in the order of the rows into files that all tasks map; returns what maps them."""
    partition = F.shiftright("row", 33)  # the parts of a monotonically increasing id
    counts = sorted(map(tuple, raw.groupBy(partition.alias("p")).count().collect()))
    first = np.zeros(counts[-1][0] + 1, np.int64)
    first[[p for p, _ in counts]] = np.cumsum([0, *[c for _, c in counts]])[:-1]
    shapes = {"y": (np.uint8, (n,)), "w": (np.float64, (n,)), "bins": (np.uint8, (n, len(edges)))}

    def mapped(mode: str = "r") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.memmap(f"{folder}/{name}", kind, mode, shape=shape) for name, (kind, shape) in shapes.items())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, w, bins = mapped("r+")
        for batch in batches:
            if batch.num_rows:
                row = batch.column("row").to_numpy()
                at = first[row >> 33] + (row & (1 << 33) - 1)
                y[at], w[at], bins[at] = batch.column("y").to_numpy(zero_copy_only=False) == 1, batch.column("w").to_numpy(zero_copy_only=False), into_bins(batch, edges)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    os.makedirs(folder, exist_ok=True)
    mapped("w+")
    assert raw.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] == n
    return mapped


class HistogramForest(Estimator):
    """Fits a ``HistogramForestModel`` on a vector, a 0/1 label and a weight column."""

    def __init__(
        self, trees: int = 300, depth: int = 12, leaf: int = 5, seed: int = 42, features: str = "features", label: str = "label",
        weight: str | None = None,
    ):
        super().__init__()
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.features, self.label, self.weight = features, label, weight

    def getNumTrees(self) -> int:
        return self.trees

    def getMaxDepth(self) -> int:
        return self.depth

    def _fit(self, df: DataFrame) -> Model:
        weight = F.col(self.weight) if self.weight else F.lit(1.0)
        raw = materialize(df.select(
            F.monotonically_increasing_id().alias("row"), F.col(self.label).cast("double").alias("y"), weight.cast("double").alias("w"),
            vector_to_array(self.features).alias("x")), "forest-input")
        head = raw.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
        if not head["n"]:
            raise ValueError("no rows to fit")
        folder = shared_folder(df.sparkSession, "forest-rows")
        if head["n"] > min(IN_TASK, IN_TASK if folder else COPIED):
            return self._over_all_tasks(df)
        edges = cuts(raw, head["width"], BINS)
        copies = min(self.trees, COPIES, df.sparkSession.sparkContext.defaultParallelism)
        trees, depth, leaf, seed, width = self.trees, self.depth, self.leaf, self.seed, head["width"]

        def grown(ks: list[int], y: np.ndarray, w: np.ndarray, bins: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in ks:
                feature, cut, value, gain = grow(bins, y, w, np.random.default_rng([seed, k]), depth, leaf)
                ids = np.flatnonzero((value != 0) | (feature >= 0)).astype(np.int32)
                stored = ids, feature[ids], cut[ids], value[ids], gain
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in stored]], names=["tree", "node", "feature", "cut", "value", "gain"])

        if folder:
            held = _write_rows(raw, folder, head["n"], edges)

            def from_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield from grown(batch.column("id").to_pylist(), *held())

            dealt = df.sparkSession.range(0, trees, 1, min(trees, 4 * copies))
            return self._model(dealt.mapInArrow(from_file, _TREE).collect(), edges)

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row")[:1], *[pa.array([v.tobytes()], pa.binary()) for v in ((y == 1).astype(np.uint8), w, into_bins(batch, edges))]],
                        names=["first", "y", "w", "bins"])

        blocks = materialize(raw.mapInArrow(block, _BLOCK), "forest-rows")
        dealt = blocks.withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(copies)]))).repartitionById(copies, F.col("copy"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, kept = set(), {}  # every copy holds the same rows: one of them is kept
            for batch in batches:
                for copy, first, y, w, bins in zip(*[batch.column(c).to_pylist() for c in ("copy", "first", "y", "w", "bins")]):
                    own.add(copy)
                    kept[first] = y, w, bins
            if not own:
                return
            order = sorted(kept)
            y, w, bins = (np.frombuffer(b"".join(kept[k][i] for k in order), kind) for i, kind in enumerate((np.uint8, float, np.uint8)))
            kept.clear()
            yield from grown([k for k in range(trees) if k % copies in own], y, w, bins.reshape(-1, width))

        return self._model(dealt.mapInArrow(run, _TREE).collect(), edges)

    def _model(self, found: list, edges: list[np.ndarray]) -> HistogramForestModel:
        found = sorted(found, key=lambda r: r["tree"])
        gain = np.stack([np.frombuffer(r["gain"]) for r in found])
        gain = (gain / np.maximum(gain.sum(1, keepdims=True), 1e-300)).sum(0)
        ids = [np.frombuffer(r["node"], np.int32) for r in found]
        out = io.BytesIO()
        np.savez_compressed(
            out, sizes=np.array([i.size for i in ids]), node=np.concatenate(ids), feature=np.frombuffer(b"".join(r["feature"] for r in found), np.int16),
            cut=np.frombuffer(b"".join(r["cut"] for r in found), np.uint8), value=np.frombuffer(b"".join(r["value"] for r in found)))
        return HistogramForestModel(model=json.dumps({
            "depth": self.depth, "gain": (gain / gain.sum() if gain.sum() else gain).tolist(), "edges": [e.tolist() for e in edges],
            "trees": base64.b64encode(out.getvalue()).decode()}), features=self.features)

    def _over_all_tasks(self, df: DataFrame) -> Model:
        made = RandomForestClassifier(
            featuresCol=self.features, labelCol=self.label, numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=self.leaf,
            seed=self.seed, maxMemoryInMB=512)
        return (made.setWeightCol(self.weight) if self.weight else made).fit(df)


class HistogramForestModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction``; stored with its pipeline like any other stage."""

    model = Param(Params._dummy(), "model", "the trees as JSON", typeConverter=TypeConverters.toString)
    features = Param(Params._dummy(), "features", "the vector column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str = "", features: str = "features"):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def featureImportances(self) -> DenseVector:  # the name that tree models of pyspark.ml have
        return DenseVector(json.loads(self.getOrDefault(self.model))["gain"])

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.getOrDefault(self.model))

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            stored = json.loads(shared.value)
            held, depth, edges = np.load(io.BytesIO(base64.b64decode(stored["trees"]))), stored["depth"], [np.array(e) for e in stored["edges"]]
            node, feature, cut, value = (held[c] for c in ("node", "feature", "cut", "value"))
            trees, ends = [], np.cumsum(held["sizes"])
            for lo, hi in zip(ends - held["sizes"], ends):
                arrays = np.full(2 ** (depth + 1) - 1, -1, np.int16), np.zeros(2 ** (depth + 1) - 1, np.uint8), np.zeros(2 ** (depth + 1) - 1)
                for array, values in zip(arrays, (feature, cut, value)):
                    array[node[lo:hi]] = values[lo:hi]
                trees.append(arrays)
            for part in parts:
                x = np.stack(part.to_numpy()) if len(part) else np.empty((0, len(edges)))
                bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1).astype(np.uint8)
                total = np.zeros(len(x))
                for f, c, v in trees:
                    total += v[descend(bins, f, c, depth)]
                yield pd.Series(total / len(trees))

        p = score(vector_to_array(self.getOrDefault(self.features)))
        return df.withColumn("_p", p).withColumns({
            "probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": F.when(F.col("_p") > 0.5, 1.0).otherwise(0.0),
        }).drop("_p")
