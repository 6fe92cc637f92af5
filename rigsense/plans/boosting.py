"""Gradient boosted trees on binned features.

Features are cut once into at most ``BINS`` bins at sketched quantiles, so a split needs only the sums of
gradients and curvatures per (node, feature, bin). Trees grow level by level. A node with more than
``IN_TASK`` rows is split by sums over all tasks: each task adds up its rows, Spark adds the tasks, and the
driver sees one row per (node, feature, bin) whatever the number of rows. A smaller node goes to one task
with its rows, which grows the whole branch below it by the same rule, so a level costs a job only where it
holds large nodes. Where all rows together are no more than that, the root is such a node in every round,
and a job grows the trees of ``ROUNDS_A_JOB`` rounds.

More rows than ``SHARE`` are dealt to the tasks that can run at once, where these hold them: one barrier stage
grows all trees, its tasks keep their rows from round to round and add up their sums level by level through
files. Beyond ``TOGETHER`` rows a task, or where no barrier stage can run, the jobs above do it. Sums are exact
in any order, so which way a node goes changes no split.

Loss is logistic, splits maximise the second-order gain, leaves are Newton steps times the rate. Rows and
features of a round are drawn by hash and seed, so a repeated task makes the same tree.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigsense.operators.scale import materialize, work_dir

BINS = 64
IN_TASK = 2_000_000  # rows that one task holds: some 100 bytes each
SHARE = 100_000  # rows for which a further task pays
TOGETHER = 4_000_000  # rows that each of the tasks of a barrier stage holds: some 150 bytes each
PAIRED = 16  # nodes up to which two features are added up at once
ROUNDS_A_JOB = 400  # a further job starts by adding up the trees before it
STAGED_ROUNDS = 10  # rounds after which the margins of a large table are written anew
STEPS = float(1 << 26)
LAMBDA = 1.0  # added to the curvature of a leaf
MIN_CURVATURE = 1.0  # of a child
_ROWS = "row long, y double, w double, margin double, bins binary"


# ------------------------------------------------------------------------- one tree, in numpy
def sums(columns: Sequence[np.ndarray], node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int) -> np.ndarray:
    """Gradients and curvatures per (node, feature, bin)."""
    out = np.zeros((2, nodes, len(columns), BINS))
    paired = len(columns) // 2 * 2 if nodes <= PAIRED and len(node) > nodes * BINS * BINS else 0
    base = node.astype(np.int64) * (BINS * BINS)
    for f in range(0, paired, 2):  # the bins of two features are one number, whose sums are then added up by either
        at = base + (columns[f].astype(np.uint16) * np.uint16(BINS) + columns[f + 1])
        for k, values in enumerate((g, h)):
            both = np.bincount(at, values, nodes * BINS * BINS).reshape(nodes, BINS, BINS)
            out[k, :, f], out[k, :, f + 1] = both.sum(2), both.sum(1)
    if paired < len(columns):
        base = node.astype(np.int64) * BINS
    for f in range(paired, len(columns)):
        at = base + columns[f]
        for k, values in enumerate((g, h)):
            out[k, :, f] = np.bincount(at, values, nodes * BINS).reshape(nodes, BINS)
    return out


def best_splits(total: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, ...]:
    """Feature, last bin to the left and gain of the best split of each node; feature -1 where none helps."""
    g, h = np.cumsum(total, axis=3)
    all_g, all_h = g[:, :, -1:], h[:, :, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g ** 2 / (h + LAMBDA) + (all_g - g) ** 2 / (all_h - h + LAMBDA) - all_g ** 2 / (all_h + LAMBDA)
    gain[(h < MIN_CURVATURE) | (all_h - h < MIN_CURVATURE)] = 0
    flat = np.round(gain.reshape(len(gain), -1), 9)  # sums in another order do not change a tie
    at = flat.argmax(1)
    best = flat[np.arange(len(flat)), at]
    chosen = np.where(best > 1e-9, features[at // BINS], -1)
    return chosen, at % BINS, best


class Tree:
    """A binary tree as arrays; the children of node i are 2 i + 1 and 2 i + 2."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth, self.feature = depth, np.full(size, -1, np.int32)
        self.cut, self.value, self.gain = np.zeros(size, np.int32), np.zeros(size), np.zeros(size)

    def descend(self, bins: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        node = np.zeros(len(bins), np.int64) if node is None else node
        rows = np.arange(len(bins))
        for _ in range(self.depth):
            feature = self.feature[node]
            right = bins[rows, np.maximum(feature, 0)] > self.cut[node]
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node

    def split(self, ids: np.ndarray, total: np.ndarray, features: np.ndarray, rate: float) -> np.ndarray:
        """Set values and splits of the nodes ``ids`` from their sums; returns those that were split."""
        g, h = total[0, :, 0].sum(1), total[1, :, 0].sum(1)
        self.value[ids] = -rate * g / (h + LAMBDA)
        inner = np.log2(ids + 1).astype(int) < self.depth
        feature, cut, gain = best_splits(total, features)
        feature = np.where(inner, feature, -1)
        self.feature[ids], self.cut[ids], self.gain[ids] = feature, cut, np.where(feature >= 0, gain, 0)
        return ids[feature >= 0]

    def grow(
        self, start: int, columns: Sequence[np.ndarray], g: np.ndarray, h: np.ndarray, features: np.ndarray, rate: float,
        add: Callable[[np.ndarray], np.ndarray] = lambda own: own,
    ) -> np.ndarray:
        """Grow the branch below ``start`` from its rows, given as one column per drawn feature; returns the rows' leaves.

        Of two children only the one with fewer rows is added up; the other is what its parent has more. Where several
        tasks grow a branch from their own rows, ``add`` turns sums over these rows into sums over all.
        """
        leaf, rows, ids = np.full(len(g), start, np.int64), np.arange(len(g)), np.array([start])
        number = {f: i for i, f in enumerate(features.tolist())}
        node, total = np.zeros(len(g), np.int64), add(sums(columns, np.zeros(len(g), np.int64), g, h, 1))
        while ids.size:
            split = np.isin(ids, self.split(ids, total, features, rate))
            live = split[node]
            rows, node = rows[live], (np.cumsum(split) - 1)[node[live]]
            ids, total = ids[split], total[:, split]
            column = np.array([number[f] for f in self.feature[ids].tolist()], np.int64)
            cut, right = self.cut[ids], np.empty(rows.size, bool)
            order = np.argsort(column[node].astype(np.uint8 if len(columns) < 256 else np.int64), kind="stable")
            ends = np.cumsum(np.bincount(column[node], minlength=len(columns)))
            for f, (lo, hi) in enumerate(zip([0, *ends], ends)):
                if hi > lo:
                    some = order[lo:hi]
                    right[some] = columns[f].take(rows[some], mode="clip") > cut[node[some]]
            ids = np.stack([2 * ids + 1, 2 * ids + 2], 1).reshape(-1)
            node = 2 * node + right
            leaf[rows] = ids[node]
            if ids.size and int(np.log2(ids[0] + 1)) == self.depth:  # no more splits: the values take no bins
                own_g, own_h = add(np.stack([np.bincount(node, v[rows], ids.size) for v in (g, h)]))
                self.value[ids] = -rate * own_g / (own_h + LAMBDA)
                break
            if not ids.size:
                break
            count = add(np.bincount(node, minlength=ids.size).astype(float)).reshape(-1, 2)
            fewer = count[:, 1] < count[:, 0]  # whether the right child is the smaller one
            some = np.flatnonzero((node & 1) == fewer[node >> 1])
            at = rows[some]
            small = add(sums([c.take(at, mode="clip") for c in columns], node[some] >> 1, g[at], h[at], fewer.size))
            both, pairs = np.empty((2, fewer.size, 2, *total.shape[2:])), np.arange(fewer.size)
            both[:, pairs, fewer.astype(int)] = small
            both[:, pairs, 1 - fewer.astype(int)] = total - small
            total = both.reshape(2, ids.size, *total.shape[2:])
        return leaf


class Exchange:
    """Adds up arrays over the tasks of a barrier stage, through files in a folder that they share.

    A barrier of Spark takes about a second, so tasks wait for each other's files instead. Who has read all files of
    a step knows that nobody needs those of the step before.
    """

    def __init__(self, folder: str):
        context = BarrierTaskContext.get()
        self.step, self.own, self.tasks = 0, context.partitionId(), len(context.getTaskInfos())
        self.folder = f"{folder}/{context.allGather(uuid.uuid4().hex)[0]}"  # another one if the stage is repeated
        os.makedirs(self.folder, exist_ok=True)

    def _path(self, task: int, step: int) -> str:
        return f"{self.folder}/{step}-{task}"

    def add(self, own: np.ndarray) -> np.ndarray:
        self.step += 1
        own = own.astype(float)  # sums of no rows are integers
        own.tofile(f"{self.folder}/part-{self.own}")
        os.rename(f"{self.folder}/part-{self.own}", self._path(self.own, self.step))
        total = own
        for k in range(self.tasks):
            if k != self.own:
                total = total + self._read(k).reshape(own.shape)
        if self.step > 1:
            os.unlink(self._path(self.own, self.step - 1))
        return total

    def _read(self, task: int) -> np.ndarray:
        while True:
            try:
                return np.fromfile(self._path(task, self.step))
            except FileNotFoundError:
                time.sleep(0.0005)


def tasks_at_once(spark: SparkSession) -> int:
    """Tasks that a barrier stage may have; 1 where it cannot run."""
    context = spark.sparkContext
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    scala = context._jsc.sc()
    return min(context.defaultParallelism, scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile()))


def shared_folder(spark: SparkSession, name: str) -> str | None:
    """A new folder that Python can write on all executors, if the one for written tables is in a file system like that."""
    path = work_dir(spark, name)
    scheme, _, rest = path.rpartition(":")
    return "/" + rest.lstrip("/") if scheme in ("", "file") else None


def _drawn(rows: np.ndarray, round_: int, share: float) -> np.ndarray:
    x = (rows.astype(np.uint64) + np.uint64(round_ * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53) < share


def _slopes(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each row, in steps that sums of millions of rows hold exactly in any order."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint(w * (p - y) * STEPS) / STEPS, np.rint(w * p * (1 - p) * STEPS) / STEPS


def _bins(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


# ----------------------------------------------------------------------------------- bins
def cuts(raw: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """The borders of at most ``bins`` bins for each of the ``width`` values of the array column x."""
    wide = raw.select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(width)])
    return [np.unique(c) for c in wide.approxQuantile(wide.columns, [i / bins for i in range(1, bins)], 1.0 / (20 * bins))]


def into_bins(batch: pa.RecordBatch, edges: list[np.ndarray]) -> np.ndarray:
    """The bins of the column x of a batch, one row each."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1).astype(np.uint8)


# ------------------------------------------------------------------------------- training
class HistogramBoosting(Estimator):
    """Fits a ``HistogramBoostingModel`` on a vector, a 0/1 label and a weight column."""

    def __init__(
        self, rounds: int = 400, depth: int = 8, rate: float = 0.05, row_share: float = 0.8, feature_share: float = 0.8,
        seed: int = 42, features: str = "features", label: str = "label", weight: str | None = None,
    ):
        super().__init__()
        self.rounds, self.depth, self.rate, self.seed = rounds, depth, rate, seed
        self.row_share, self.feature_share = row_share, feature_share
        self.features, self.label, self.weight = features, label, weight

    def getMaxIter(self) -> int:
        return self.rounds

    def getMaxDepth(self) -> int:
        return self.depth

    def _features_of(self, round_: int, width: int) -> np.ndarray:
        kept = max(1, math.ceil(self.feature_share * width))
        return np.sort(np.random.default_rng([self.seed, round_]).permutation(width)[:kept])

    def _fit(self, df: DataFrame) -> HistogramBoostingModel:
        weight = F.col(self.weight) if self.weight else F.lit(1.0)
        raw = materialize(df.select(
            F.monotonically_increasing_id().alias("row"), F.col(self.label).cast("double").alias("y"), weight.cast("double").alias("w"),
            vector_to_array(self.features).alias("x")), "boosting-input")
        head = raw.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y")).first()
        if not head["n"]:
            raise ValueError("no rows to fit")
        width = head["width"]
        edges = cuts(raw, width, BINS)

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                packed = pa.array([r.tobytes() for r in into_bins(batch, edges)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("y"), batch.column("w"), pa.array(np.full(batch.num_rows, start)), packed],
                    names=["row", "y", "w", "margin", "bins"])

        share = min(max(head["y"] / head["w"], 1e-6), 1 - 1e-6) if head["w"] else 0.5
        start = math.log(share / (1 - share))
        rows = materialize(raw.mapInArrow(binned, _ROWS), "boosting-rows")
        trees: list[Tree] = []
        tasks = min(tasks_at_once(df.sparkSession), -(-head["n"] // SHARE))
        folder = shared_folder(df.sparkSession, "boosting-sums") if tasks > 1 and head["n"] <= tasks * TOGETHER else None
        if folder:
            trees = self._rounds_together(rows, tasks, folder, width)
        elif head["n"] <= IN_TASK:
            while len(trees) < self.rounds:
                trees += self._rounds_in_task(rows, trees, min(ROUNDS_A_JOB, self.rounds - len(trees)))
        else:
            done = 0
            while len(trees) < self.rounds:
                if len(trees) - done == STAGED_ROUNDS:
                    rows, done = materialize(_moved(rows, trees[done:]), "boosting-rows"), len(trees)
                trees.append(self._round(rows, trees[done:], len(trees), width, head["n"]))
        return HistogramBoostingModel(model=json.dumps({
            "start": start, "width": width, "gain": _importance(trees, width),
            "trees": [_written(t, edges) for t in trees]}), features=self.features)

    def _grown(
        self, numbers: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray, rounds: range,
        add: Callable[[np.ndarray], np.ndarray] = lambda own: own,
    ) -> Iterator[pd.DataFrame]:
        """The trees of some rounds from rows at hand, whose margins are kept up."""
        columns = np.ascontiguousarray(bins.T)
        for k in rounds:
            g, h = _slopes(y, w, margin)
            drawn = _drawn(numbers, k, self.row_share)
            used, rest = np.flatnonzero(drawn), np.flatnonzero(~drawn)
            tree, features = Tree(self.depth), self._features_of(k, bins.shape[1])
            leaf = tree.grow(0, [columns[f].take(used, mode="clip") for f in features], g[used], h[used], features, self.rate, add)
            margin[used] += tree.value[leaf]
            margin[rest] += tree.value[tree.descend(bins[rest])]
            yield _frame(tree, k, np.flatnonzero((tree.value != 0) | (tree.feature >= 0)))

    def _rounds_in_task(self, rows: DataFrame, trees: list[Tree], more: int) -> list[Tree]:
        """The next trees, grown by one task that holds all rows."""
        rounds = range(len(trees), len(trees) + more)

        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("row")
            bins, margin = _bins(part["bins"].tolist()), part["margin"].to_numpy().copy()
            for tree in trees:
                margin += tree.value[tree.descend(bins)]
            return pd.concat(self._grown(part["row"].to_numpy(), bins, part["y"].to_numpy(), part["w"].to_numpy(), margin, rounds))

        return _trees(rows.groupBy().applyInPandas(run, _NODES).collect(), self.depth, rounds)

    def _rounds_together(self, rows: DataFrame, tasks: int, folder: str, width: int) -> list[Tree]:
        """All trees, grown by tasks that run at once, each of which holds its share of the rows."""
        rounds = range(self.rounds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            exchange = Exchange(folder)
            held = [(np.empty((0, width), np.uint8), *[np.empty(0, kind) for kind in (np.int64, float, float, float)])]
            for b in batches:
                if b.num_rows:
                    held.append((_bins(b.column("bins").to_pylist()), *[b.column(c).to_numpy() for c in ("row", "y", "w", "margin")]))
            bins, numbers, y, w, margin = (np.concatenate(parts) for parts in zip(*held))
            held.clear()
            for frame in self._grown(numbers, bins, y, w, margin, rounds, exchange.add):
                if exchange.own == 0:  # all tasks have the same trees
                    yield pa.RecordBatch.from_pandas(frame.astype({"tree": "int32", "node": "int32"}), preserve_index=False)

        dealt = rows.repartition(tasks).mapInArrow(run, _NODES, barrier=True)
        return _trees(dealt.collect(), self.depth, rounds)

    def _round(self, rows: DataFrame, recent: list[Tree], k: int, width: int, n: int) -> Tree:
        """One tree: large nodes by sums over all tasks, small ones with their rows in one task each."""
        tree, features = Tree(self.depth), self._features_of(k, width)
        large, small = {0: n}, []
        share, rate, depth = self.row_share, self.rate, self.depth

        def live(batches, ids):
            for batch in batches:
                bins = _bins(batch.column("bins").to_pylist())
                margin = batch.column("margin").to_numpy().copy()
                for t in recent:
                    margin += t.value[t.descend(bins)]
                used = _drawn(batch.column("row").to_numpy(), k, share)
                node = tree.descend(bins)
                used &= np.isin(node, ids)
                g, h = _slopes(batch.column("y").to_numpy(), batch.column("w").to_numpy(), margin)
                yield bins[used], node[used], g[used], h[used], batch.column("row").to_numpy()[used]

        while large:
            ids = np.array(sorted(large))

            def level(batches: Iterator[pa.RecordBatch], ids=ids) -> Iterator[pa.RecordBatch]:
                total, count = 0, np.zeros(ids.size)
                for bins, node, g, h, _ in live(batches, ids):
                    at = np.searchsorted(ids, node)
                    total = total + sums(bins.T[features], at, g, h, ids.size)
                    count += np.bincount(at, minlength=ids.size)
                if not np.isscalar(total):
                    place = np.arange(total[0].size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place), pa.array(total[0].ravel()), pa.array(total[1].ravel()), pa.array(np.repeat(count, total[0].size // ids.size))],
                        names=["at", "g", "h", "n"])

            found = rows.mapInArrow(level, "at long, g double, h double, n double").groupBy("at").agg(
                F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas().sort_values("at")
            total = np.stack([found["g"].to_numpy(), found["h"].to_numpy()]).reshape(2, ids.size, features.size, BINS)
            split = tree.split(ids, total, features, rate)
            count = dict(zip(ids.tolist(), found["n"].to_numpy().reshape(ids.size, -1)[:, 0]))
            # A child's rows are at most its parent's, so a child of a small enough parent is small.
            children = [(c, count[i]) for i in split.tolist() for c in (2 * i + 1, 2 * i + 2)]
            small += [c for c, rows_ in children if rows_ <= IN_TASK]
            large = {c: rows_ for c, rows_ in children if rows_ > IN_TASK}
        if small:
            ids = np.array(sorted(small))

            def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for bins, node, g, h, row in live(batches, ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node), pa.array(row), pa.array(g), pa.array(h), pa.array([r.tobytes() for r in bins], pa.binary())],
                        names=["node", "row", "g", "h", "bins"])

            def branch(part: pd.DataFrame) -> pd.DataFrame:
                part = part.sort_values("row")
                own = Tree(depth)
                own.grow(int(part["node"].iloc[0]), _bins(part["bins"].tolist()).T[features], part["g"].to_numpy(), part["h"].to_numpy(), features, rate)
                return _frame(own, k, np.flatnonzero((own.value != 0) | (own.feature >= 0)))

            dealt = rows.mapInArrow(out, "node long, row long, g double, h double, bins binary")
            for row in dealt.groupBy("node").applyInPandas(branch, _NODES).collect():
                _set(tree, row)
        return tree


_NODES = "tree int, node int, feature int, cut int, value double, gain double"


def _frame(tree: Tree, k: int, ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"tree": k, "node": ids, "feature": tree.feature[ids], "cut": tree.cut[ids], "value": tree.value[ids], "gain": tree.gain[ids]})


def _set(tree: Tree, row) -> None:
    tree.feature[row["node"]], tree.cut[row["node"]] = row["feature"], row["cut"]
    tree.value[row["node"]], tree.gain[row["node"]] = row["value"], row["gain"]


def _trees(found: list, depth: int, numbers: range) -> list[Tree]:
    made = {k: Tree(depth) for k in numbers}
    for row in found:
        _set(made[row["tree"]], row)
    return [made[k] for k in numbers]


def _moved(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """``rows`` with the margins after ``trees``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margin = _bins(batch.column("bins").to_pylist()), batch.column("margin").to_numpy().copy()
            for tree in trees:
                margin += tree.value[tree.descend(bins)]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return rows.mapInArrow(run, _ROWS)


def _importance(trees: list[Tree], width: int) -> list[float]:
    gain = np.zeros(width)
    for t in trees:
        inner = t.feature >= 0
        np.add.at(gain, t.feature[inner], t.gain[inner])
    return (gain / gain.sum() if gain.sum() else gain).tolist()


def _written(tree: Tree, edges: list[np.ndarray]) -> dict[str, list]:
    """The tree with thresholds instead of bins: values up to the threshold go left."""
    ids = np.flatnonzero((tree.value != 0) | (tree.feature >= 0))
    limit = [float(edges[f][c]) if f >= 0 and c < len(edges[f]) else math.inf for f, c in zip(tree.feature[ids], tree.cut[ids])]
    return {"node": ids.tolist(), "feature": tree.feature[ids].tolist(), "limit": limit, "value": tree.value[ids].tolist(), "depth": tree.depth}


# -------------------------------------------------------------------------------- serving
class HistogramBoostingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
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
            trees = []
            for t in stored["trees"]:
                size = 2 ** (t["depth"] + 1) - 1
                arrays = np.full(size, -1, np.int64), np.zeros(size), np.zeros(size)
                for array, name in zip(arrays, ("feature", "limit", "value")):
                    array[t["node"]] = t[name]
                trees.append((t["depth"], *arrays))
            for part in parts:
                x = np.stack(part.to_numpy()) if len(part) else np.empty((0, stored["width"]))
                margin, rows = np.full(len(x), stored["start"]), np.arange(len(x))
                for depth, feature, limit, value in trees:
                    node = np.zeros(len(x), np.int64)
                    for _ in range(depth):
                        f = feature[node]
                        right = ~(x[rows, np.maximum(f, 0)] <= limit[node])
                        node = np.where(f >= 0, 2 * node + 1 + right, node)
                    margin += value[node]
                yield pd.Series(1 / (1 + np.exp(-margin)))

        p = score(vector_to_array(self.getOrDefault(self.features)))
        return df.withColumn("_p", p).withColumns({
            "probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": F.when(F.col("_p") > 0.5, 1.0).otherwise(0.0),
        }).drop("_p")
