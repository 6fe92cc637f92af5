"""A Merkle manifest of a table: one root for all rows, and a proof per row.

Every row is a leaf. The leaves of a group, in ascending order of a key, are the bottom level of a tree;
while a level has several nodes, every ``FANOUT`` neighbours become their parent, the digest of their
digests. What remains is the group's subroot, and the subroots are the leaves of one more tree, whose top is
the root.

Each level is one window over runs of siblings: lag and lead columns at the fixed offsets 1 to
``FANOUT`` - 1, masked by a node's slot in its run and the run's length, are its siblings, and the first child
of each run hashes the parent. The next level has a sixteenth of the rows. On the way back each level joins
its nodes with the path of their parent by run, so no key has more than ``FANOUT`` rows however many rows
a group holds. Places within groups come from one range sort: a task counts its own rows, and the few
groups that go on from the task before are shifted by one row per task.

Defined results: a null value is hashed as ``-``, any other as byte count, colon and value, so null and
empty differ. A null group is a group of its own, before all others. A null key comes before all others;
rows with equal keys are in the order of their leaves, so repeated rows are leaves of their own. A single
leaf is its own subroot, a single subroot is the root. An empty table gives no rows and no root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigsense.llm.base import stage

FANOUT = 16
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of a row's values."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _group_key(group: Column) -> Column:
    """Text without nulls in the same order: null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _placed(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with place (from 0 within the group) and size (of the group)."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = stage(dealt.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), name)
    parts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that holds the group
    parts = parts.withColumns({"size": F.sum("_n").over(whole), "_shift": F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")})
    return dealt.join(parts.select(group, "_part", "size", "_shift"), [group, "_part"]).withColumn(
        "place", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")


def _siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (tree, place, size, digest) with run, slot, and the digests to the left and right in the run."""
    nodes = nodes.withColumns({"run": F.floor(F.col("place") / fanout).cast("long"), "slot": F.pmod("place", F.lit(fanout)).cast("int")})
    nodes = nodes.withColumn("_length", F.least(F.lit(fanout), F.col("size") - F.col("run") * fanout).cast("int"))
    window = Window.partitionBy("tree", "run").orderBy("place")
    offsets = range(1, fanout)
    nodes = nodes.withColumns(
        {f"_lag{j}": F.when(F.col("slot") >= j, F.lag("digest", j).over(window)) for j in offsets}
        | {f"_lead{j}": F.when(F.col("slot") + j < F.col("_length"), F.lead("digest", j).over(window)) for j in offsets})
    around = {"left": F.concat_ws("", *[f"_lag{j}" for j in reversed(offsets)]), "right": F.concat_ws("", *[f"_lead{j}" for j in offsets])}
    return nodes.withColumns(around).drop("_length", *[f"_lag{j}" for j in offsets], *[f"_lead{j}" for j in offsets])


def _grow(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, bottom first, and their tops (tree, digest).

    A level holds the nodes of trees that have several nodes there.
    """
    levels, tops = [], nodes.filter("size = 1").select("tree", "digest")
    most = nodes.agg(F.max("size")).first()[0] or 0
    level = nodes.filter("size > 1")
    while most > 1:
        levels.append(level)
        first = _siblings(level, fanout).filter("slot = 0")
        most = -(-most // fanout)
        level = stage(first.select(
            "tree", F.col("run").alias("place"), F.ceil(F.col("size") / fanout).cast("long").alias("size"),
            digest(F.concat("digest", "right")).alias("digest")), name)
        tops = tops.unionByName(level.filter("size = 1").select("tree", "digest"))
        level = level.filter("size > 1")
    return levels, tops


def _paths(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The bottom nodes with path: the siblings left and right at each level, and what tops carries.

    ``tops`` has tree and path (the way on from the tree's top) and columns to hand down.
    """
    more = [c for c in tops.columns if c not in ("tree", "path")]
    own = F.array(F.struct("left", "right"))
    above = None
    for level in reversed(levels):
        nodes = _siblings(level, fanout)
        if above is None:
            nodes = nodes.join(tops, "tree")
        else:
            # Trees whose top is the parent take the way on from there, the others the path of the parent.
            high = nodes.filter(F.col("size") > fanout).join(above, ["tree", "run"])
            low = nodes.filter(F.col("size") <= fanout).join(tops, "tree")
            nodes = high.unionByName(low.select(high.columns))
        nodes = nodes.withColumn("path", F.concat(own, "path"))
        above = nodes.select("tree", F.col("place").alias("run"), "path", *more)
    return nodes


@dataclass
class Manifest:
    leaves: DataFrame  # row (the input columns), tree, place, size and digest
    levels: list[DataFrame]  # of the trees of all groups, bottom first: tree, place, size, digest
    subroots: DataFrame  # tree, digest, place and size in the upper tree
    upper: list[DataFrame]  # the levels of the tree over the subroots
    root: str | None
    fanout: int


def build(rows: DataFrame, leaf: str, group: str, key: str, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``rows``, whose column ``leaf`` holds each row's digest."""
    keyed = rows.select(F.struct(*rows.columns).alias("row"), _group_key(F.col(group)).alias("tree"), F.col(key).alias("key"), F.col(leaf).alias("digest"))
    leaves = stage(_placed(keyed, "tree", ["key", "digest"], "merkle-order").drop("key"), "merkle-leaves")
    levels, tops = _grow(leaves.select("tree", "place", "size", "digest"), fanout, "merkle-level")
    ordered = tops.withColumnRenamed("tree", "name").withColumn("tree", F.lit(""))
    subroots = stage(_placed(ordered, "tree", ["name"], "merkle-order"), "merkle-subroots")
    upper, top = _grow(subroots.select("tree", "place", "size", "digest"), fanout, "merkle-upper")
    found = top.first()
    return Manifest(leaves, levels, subroots, upper, found["digest"] if found else None, fanout)


def prove(manifest: Manifest) -> DataFrame:
    """The rows with subroot, root and path (siblings left and right per level, from the leaf to the root).

    Input columns of these names are replaced.
    """
    root = F.lit(manifest.root).cast("string")
    empty = F.array().cast(_PATH)
    starts = manifest.subroots
    if manifest.upper:
        tops = starts.select("tree").distinct().withColumn("path", empty)
        ways = _paths(manifest.upper, tops, manifest.fanout).select("tree", "place", "path")
        starts = starts.join(ways, ["tree", "place"])
    else:
        starts = starts.withColumn("path", empty)
    starts = starts.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path")
    lone = manifest.leaves.filter("size = 1").join(starts, "tree")
    if manifest.levels:
        bottom = [manifest.leaves.filter("size > 1"), *manifest.levels[1:]]
        lone = _paths(bottom, starts, manifest.fanout).select(lone.columns).unionByName(lone)
    kept = [F.col("row")[c].alias(c) for c in manifest.leaves.schema["row"].dataType.names if c not in ("subroot", "root", "path")]
    return lone.select(*kept, "subroot", root.alias("root"), "path")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, x: digest(F.concat(x["left"], acc, x["right"])))
