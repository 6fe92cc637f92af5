"""Sharding by minimax contiguous partition.

Groups of equal texts stay together and are ordered by their smallest key. The smallest capacity with
which a greedy pass over that order needs no more than ``shards`` shards is found by binary search,
and the greedy pass at that capacity sets the cuts.

The search runs on the driver over a bounded view of the group ends (running byte totals): at most
``BINS`` knots for each range that a cut can still fall into. Between two knots of a bin further ends
may hide, so a capacity found with the knots alone is an upper bound, and one found as if every byte
were an end is a lower bound. Ranges between the two are read again with finer bins, until every end
in them is known; then the answer is exact.

Defined results: a null text is a group of its own kind (all null texts together, apart from the empty
text) with no bytes; each row counts its bytes plus 1. Repeated rows and rows with a null key are
placed like others (a null key sorts first); ties in key have any order between them. An empty table
gives an empty result; columns beside key and text are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigsense.llm.base import running_totals, stage

BINS = 4096  # knots per range and round that the driver reads
EXACT = 20_000  # ends that the driver reads one by one in the last round


@dataclass
class View:
    """Known ends in order; ``hidden[i]`` tells that ends may lie between ends[i - 1] and ends[i]."""

    ends: list[int]
    hidden: list[bool]

    def reach(self, limit: int, loose: bool) -> int:
        """The largest end up to ``limit``; ``loose``: as if every number between hidden ends were one."""
        i = bisect_right(self.ends, limit)
        known = self.ends[i - 1] if i else 0
        return limit if loose and i < len(self.ends) and self.hidden[i] else known

    def greedy(self, capacity: int, shards: int, loose: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = max(at, self.reach(at + capacity, loose))
            cuts.append(at)
        return cuts

    def smallest(self, shards: int, loose: bool) -> int:
        total = self.ends[-1]
        lo, hi = max(1, -(-total // shards)), total
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.greedy(mid, shards, loose)[-1] >= total else (mid + 1, hi)
        return lo


def minimax_cuts(ends: DataFrame, end: str, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the greedy cuts at it; ``ends`` has the running total at each group's end."""
    bounds = ends.agg(F.min(end), F.max(end)).first()
    if bounds[1] is None:
        return 0, []
    view = View([bounds[0], bounds[1]], [False, True])
    while True:
        low, high = view.smallest(shards, loose=True), view.smallest(shards, loose=False)
        ranges = _open(view, list(zip(view.greedy(low, shards, loose=False), view.greedy(high, shards, loose=True))))
        if not ranges:
            return high, sorted(set(view.greedy(high, shards, loose=False)))
        view = _finer(ends, end, view, ranges)


def _open(view: View, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The gaps with hidden ends that a cut between the given bounds can fall into, as (known end before, known end)."""
    found = set()
    for lo, hi in spans:
        for i in range(bisect_right(view.ends, lo), min(bisect_right(view.ends, hi) + 1, len(view.ends))):
            if view.hidden[i]:
                found.add((view.ends[i - 1] if i else 0, view.ends[i]))
    return sorted(found)


def _finer(ends: DataFrame, end: str, view: View, ranges: list[tuple[int, int]]) -> View:
    """Read the given gaps again: one by one if few ends lie there, else the first and last end of each bin."""
    merged: list[list[int]] = []
    for lo, hi in ranges:
        if merged and merged[-1][1] == lo:
            merged[-1][1] = hi
        else:
            merged.append([lo, hi])
    value = F.col(end)
    where, bins = F.lit(False), F.lit(None).cast("long")
    for k, (lo, hi) in enumerate(merged):
        inside = (value > lo) & (value < hi)
        where |= inside
        step = max(1, (hi - lo) // BINS)
        bins = F.when(inside, F.lit(k << 40) + F.floor((value - lo) / F.lit(step))).otherwise(bins)
    rows = ends.filter(where)
    few = rows.select(value.alias("e")).limit(EXACT + 1).collect()
    if len(few) <= EXACT:
        known = {r["e"]: False for r in few}
    else:
        known = {}
        for r in rows.groupBy(bins.alias("bin")).agg(F.min(end).alias("a"), F.max(end).alias("b"), F.count("*").alias("n")).collect():
            known.setdefault(r["a"], False)
            known[r["b"]] = r["n"] > 2
    closed = {b for _, b in ranges}
    both = {e: h and e not in closed for e, h in zip(view.ends, view.hidden)} | known
    order = sorted(both)
    return View(order, [both[e] for e in order])


def shard(documents: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``documents``: key, size, text_crc32, shard and slot (its place in the shard)."""
    body = F.col(text).cast("binary")
    rows = documents.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit(b""))).alias("text_crc32"), F.coalesce(F.sha2(body, 256), F.lit("null")).alias("digest"),
    )
    rows = stage(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    placed = running_totals(
        rows.join(groups, "digest").withColumn("one", F.lit(1).cast("long")), ["first_id", "digest", "doc_id"], ["size", "one"], "shard-order",
    )
    placed = stage(placed, "shard-placed")
    ends = stage(placed.groupBy("digest").agg(F.max("run_size").alias("end"), F.max("run_one").alias("rows")).drop("digest"), "shard-ends")
    _, cuts = minimax_cuts(ends, "end", shards)
    ranks = {r["end"]: r["rows"] for r in ends.filter(F.col("end").isin(cuts)).collect()} if cuts else {}
    number, before = F.lit(0), F.lit(0).cast("long")
    for k, cut in enumerate(cuts[:-1], start=1):
        number = F.when(F.col("run_size") > cut, k).otherwise(number)
        before = F.when(F.col("run_size") > cut, ranks[cut]).otherwise(before)
    return placed.select(
        "doc_id", "size", "text_crc32", number.cast("int").alias("shard"), (F.col("run_one") - 1 - before).cast("long").alias("slot"),
    )
