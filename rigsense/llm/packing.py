"""Packing documents into sequences by exact complements, then best fit.

A document longer than a sequence is cut into whole sequences and a rest; nothing else is cut. The plan
needs only how many pieces of each length there are, at most one count per length: taking lengths from
the longest down, a piece's gap is filled exactly by one, two or three other lengths, read from an index
of single, pair and triple sums (``SumIndex``) at the key of the gap. Each combination there is consumed as
many times as the counts allow. What finds no exact complement is packed best fit, also many equal sequences
at once. The plan says which ranks of a length go to which sequences, so each piece finds its place by its
rank among pieces of its length.

Defined results: a null text is an empty one; a document without ids still has its end id. Repeated rows
are packed each. An empty table gives an empty result. Columns beside key and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigsense.llm.base import running_totals, slices, stage
from rigsense.llm.tokens import token_bodies, unpack

MAX_PAIRS = 1 << 24  # pairs the index of sums keeps; a room of 8192 and every length stay below it
Slots = list[tuple[int, int, int, int, int]]  # length, first rank, count, first sequence, offset in the sequence


def plan(counts: np.ndarray, room: int) -> tuple[Slots, int]:
    """Where the pieces of each length go, and the number of sequences. ``counts[n]``: pieces of length n."""
    left = np.zeros(room + 1, np.int64)
    left[:len(counts)] = counts
    used = np.zeros(room + 1, np.int64)
    slots: Slots = []
    sequences = 0
    open_bins: list[tuple[int, int, int]] = []  # room left, first sequence, number of equal sequences

    def place(length: int, times: int, first: int, offset: int) -> None:
        slots.append((length, int(used[length]), times, first, offset))
        used[length] += times
        left[length] -= times

    def best_fit(length: int) -> None:
        """Put all pieces of this length into the fullest open sequences that have room, or open new ones."""
        nonlocal sequences
        while left[length]:
            best = min((b for b in open_bins if b[0] >= length), default=None)
            if best is None:
                per = room // length
                full, rest = divmod(int(left[length]), per)
                for times, copies in ((full, per), (1, rest)):
                    if times and copies:
                        for k in range(copies):
                            place(length, times, sequences, k * length)
                        open_bins.append((room - copies * length, sequences, times))
                        sequences += times
                continue
            open_bins.remove(best)
            space, first, times = best
            taken = min(times, int(left[length]))
            place(length, taken, first, room - space)
            open_bins.append((space - length, first, taken))
            if taken < times:
                open_bins.append((space, first + taken, times - taken))

    index = SumIndex(np.flatnonzero(left))
    for longest in range(room, 0, -1):
        for members in index.complements(longest, room - longest, left):
            times = min(int(left[m]) // members.count(m) for m in set(members))
            offset = 0
            for m in members:
                place(m, times, sequences, offset)
                offset += m
            sequences += times
        best_fit(longest)
    return slots, sequences


class SumIndex:
    """Sums of one, two and three lengths, each a hash table from the sum to the combinations that have it.

    A sum is entered when it is first asked for. Counts only fall, so a combination that has run out never
    comes back and each key is walked once. Combinations are kept apart from counts: the table of pairs has
    every pair of lengths that occur, and a triple is kept as its longest member and the key of the pair
    beside it. Beyond ``MAX_PAIRS`` entries the pairs are dropped and entered again when asked for.
    """

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths  # ascending
        self.singles = {int(n): int(n) for n in lengths}
        self._present = np.zeros(int(lengths[-1]) + 1 if lengths.size else 1, bool)
        self._present[lengths] = True
        self._pairs: dict[int, np.ndarray] = {}
        self._triples: dict[int, np.ndarray] = {}
        self._held = 0

    def pairs(self, total: int) -> np.ndarray:
        """The longer members of all pairs with this sum, longest first."""
        if total not in self._pairs:
            lo, hi = np.searchsorted(self.lengths, (-(-total // 2), total))
            longer = self.lengths[lo:hi]
            found = longer[self._present[total - longer]][::-1]
            if self._held + found.size > MAX_PAIRS:
                self._pairs.clear()
                self._held = 0
            self._pairs[total] = found
            self._held += found.size
        return self._pairs[total]

    def triples(self, total: int) -> np.ndarray:
        """The longest members of all triples with this sum, longest first; the pair beside one is at its own key."""
        if total not in self._triples:
            lo, hi = np.searchsorted(self.lengths, (-(-total // 3), total))
            self._triples[total] = self.lengths[lo:hi][::-1]
        return self._triples[total]

    def complements(self, length: int, gap: int, left: np.ndarray) -> Iterator[list[int]]:
        """``length`` with lengths that fill its gap exactly, as long as ``left`` has all of them.

        Fewest members first, then the longest; the caller takes as many as there are before it goes on.
        """
        if left[length] and gap == 0:
            yield [length]
        if left[length] and gap in self.singles and left[gap] >= 1 + (gap == length):
            yield [length, gap]
        for longer in self._live((length,), self.pairs(gap), gap, left):
            yield [length, longer, gap - longer]
        for first in self.triples(gap).tolist():
            if not left[length]:
                return
            if left[first] > (first == length):
                beside = self.pairs(gap - first)
                beside = beside[np.searchsorted(-beside, -first):]  # a triple is found at its longest member only
                for longer in self._live((length, first), beside, gap - first, left):
                    yield [length, first, longer, gap - first - longer]

    @staticmethod
    def _live(taken: tuple[int, ...], longer: np.ndarray, total: int, left: np.ndarray) -> Iterator[int]:
        """Those of the pairs that ``left`` has beside ``taken``, looked at again after each one."""
        while longer.size and all(left[n] >= taken.count(n) for n in taken):
            shorter = total - longer
            need_long, need_short = 1 + (longer == shorter), np.ones(longer.size, np.int64)
            for n in taken:
                need_long += longer == n
                need_short += shorter == n
            found = np.flatnonzero((left[longer] >= need_long) & (left[shorter] >= need_short))
            if not found.size:
                return
            yield int(longer[found[0]])
            longer = longer[found[0] + 1:]


def pieces(documents: DataFrame, tokenizer: str, end_id: int, room: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length and ids.

    One worker a task encodes and cuts: of two in a row, which change places from task to task, each would
    come to hold a tokenizer and its table of pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                counts, whole = token_bodies(part.column(1), tokenizer, end_id)
                per = -(-counts // room)
                owner = np.repeat(np.arange(counts.size), per)
                piece = np.arange(owner.size) - np.repeat(np.cumsum(per) - per, per)
                start = piece * room
                length = np.minimum(room, counts[owner] - start)
                bodies = []
                for n, raw in zip(counts, whole):
                    step = len(raw) // int(n) * room
                    bodies += [raw[lo:lo + step] for lo in range(0, len(raw), step)]
                columns = [part.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])
            pa.default_memory_pool().release_unused()  # as in map_texts

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def pack(documents: DataFrame, tokenizer: str, end_id: int = 0, room: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All pieces with their ids, sequence_id and offset."""
    rows = stage(pieces(documents, tokenizer, end_id, room, text, key).withColumn("row", F.monotonically_increasing_id()), "pieces")
    light = rows.select("length", "doc_id", "piece", "row").withColumn("one", F.lit(1).cast("long"))
    ranked = stage(running_totals(light, ["length", "doc_id", "piece", "row"], ["one"], "pieces-order").select("length", "row", "run_one"), "pieces-rank")
    counts = np.zeros(room + 1, np.int64)
    for r in ranked.groupBy("length").count().collect():  # one row per length
        counts[r["length"]] = r["count"]
    slots, _ = plan(counts, room)
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    before = np.cumsum(counts) - counts
    rank_at = before[table[:, 0]] + table[:, 1]
    share = documents.sparkSession.sparkContext.broadcast((rank_at, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, slots = share.value
        for batch in batches:
            rank = np.asarray(batch.column(1)) - 1
            slot = np.searchsorted(begins, rank, side="right") - 1
            sequence = slots[slot, 3] + rank - begins[slot]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(slots[slot, 4])], names=["row", "sequence_id", "offset"])

    placed = ranked.select("row", "run_one").mapInArrow(place, "row long, sequence_id long, offset long")
    return rows.join(placed.hint("merge"), "row").drop("row")  # one plan for every size


def with_crc(packed: DataFrame) -> DataFrame:
    """Replace the ids by ids_crc32, the checksum of them as little-endian 32-bit integers."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(unpack(b.as_py(), n).astype("<u4").tobytes()) for n, b in zip(batch.column(3).to_pylist(), batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64()), *batch.columns[5:]], names=names)

    ordered = packed.select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
    kinds = [T.StructField(c, T.IntegerType() if c == "piece" else T.LongType()) for c in names]
    return ordered.mapInArrow(digest, T.StructType(kinds))
