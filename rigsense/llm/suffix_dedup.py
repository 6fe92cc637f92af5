"""Repeated byte strings by distributed prefix doubling over sampled suffix positions.

A byte goes if it lies in a string of ``length`` bytes (a window) that also starts earlier: in a document
that comes before, or in the same document at a smaller start. Documents are in the order of doc_id.

Ranking every byte position would sort far more than the cluster has disk, so positions enter in two
steps. In every window one position is its anchor: the place of the smallest hash of ``SEED`` bytes, the
first of them if some are equal. Equal windows have their anchors at the same place, so windows of
different anchor strings differ. Each round sorts pairs of ranks, where the second rank belongs to a
longer string or to the string at a growing offset; ranks are 64-bit names of strings, so a pair has 128 bits.

1. Anchors by (rank of SEED bytes, rank of all bytes that windows of this anchor reach). An anchor whose
   first rank is unique has no repeated window and leaves. An anchor whose pair came before is past the
   threshold: all its windows are repeats. Others of a first rank with several pairs stay undecided.
2. The windows of undecided anchors by (rank of the first half, rank of the half at offset ``length`` / 2):
   those whose pair came before are repeats, all others are not.

Both rounds are one function: tasks merge equal pairs of a batch, Spark deals pairs and sorts them, and one
pass compares neighbours. Round 1 deals by first rank. A first rank with many pairs within a batch (a line
that a third of all documents share) sends two of them as witnesses; the rest is spread over the tasks and
stays undecided, which costs work in round 2 but no repeat. Round 2 deals by the whole pair.

Defined results: null and empty texts, and those shorter than ``length``, keep all their bytes. A null
doc_id comes before all others. Rows with equal doc_id and equal text are one document and get the same
result; equal doc_id with different texts are in the order of a hash of the text. An empty table gives an
empty result. Columns named like an output are replaced. doc_id must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigsense.llm.base import byte_hashes, mix, new_name, slices, stage, text_bytes

LENGTH = 100  # bytes of a string whose repeat is removed
SEED = 50  # bytes of an anchor's first rank
MANY = 32  # pairs of one first rank in a batch from which the rest is spread
_TIE_BITS = 20
_PLACE = np.uint64((1 << 36) - 1)
_PAIR, _REPEAT, _OPEN, _SAME = 0, 1, 2, 3  # kinds of rows: a pair to sort; decided as a repeat; undecided whatever comes; not sent
_ROW = "kind int, first long, second long, doc long, tie int, start long, count int"


# ------------------------------------------------------------------------- rank pairs of a text
def _window_starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """All starts of windows that end within their text."""
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    total = int(sizes.sum())
    return np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Rank pairs, text number, start and number of the windows of each anchor."""
    starts = _window_starts(offsets, length)
    if not starts.size:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    names = byte_hashes(data)
    at = np.arange(data.size - seed + 1)
    seeds = names.of(at, at + seed)
    lowest = (seeds & ~_PLACE) | at.astype(np.uint64)
    width, span = length - seed + 1, 1
    while span < width:  # smallest of the next `width` seeds, by growing spans
        step = min(span, width - span)
        lowest = np.minimum(lowest[:-step], lowest[step:])
        span += step
    anchor = (lowest[starts] & _PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    last = np.concatenate([first[1:], [starts.size]]) - 1
    lo, hi = starts[first], starts[last]
    reach = mix(names.of(lo, hi + length) + (anchor[first] - lo).astype(np.uint64))
    return seeds[anchor[first]], reach, np.searchsorted(offsets, lo, side="right") - 1, lo, hi - lo + 1


def windows(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Rank pairs of the windows at ``starts``: the two halves."""
    names, half = byte_hashes(data), length // 2
    return names.of(starts, starts + half), names.of(starts + half, starts + length)


def _merge(first, second, doc, tie, start, count, length, many=None):
    """Rows of a batch to send: pairs once each, and repeats within the batch as spans.

    Rows come in any order; the first of equal pairs in the order of documents and starts stays. Of a first
    rank with more than ``many`` pairs, two stay pairs and the rest is undecided.
    """
    order = np.lexsort((start, tie, doc, second, first))
    first, second, doc, tie, start, count = (x[order] for x in (first, second, doc, tie, start, count))
    new_first = np.ones(first.size, bool)
    new_first[1:] = first[1:] != first[:-1]
    new = new_first.copy()
    new[1:] |= second[1:] != second[:-1]
    group = np.cumsum(new_first) - 1
    kind = np.where(new, _PAIR, _REPEAT)
    kind[~new & _again(doc, tie, start)] = _SAME
    if many is not None and group.size:
        nth = np.cumsum(new) - np.cumsum(new)[np.flatnonzero(new_first)][group]  # 0 for the first pair of its rank
        kind[new & (np.bincount(group[new]) > many)[group] & (nth >= 2)] = _OPEN
    spans = _join(*(x[kind == _REPEAT] for x in (doc, tie, start, count)), length)
    keep = (kind == _PAIR) | (kind == _OPEN)
    pairs = [x[keep] for x in (kind, first, second, doc, tie, start, count)]
    zeros = np.zeros(spans[0].size, np.uint64)
    return [np.concatenate(x) for x in zip(pairs, [np.full(zeros.size, _REPEAT), zeros, zeros, *spans])]


def _again(doc, tie, start) -> np.ndarray:
    """Rows at the very position of the row before: a repeated row of the table repeats no other document."""
    same = np.zeros(doc.size, bool)
    same[1:] = (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (start[1:] == start[:-1])
    return same


def _join(doc, tie, start, count, length):
    """Runs of windows without a gap between their bytes, as (doc, tie, start, number of windows)."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], (start + count)[order]
    if not start.size:
        return doc, tie, start, end
    fresh = np.ones(start.size, bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] >= end[:-1] + length)
    begins = np.flatnonzero(fresh)
    ends = np.concatenate([begins[1:], [start.size]]) - 1  # windows of one document start and end in the same order
    return doc[begins], tie[begins], start[begins], end[ends] - start[begins]


def _record(columns) -> pa.RecordBatch:
    kind, first, second, doc, tie, start, count = columns
    values = [kind.astype(np.int32), first.view(np.int64), second.view(np.int64), doc, tie.astype(np.int32), start, count.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["kind", "first", "second", "doc", "tie", "start", "count"])


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc").to_numpy().astype(np.int64), batch.column("tie").to_numpy().astype(np.int64)


# ---------------------------------------------------------------------------------- rounds
def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Sorted pairs to decided repeats and undecided rows; one row is carried from batch to batch."""
    held, decided = None, True  # the last new pair, and whether its rank has several
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        columns = [batch.column(c).to_numpy() for c in ("first", "second", "doc", "tie", "start", "count")]
        through = kind != _PAIR
        done = [x[through] for x in columns]
        rows = [x[~through] for x in columns]
        if rows[0].size:
            carried = held is not None
            if carried:
                rows = [np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held, rows)]
            first, second = rows[0], rows[1]
            new_first = np.ones(first.size, bool)
            new_first[1:] = first[1:] != first[:-1]
            new = new_first.copy()
            new[1:] |= second[1:] != second[:-1]
            group = np.cumsum(new_first) - 1
            several = np.bincount(group[new]) > 1
            if carried:
                several[0] |= decided
            undecided = new & several[group]
            if carried and decided:
                undecided[0] = False  # sent before
            last = np.flatnonzero(new)[-1]
            held, decided = [x[last] for x in rows], bool(several[group[last]])
            repeat = ~new & ~_again(*rows[2:5])
            spans = _join(*(x[repeat] for x in rows[2:]), length)
            open_rows = [x[undecided] for x in rows[2:]]
        else:
            spans = open_rows = [np.empty(0, np.int64)] * 4
        zeros = lambda n: np.zeros(n, np.uint64)
        parts = [
            [kind[through], zeros(done[0].size), zeros(done[0].size), *done[2:]],
            [np.full(spans[0].size, _REPEAT), zeros(spans[0].size), zeros(spans[0].size), *spans],
            [np.full(open_rows[0].size, _OPEN), zeros(open_rows[0].size), zeros(open_rows[0].size), *open_rows],
        ]
        yield _record([np.concatenate(x) for x in zip(*parts)])


def _round(rows: DataFrame, by: Column, length: int, name: str) -> DataFrame:
    """Deal pairs by a rank, sort them, and keep repeats and undecided rows in a written table."""
    spread = F.when(F.col("kind") == _PAIR, by).otherwise(F.xxhash64("doc", "start"))
    dealt = rows.repartition(spread).sortWithinPartitions("kind", "first", "second", "doc", "tie", "start")
    return stage(dealt.mapInArrow(lambda batches: _compare(batches, length), _ROW).drop("first", "second"), name)


def _document_keys(text: str, key: str) -> dict[str, Column]:
    return {
        "doc": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))),
        "tie": F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << _TIE_BITS)).cast("int"),
    }


def _per_document(rows: DataFrame, name: str) -> DataFrame:
    """One row per document with the list of its (start, count); a list is no longer than its text."""
    return rows.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "count")).alias(name))


def find(documents: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Repeated windows as rows (doc, tie, start, count): ``count`` windows from ``start`` on are to go.

    doc and tie are the internal keys of a document. Windows of a row may be any whose bytes leave no gap.
    """
    if not 0 < seed < length:
        raise ValueError("seed must be shorter than length")
    texts = documents.filter(F.octet_length(text) >= length).select(
        F.col(text).alias("text"), *[c.alias(n) for n, c in _document_keys(text, key).items()])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(batch, "text"):
                docs, ties = _keys(part)
                data, offsets = text_bytes(part.column("text"))
                first, second, number, lo, count = anchors(data, offsets, length, seed)
                found.append((first, second, docs[number], ties[number], lo - offsets[number], count))
            if found:
                yield _record(_merge(*(np.concatenate(x) for x in zip(*found)), length, MANY))
            pa.default_memory_pool().release_unused()

    one = _round(texts.mapInArrow(seeds, _ROW), F.col("first"), length, "suffix-anchors")
    undecided = _per_document(one.filter(F.col("kind") == _OPEN), "open")
    again = texts.join(undecided.hint("merge"), ["doc", "tie"])

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                docs, ties = _keys(part)
                data, offsets = text_bytes(part.column("text"))
                lists = part.column("open")
                number = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                lo, count = flat.field("start").to_numpy(), flat.field("count").to_numpy().astype(np.int64)
                before = np.cumsum(count) - count
                starts = np.repeat(lo - before, count) + np.arange(int(count.sum()))
                number = np.repeat(number, count)
                first, second = windows(data, offsets[number] + starts, length)
                yield _record(_merge(first, second, docs[number], ties[number], starts, np.ones(starts.size, np.int64), length))
            pa.default_memory_pool().release_unused()

    two = _round(again.mapInArrow(halves, _ROW), F.xxhash64("first", "second"), length, "suffix-windows")
    same = ["doc", "tie", "start", "count"]
    return one.filter(F.col("kind") == _REPEAT).select(same).unionByName(two.filter(F.col("kind") == _REPEAT).select(same))


def remove(documents: DataFrame, repeats: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``documents`` with n_bytes, removed (the maximal runs of bytes that go, as start and end) and kept (what stays).

    kept is binary, as a cut may fall into a character.
    """
    doc, tie, lists = (new_name(c) for c in ("doc", "tie", "lists"))
    keyed = documents.drop("n_bytes", "removed", "kept").withColumns(dict(zip((doc, tie), _document_keys(text, key).values())))
    spans = _per_document(repeats, lists).withColumnsRenamed({"doc": doc, "tie": tie})
    joined = keyed.join(spans.hint("merge"), [doc, tie], "left")
    plain = [c for c in joined.columns if c not in (doc, tie, lists)]
    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ]
    schema = T.StructType([joined.schema[c] for c in plain] + fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 8 << 20):
                data, offsets = text_bytes(part.column(part.schema.get_field_index(text)))
                column = part.column(part.schema.get_field_index(lists))
                sizes = column.value_lengths().fill_null(0).to_numpy()
                flat = column.drop_null().flatten()
                number = np.repeat(np.arange(part.num_rows), sizes)
                start, count = flat.field("start").to_numpy(), flat.field("count").to_numpy().astype(np.int64)
                edges = np.zeros(data.size + 1, np.int64)
                np.add.at(edges, offsets[number] + start, 1)
                np.add.at(edges, offsets[number] + start + count + length - 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                # Runs of bytes that go; a run ends with its text.
                border = np.zeros(data.size + 1, bool)
                border[offsets] = True
                begin = np.flatnonzero(gone & (np.concatenate([[True], ~gone[:-1]])[:gone.size] | border[:-1]))
                end = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]])[:gone.size] | border[1:])) + 1
                owner = np.searchsorted(offsets, begin, side="right") - 1
                runs = pa.StructArray.from_arrays([pa.array(begin - offsets[owner]), pa.array(end - offsets[owner])], ["start", "end"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))]).astype(np.int32)
                stays = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int64)
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(stays.tobytes()), pa.py_buffer(data[~gone].tobytes())])
                old = [part.column(part.schema.get_field_index(c)) for c in plain]
                yield pa.RecordBatch.from_arrays(
                    [*old, pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(ends), runs), kept.cast(pa.binary())],
                    names=[*plain, "n_bytes", "removed", "kept"])
            pa.default_memory_pool().release_unused()

    return joined.select(*plain, lists).mapInArrow(cut, schema)


def deduplicate(documents: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``documents`` with n_bytes, removed and kept: every byte in a repeated string of ``length`` bytes goes."""
    return remove(documents, find(documents, text, key, length, seed), text, key, length)
