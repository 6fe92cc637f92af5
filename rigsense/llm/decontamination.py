"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of digits, lower-cased letters a-z and bytes beyond ASCII. Every ``WIDTH`` consecutive
words of a test item are a window; a shorter item is one window. Hashes of all windows go to every
task, in sets of at most ``MAX_WINDOWS``: a benchmark with more is scanned set by set, each pass adding
to the hits of the one before. Every hash hit is compared word by word.

Defined results: a null or empty text has no words and is clean. An item without words or with a null
text has no window. A null item_id counts as the empty string, equal item_ids count once. With an empty
benchmark every text is clean; an empty table gives an empty result. Columns named like an output are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigsense.llm.base import list_of, map_texts, span_hashes, stage, text_bytes, word_hashes, word_spans

WIDTH = 10
MAX_WINDOWS = 500_000  # windows in one set: about 60 MB in each task
IS_WORD = np.ones(256, bool)
IS_WORD[:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_NEW = [
    T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", T.ArrayType(T.IntegerType())),
    T.StructField("hit_spans", T.ArrayType(T.IntegerType())), T.StructField("hit_items", T.ArrayType(T.StringType())),
]


@dataclass
class Windows:
    """Windows of one set, ordered by hash: their lengths, items and words."""

    ids: list[str]
    hashes: np.ndarray
    lengths: np.ndarray
    item: np.ndarray
    first: np.ndarray  # first word, as a number into ``words``
    words: list[bytes]
    sieve: np.ndarray  # which values of the hashes' upper 20 bits occur


def _upper(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _words(texts: pa.Array):
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, owner = word_spans(data, offsets, IS_WORD)
    return data, offsets, starts, ends, owner, word_hashes(data, starts, ends)


def _window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    return span_hashes(hashes, first, first + width)


def make_windows(ids: list[str], texts: list[str | None]) -> Windows:
    data, _, starts, ends, owner, hashes = _words(pa.array(texts, pa.string()))
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    count = np.bincount(owner, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
    begin = np.cumsum(count) - count
    first, length, item = [], [], []
    for k, n in enumerate(count):
        width = min(WIDTH, int(n))
        places = range(int(begin[k]), int(begin[k] + n) - width + 1) if n else ()
        first += places
        length += [width] * len(places)
        item += [k] * len(places)
    first, length, item = (np.array(x, np.int64) for x in (first, length, item))
    found = np.empty(first.size, np.uint64)
    for width in np.unique(length):
        found[length == width] = _window_hashes(hashes, first[length == width], int(width))
    order = np.argsort(found, kind="stable")
    sieve = np.zeros(1 << 20, bool)
    sieve[_upper(found)] = True
    return Windows(ids, found[order], length[order], item[order], first[order], words, sieve)


def find_hits(windows: Windows, texts: pa.Array, earlier_ranges: list, earlier_items: list) -> tuple[np.ndarray, list, list, list]:
    """Words per text, and per text the hit word ranges, their code point spans and the hit items."""
    data, offsets, starts, ends, owner, hashes = _words(texts)
    size = len(texts)
    count = np.bincount(owner, minlength=size)
    begin = np.cumsum(count) - count
    ranges = [[(a, b) for a, b in zip(r[::2], r[1::2])] for r in earlier_ranges]
    items = [set(x) for x in earlier_items]
    for width in np.unique(windows.lengths):
        first = np.arange(max(0, starts.size - int(width) + 1))
        first = first[owner[first] == owner[first + int(width) - 1]]
        found = _window_hashes(hashes, first, int(width))
        maybe = windows.sieve[_upper(found)]
        first, found = first[maybe], found[maybe]
        lo, hi = np.searchsorted(windows.hashes, found, "left"), np.searchsorted(windows.hashes, found, "right")
        for i in np.flatnonzero(hi > lo):
            here = None
            for k in range(int(lo[i]), int(hi[i])):
                if windows.lengths[k] != width:
                    continue
                here = here or [data[a:b].tobytes() for a, b in zip(starts[first[i]:first[i] + width], ends[first[i]:first[i] + width])]
                if here == windows.words[windows.first[k]:windows.first[k] + width]:
                    text = int(owner[first[i]])
                    at = int(first[i] - begin[text])
                    ranges[text].append((at, at + int(width)))
                    items[text].add(windows.ids[windows.item[k]])
    spans = []
    for text, hit in enumerate(ranges):
        merged: list[list[int]] = []
        for a, b in sorted(set(hit)):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        ranges[text] = [x for pair in merged for x in pair]
        places: list[int] = []
        if merged:
            point = np.cumsum((data[offsets[text]:offsets[text + 1]] & 0xC0) != 0x80)
            for a, b in merged:
                lo, hi = starts[begin[text] + a] - offsets[text], ends[begin[text] + b - 1] - offsets[text]
                places += [int(point[lo]) - 1, int(point[hi - 1])]
        spans.append(places)
    return count, ranges, spans, [sorted(x) for x in items]


def _sets(benchmark: DataFrame, text: str, item_id: str) -> list[list]:
    """Items in sets of at most MAX_WINDOWS windows; the driver holds one at a time."""
    words = F.size(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    items = benchmark.filter(F.col(text).isNotNull()).select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"), words.cast("long").alias("n"),
    )
    total = items.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // MAX_WINDOWS)
    if parts <= 1:
        return [items] if total else []
    parts *= 2  # so that uneven sets stay below the bound as well
    return [items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k) for k in range(parts)]


def find(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``documents`` with n_words, hit_ranges (words), hit_spans (code points), both flat start-end lists, and hit_items."""
    spark = documents.sparkSession
    names = [f.name for f in _NEW]
    kept = [c for c in documents.columns if c not in names]
    rows = documents.select(*kept)
    sets = _sets(benchmark, item_text, item_id)
    for k in range(max(1, len(sets))):
        found = sets[k].select("id", "text").distinct().collect() if sets else []
        share = spark.sparkContext.broadcast(make_windows([r["id"] for r in found], [r["text"] for r in found]))

        def scan(batch: pa.RecordBatch, share=share, again=k > 0) -> list:
            texts = batch.column(batch.schema.get_field_index(text))
            none = [[] for _ in range(batch.num_rows)]
            before = [batch.column(batch.schema.get_field_index(c)).to_pylist() if again else list(none) for c in ("hit_ranges", "hit_items")]
            count, ranges, spans, items = find_hits(share.value, texts, *before)
            flat = [list_of(pa.array([x for row in rows for x in row], kind), np.array([len(row) for row in rows]))
                    for rows, kind in ((ranges, pa.int32()), (spans, pa.int32()), (items, pa.string()))]
            return [pa.array(count, pa.int64()), *flat]

        rows = map_texts(rows, scan, _NEW, text, keep=kept)
        if len(sets) > 1:
            rows = stage(rows, "decontamination")
    return rows


def report(found: DataFrame) -> DataFrame:
    """``find``'s rows with n_hit, n_items, items_sha256 and contaminated in place of the hit columns."""
    ends = F.filter("hit_ranges", lambda x, i: i % 2 == 1)
    starts = F.filter("hit_ranges", lambda x, i: i % 2 == 0)
    added = F.aggregate(F.zip_with(ends, starts, lambda b, a: b - a), F.lit(0), lambda s, x: s + x).cast("long")
    return found.withColumns({
        "n_hit": added, "n_items": F.size("hit_items").cast("long"), "items_sha256": F.sha2(F.array_join("hit_items", ","), 256),
        "contaminated": added > 0,
    }).drop("hit_ranges", "hit_spans", "hit_items")


def clean_documents(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a hit, unchanged."""
    return find(documents, benchmark, text).filter(F.size("hit_items") == 0).select(*documents.columns)


def remove_spans(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All documents, with the hit spans cut out of their texts."""
    found = find(documents, benchmark, text)
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("hit_spans") / 2).cast("int")), lambda i: F.substring(
            F.col(text), F.coalesce(F.get("hit_spans", (2 * i - 1).cast("int")), F.lit(0)) + 1,
            F.coalesce(F.get("hit_spans", (2 * i).cast("int")), F.length(text)) - F.coalesce(F.get("hit_spans", (2 * i - 1).cast("int")), F.lit(0)),
        ),
    )
    cut = F.when(F.size("hit_spans") > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    return found.withColumn(text, cut).select(*documents.columns)
