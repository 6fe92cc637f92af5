"""What the text operators share: staged tables, Arrow batches as bytes, word spans and hashes, running totals.

Texts are handled as the UTF-8 buffer of an Arrow batch, so that one numpy call works on thousands of
texts. A batch is cut into slices of about ``SLICE_BYTES``; a longer text makes a slice of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigsense.operators.scale import work_dir

SLICE_BYTES = 1 << 20  # bytes of text that one numpy pass handles
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


# ------------------------------------------------------------------------------ staging
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write are freed as soon as it is done.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def running_totals(df: DataFrame, order: Sequence[str], values: Sequence[str], name: str) -> DataFrame:
    """``df`` in the total order ``order``, with ``run_<v>``: the sum of v up to and with each row.

    Rows are dealt by ranges of ``order``, so no key makes a large partition; each range is summed on
    its own and shifted by the totals before it (one row per range goes through the driver).
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), name)
    totals = dealt.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values]).collect()
    before, bases = [0] * len(values), []
    for row in sorted(totals, key=lambda r: r["_part"]):
        bases.append((row["_part"], *before))
        before = [b + row[v] for b, v in zip(before, values)]
    spec = T.StructType([T.StructField("_part", T.IntegerType())] + [T.StructField(f"_base_{v}", T.LongType()) for v in values])
    small = df.sparkSession.createDataFrame(bases, spec)
    window = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"run_{v}": F.sum(v).over(window) for v in values}).join(F.broadcast(small), "_part")
    out = out.withColumns({f"run_{v}": F.col(f"run_{v}") + F.col(f"_base_{v}") for v in values})
    return out.drop("_part", "_seq", *[f"_base_{v}" for v in values])


# ------------------------------------------------------------------------ Arrow batches
def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    if where is None or len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``limit`` bytes together."""
    if batch.num_rows == 0:
        return
    lengths = np.diff(text_bytes(batch.column(batch.schema.get_field_index(text)))[1])
    group = np.cumsum(lengths) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(lo), int(hi - lo))


def map_texts(
    df: DataFrame, fn: Callable[[pa.RecordBatch], list], fields: list[T.StructField], text: str = "text",
    keep: Sequence[str] | None = None, limit: int = SLICE_BYTES,
) -> DataFrame:
    """Append the columns ``fields``, which ``fn`` computes for each slice of a batch.

    An input column with the name of a new one is replaced. ``keep`` names the input columns of the
    result (None: all); the others go to ``fn`` only.
    """
    new = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                old = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays(old + fn(part), names=kept + new)
            pa.default_memory_pool().release_unused()  # two workers share an executor's memory with the JVM

    return df.mapInArrow(run, schema)


def list_of(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from its flat values and the number of values per row."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


# ------------------------------------------------------------------------ words as spans
def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of word bytes; no run crosses two texts."""
    if data.size == 0:
        return (np.empty(0, np.int64),) * 3
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    before[edges[edges < data.size]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or _powers[0].size < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        up, down = np.full(size, _MULTIPLIER), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class SpanHashes:
    """64-bit hashes of codes[start:end] for any spans, from one running sum over all codes.

    The sum of code * m**position up to the end less the one up to the start, times m**-start,
    depends on the span's content only, since m is odd and so invertible modulo 2**64.
    """

    def __init__(self, codes: np.ndarray):
        up, self._down = _power_table(codes.size)
        self._total = np.zeros(codes.size + 1, np.uint64)
        np.cumsum(codes * up[:codes.size], out=self._total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._total[ends] - self._total[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHashes(codes).of(starts, ends)


def byte_hashes(data: np.ndarray) -> SpanHashes:
    return SpanHashes(_BYTE_CODES[data])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return byte_hashes(data).of(starts, ends)


def first_of_runs(keys: np.ndarray) -> np.ndarray:
    """Positions at which the value differs from the one before."""
    if keys.size == 0:
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])


def new_name(stem: str) -> str:
    return f"_{stem}_{uuid.uuid4().hex[:8]}"
