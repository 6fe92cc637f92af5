"""Corpora as files of token ids, in ascending key order, and their reading back.

``write`` tokenizes each row once, counts ids over the whole corpus, deals the rows by ranges of the
key, and encodes each range as a run of blocks (see ``rans``). A folder holds two Parquet tables, so that
any store Spark reaches will do: ``frequencies``, one row with the shared frequency table and its
checksum, and ``blocks`` (part, block, before: ids of the part's blocks ahead, n_docs, n_ids, body). The
folder is all that ``read`` needs, also in another session: it cuts blocks at their checkpoints, deals the
segments over the tasks, decodes each on its own and joins documents that reach over segments.

Defined results: a null text is an empty one; every row has at least the end id. A null key sorts
first. Rows with equal keys follow each other, ordered by their ids. An empty table makes an empty
folder. Columns beside key and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigsense.llm.base import stage, text_bytes
from rigsense.llm.rans import CHECK_ROWS, Block, Frequencies, decode_segment, encode_block
from rigsense.llm.tokens import token_rows, unpack
from rigsense.operators.scale import work_dir

PART_IDS = 4 << 20  # ids in a range of keys
BLOCK_IDS = 1 << 20  # ids after which a block is closed; only a longer document makes a larger one
MAX_PARTS = 20_000  # ranges, so that their totals fit the driver; beyond that, ranges grow
_BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("before", T.LongType()),
    T.StructField("n_docs", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("body", T.BinaryType()),
])
_SEGMENT = "at long, ids_at long, keys array<long>, counts array<long>, body binary"
_PART = "doc_id long, start long, n_tokens long, ids_crc32 long, ids_at long, ids binary"


def count_ids(rows: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole corpus; one partial count per id and task is shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            wide = np.diff(ends) == 4 * np.asarray(batch.column(0))
            for kind, inside in (("<u2", ~wide), ("<u4", wide)):
                body = data if inside.all() else data[np.repeat(inside, np.diff(ends))]
                found = np.bincount(body.view(kind), minlength=total.size)
                found[:total.size] += total
                total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counted = rows.select("n_tokens", "ids").mapInArrow(partial, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    return counts


def write(documents: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", path: str | None = None) -> str:
    """Write ``documents`` as token files below ``path`` (None: a new folder in the shared one); returns the path."""
    spark = documents.sparkSession
    rows = stage(token_rows(documents, tokenizer, end_id, text, key), "token-rows")
    counts = count_ids(rows)
    frequencies = Frequencies(counts)
    table = spark.sparkContext.broadcast(frequencies)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            body = encode_block(np.concatenate(held), keys, [x.size for x in held], table.value)
            columns = [[part], [block], [before], [len(keys)], [size], [body]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_BLOCKS.names)

        for batch in batches:
            for k, n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                keys.append(k)
                held.append(unpack(body.as_py(), n))
                size += n
                if size >= BLOCK_IDS:
                    yield close()
                    keys, held, size, block, before = [], [], 0, block + 1, before + size
        if keys:
            yield close()

    parts = int(min(MAX_PARTS, max(1, -(-int(counts.sum()) // PART_IDS))))
    order = ["doc_id", "n_tokens", "ids"]
    dealt = rows.repartitionByRange(parts, "doc_id", "n_tokens").sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    path = path or work_dir(spark, "token-files")
    spark.createDataFrame([(bytearray(frequencies.to_bytes()),)], "body binary").coalesce(1).write.parquet(f"{path}/frequencies")
    dealt.mapInArrow(blocks, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_frequencies(spark: SparkSession, path: str) -> Frequencies:
    """The shared frequency table of the folder ``path``, checked against its checksum."""
    return Frequencies.from_bytes(bytes(spark.read.schema("body binary").parquet(f"{path}/frequencies").first()["body"]))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segment of each block (at, body): where its ids begin, and the documents it holds ids of."""
    for batch in batches:
        for at, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            block = Block(body.as_py())
            stops = np.cumsum(block.counts)
            step = CHECK_ROWS * block.lanes
            for k in range(block.segments):
                lo, hi = k * step, min(block.n, (k + 1) * step)
                first, last = np.searchsorted(stops, lo, side="right"), np.searchsorted(stops, hi) + 1
                columns = [
                    pa.array([at + int(stops[first] - block.counts[first])]), pa.array([at + lo]),
                    pa.array([block.keys[first:last]], pa.list_(pa.int64())), pa.array([block.counts[first:last].tolist()], pa.list_(pa.int64())),
                    pa.array([block.cut(k)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "ids_at", "keys", "counts", "body"])


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    Only the ids of documents that reach over a checkpoint are shuffled, unless ``ids`` are asked for.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # at most MAX_PARTS rows
    bases, at = [], 0
    for r in sorted(totals, key=lambda r: r["part"]):
        bases.append((r["part"], at))
        at += r["n"]
    base = spark.createDataFrame(bases, "part int, base long")
    placed = blocks.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("at"), "body")
    table = spark.sparkContext.broadcast(read_frequencies(spark, path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids_at, keys, counts, body in zip(*(batch.column(c) for c in range(5))):
                ids = decode_segment(body.as_py(), table.value).astype("<u4").tobytes()
                at, ids_at, keys, counts = at.as_py(), ids_at.as_py(), keys.as_py(), np.array(counts.as_py(), np.int64)
                starts = at + np.cumsum(counts) - counts
                lo, hi = np.maximum(starts, ids_at), np.minimum(starts + counts, ids_at + len(ids) // 4)
                bodies = [ids[4 * a:4 * b] for a, b in zip(lo - ids_at, hi - ids_at)]
                whole = hi - lo == counts
                columns = [
                    pa.array(keys, pa.int64()), pa.array(starts), pa.array(counts),
                    pa.array([zlib.crc32(b) if w else None for b, w in zip(bodies, whole)], pa.int64()), pa.array(lo),
                    pa.array([b if with_ids or not w else None for b, w in zip(bodies, whole)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids_at", "ids"])

    dealt = placed.mapInArrow(_segments, _SEGMENT).repartition("ids_at")
    parts = dealt.mapInArrow(decode, _PART)
    found = parts.groupBy("start").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("ids_crc32").alias("ids_crc32"),
        F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("ids_at", "ids")))).alias("ids"))
    ids = F.aggregate("ids", F.lit(bytearray()), lambda whole, part: F.concat(whole, part["ids"]))
    found = found.withColumn("ids", ids)
    return found.select("doc_id", "start", "n_tokens", F.coalesce("ids_crc32", F.crc32("ids")).alias("ids_crc32"), *["ids"] * with_ids)
