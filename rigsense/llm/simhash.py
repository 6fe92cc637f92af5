"""Near duplicates by 64-bit SimHash and pigeonhole blocks.

Texts are lower-cased (A-Z), cut into words at white space and hashed by shingles of three words. A bit
of the fingerprint is set if it is set in over half the shingle hashes. Two fingerprints link at
``DISTANCE`` or fewer differing bits. Of six blocks of bits, three or more are then equal, so for each of
the 20 choices of three blocks, fingerprints are joined on these blocks and compared bit by bit.

Only different fingerprints are joined. A block value shared by more than ``CROWD`` of them is not paired
out: the bits outside the blocks are flipped in all ways up to two, which makes a fixed number of rows
for each fingerprint. Two fingerprints are within three bits if and only if one reaches, with one flip
or none, a value that the other reaches with two or fewer; so at each value, all who reach it link to
the smallest of those that needed one flip or none.

Defined results: a null text or one without words has fingerprint zero, and links like any other. Fewer
words than a shingle make one shingle. Rows with a null key keep their place; a component's id is its
smallest key that is not null. Repeated rows each get their row. An empty table gives an empty result;
columns named like an output are replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigsense.llm.base import map_texts, stage, text_bytes
from rigsense.llm.graph import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
EDGES = [0, 11, 22, 33, 44, 54, 64]  # six blocks of bits
CROWD = 256  # fingerprints with equal blocks that are still compared pair by pair
_MARK = np.arange(64, dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks() -> list[int]:
    """The bits of each choice of three blocks."""
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(EDGES, EDGES[1:])]
    return [block[a] | block[b] | block[c] for a, b, c in combinations(range(len(block)), len(block) - DISTANCE)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned integer."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for lo in range(0, hashes.size, 1 << 14):
        bits = np.unpackbits(hashes[lo:lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.bitwise_or.reduce((counts * 2 > hashes.size).astype(np.uint64) << _MARK))


def fingerprints(documents: DataFrame, name: str, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``documents`` with the fingerprint as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> list:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        raw = data.tobytes()
        found = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return [pa.array(np.array(found, np.uint64).view(np.int64))]

    return map_texts(documents, run, [T.StructField(name, T.LongType())], text, keep=keep)


def _flips(spark: SparkSession) -> DataFrame:
    """For each choice of blocks, all ways to flip up to two of the other bits: choice, flips, mask. A fixed table."""
    rows = []
    for choice, mask in enumerate(_masks()):
        free = [1 << i for i in range(64) if not mask >> i & 1]
        rows += [(choice, 0, 0)] + [(choice, 1, _signed(a)) for a in free] + [(choice, 2, _signed(a | b)) for a, b in combinations(free, 2)]
    return spark.createDataFrame(rows, "choice int, flips int, mask long")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) whose components are those of all fingerprints within DISTANCE bits. ``prints``: fp, each once."""
    choices = F.array(*[F.struct(F.lit(k).alias("choice"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(_masks())])
    rows = prints.select("fp", F.explode(choices).alias("c")).select("fp", "c.choice", F.col("fp").bitwiseAND(F.col("c.mask")).alias("block"))
    sizes = rows.groupBy("choice", "block").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(rows.join(sizes, ["choice", "block"]), "simhash-blocks")
    few = shared.filter(F.col("n") <= crowd)
    a, b = few.select("choice", "block", F.col("fp").alias("u")), few.select("choice", "block", F.col("fp").alias("v"))
    near = a.join(b, ["choice", "block"]).filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)).select("u", "v")
    many = shared.filter(F.col("n") > crowd)
    if many.isEmpty():
        return near
    moved = many.join(F.broadcast(_flips(prints.sparkSession)), "choice").select(
        "choice", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"), "fp", "flips",
    )
    window = Window.partitionBy("choice", "value")  # no more members than there are ways to flip
    hub = F.min(F.when(F.col("flips") <= 1, F.col("fp"))).over(window)
    return near.union(moved.withColumn("hub", hub).filter("hub is not null and hub != fp").select(F.col("hub").alias("u"), F.col("fp").alias("v")))


def classes(prints: DataFrame, fp: str, key: str) -> DataFrame:
    """(fp, root, component_id) for every different fingerprint: root names the component."""
    each = stage(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least")), "simhash-prints")
    roots = components(links(each.select("fp")))
    named = each.join(roots, each["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prints = stage(fingerprints(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), "fp", "_text", ["doc_id"]), "simhash")
    found = classes(prints, "fp", "doc_id")
    return prints.join(found, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component: that with the smallest key, of rows with equal keys any one."""
    rows = stage(fingerprints(documents.withColumn("_row", F.monotonically_increasing_id()), "_fp", text), "simhash")
    light = rows.select("_row", "_fp", key)
    found = classes(light, "_fp", key).select(F.col("fp").alias("_fp"), "root")
    best = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "_row"))
    kept = light.join(found, "_fp").groupBy("root").agg(best.alias("best")).select(F.col("best._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*documents.columns)
