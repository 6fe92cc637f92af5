"""Token ids of whole texts by a public tokenizer.

The library takes words apart one by one, so a text is cut where its rules always cut: at a blank or a
line feed with no white space on either side, and between a letter a-z and a full stop, comma, colon,
semicolon, question or exclamation mark. Pieces are known by two 64-bit hashes, and a worker keeps the
ids of pieces it has seen in a table of fixed size; the library gets each new piece once. A place next
to other white space is no cut, so such pieces go to the library as they are.

Defined results: a null text is an empty one and has no ids.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigsense.llm.base import WHITE, SpanHashes, map_texts, text_bytes

TABLE_BITS = 21  # slots of a worker's table of known pieces: about 60 MB with their ids
BATCH = 20_000  # pieces per call of the library
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,:;?!")] = True
_CODES = np.random.default_rng(21).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class KnownPieces:
    """Ids of pieces by hash: an open-addressing table whose lookups and inserts are whole-array steps."""

    def __init__(self, bits: int = TABLE_BITS):
        self.mask = (1 << bits) - 1
        self.limit = (1 << bits) * 6 // 10
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros((2, self.mask + 1), np.uint64)  # 0: free
        self.begin = np.zeros(self.mask + 1, np.int32)
        self.size = np.zeros(self.mask + 1, np.int32)
        self.ids = np.empty(0, np.uint32)
        self.count = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each piece, or -1."""
        out = np.full(hashes.shape[1], -1, np.int64)
        open_ = np.arange(out.size)
        slot = (hashes[0] & np.uint64(self.mask)).astype(np.int64)
        while open_.size:
            held = self.hashes[0][slot]
            same = (held == hashes[0][open_]) & (self.hashes[1][slot] == hashes[1][open_])
            out[open_[same]] = slot[same]
            go = ~same & (held != 0)
            open_, slot = open_[go], (slot[go] + 1) & self.mask
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add pieces that are different from each other and not in the table."""
        begin = self.ids.size + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, ids])
        open_ = np.arange(sizes.size)
        slot = (hashes[0] & np.uint64(self.mask)).astype(np.int64)
        while open_.size:
            free = self.hashes[0][slot] == 0
            first = np.zeros(open_.size, bool)
            first[np.unique(slot, return_index=True)[1]] = True  # of pieces that want one slot, the first gets it
            won = free & first
            at, who = slot[won], open_[won]
            self.hashes[:, at] = hashes[:, who]
            self.begin[at], self.size[at] = begin[who], sizes[who]
            open_, slot = open_[~won], np.where(free[~won], slot[~won], (slot[~won] + 1) & self.mask)
        self.count += sizes.size


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of this worker, whether it drops white space, and the pieces it has seen so far."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
    tokenizer = Tokenizer.from_file(path)
    drops = all(tokenizer.encode(f" {x}").ids == tokenizer.encode(x).ids for x in ("a", ".", ""))
    return tokenizer, drops, KnownPieces()


def _edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places at which the texts are cut into pieces, the first and last included."""
    white = WHITE[data]
    free = np.zeros(data.size, bool)  # no white space on either side
    free[1:-1] = ~white[:-2] & ~white[2:]
    for found in _WIDE_SPACE.finditer(data):
        free[max(found.start() - 1, 0)] = False
        free[min(found.end(), data.size - 1)] = False
    inner = offsets[(offsets > 0) & (offsets < data.size)]
    free[inner] = False
    free[inner - 1] = False
    cut = np.zeros(data.size + 1, bool)
    cut[:-1] = (data == 32) & free
    cut[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    lines = np.flatnonzero((data == 10) & free)
    cut[lines] = True
    cut[lines + 1] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts, one after the other, and the number of ids of each text."""
    data, offsets = text_bytes(texts)
    if data.size == 0:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    tokenizer, drops, known = load(path)
    edges = _edges(data, offsets)
    starts, ends = edges[:-1], edges[1:]
    if drops:
        starts = starts + (data[starts] == 32)
    hashes = np.stack([SpanHashes(codes[data]).of(starts, ends) | np.uint64(1) for codes in _CODES])
    slots = known.find(hashes)
    new = np.flatnonzero(slots < 0)
    if new.size:
        once = new[np.unique(hashes[0][new] * np.uint64(3) + hashes[1][new], return_index=True)[1]]
        if known.count + once.size > known.limit:
            known.clear()
            once = np.unique(hashes[0] * np.uint64(3) + hashes[1], return_index=True)[1]
        if once.size > known.limit:
            known = KnownPieces(int(once.size).bit_length() + 1)  # one huge text
        found: list[bytes] = []
        for lo in range(0, once.size, BATCH):
            words = [data[a:b].tobytes().decode() for a, b in zip(starts[once[lo:lo + BATCH]], ends[once[lo:lo + BATCH]])]
            found += [np.array(made.ids, np.uint32).tobytes() for made in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        known.add(hashes[:, once], np.frombuffer(b"".join(found), np.uint32), sizes)
        slots = known.find(hashes)
    lengths = known.size[slots]
    stops = np.cumsum(lengths)
    place = np.repeat(known.begin[slots] - (stops - lengths).astype(np.int32), lengths)
    place += np.arange(stops[-1], dtype=np.int32)
    upto = np.concatenate([[0], stops])
    return known.ids[place], np.diff(upto[np.searchsorted(edges, offsets)])


def id_width(path: str, end_id: int) -> int:
    """Bytes that hold any id of this tokenizer."""
    return 2 if max(load(path)[0].get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def unpack(body: bytes, n: int) -> np.ndarray:
    """The ids of a body written by ``token_rows``."""
    return np.frombuffer(body, "<u4" if n and len(body) // n == 4 else "<u2").astype(np.uint32)


def token_bodies(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, list[bytes]]:
    """The number of ids of each text and the ids (little-endian, of two bytes if the vocabulary allows, else four), with the end id."""
    ids, counts = encode(texts, path)
    stops = np.cumsum(counts + 1)
    whole = np.full(ids.size + counts.size, end_id, f"<u{id_width(path, end_id)}")
    inner = np.ones(whole.size, bool)
    inner[stops - 1] = False
    whole[inner] = ids
    return counts + 1, [whole[stop - n - 1:stop].tobytes() for stop, n in zip(stops, counts)]


def token_rows(documents: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and ids as in ``token_bodies``."""

    def run(batch: pa.RecordBatch) -> list:
        counts, bodies = token_bodies(batch.column(batch.schema.get_field_index("_text")), path, end_id)
        return [pa.array(counts), pa.array(bodies, pa.binary())]

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return map_texts(rows, run, fields, "_text", keep=["doc_id"])
