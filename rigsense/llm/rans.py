"""Token ids as compressed binary blocks: static range asymmetric numeral system, interleaved.

One frequency table over the whole corpus, scaled to 2**SCALE, is shared by all blocks. A block holds
whole documents and is independent of others. Its ids go round robin over lanes, each a 64-bit state
that moves 32-bit words out and in. Every ``CHECK_ROWS`` rows of lanes a checkpoint keeps the states
and the place in the words, so a reader can begin there; each such segment has a checksum.

Block layout, little-endian: header (magic, lanes, documents, ids, segments, words), key of each
document (int64) and whether it is null (uint8), ids of each document (uint32), then per segment the
first word (uint32), crc32 (uint32) and states (uint64 each), then the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20  # bits of the frequency table's total
LANES = 1024  # states that advance together in one numpy step
CHECK_ROWS = 256  # rows of lanes between two checkpoints
MAGIC = b"RANB"
_HEAD = struct.Struct("<4sIIIII")
_CUT = struct.Struct("<III")
_LOW = np.uint64(1 << 31)
_MASK = np.uint64((1 << SCALE) - 1)
_WORD = np.uint64(32)
_BITS = np.uint64(SCALE)


class Frequencies:
    """Scaled frequencies: ids that occur get at least 1, and all sum to 2**SCALE."""

    def __init__(self, counts: np.ndarray):
        """Scale ``counts``, how often each id occurs."""
        counts = np.asarray(counts, np.int64)
        seen = np.flatnonzero(counts)
        if seen.size > 1 << SCALE:
            raise ValueError("more different ids than the frequency table can hold")
        scaled = np.zeros(counts.size, np.int64)
        if seen.size:
            room = (1 << SCALE) - seen.size
            scaled[seen] = 1 + (counts[seen].astype(np.float64) / counts.sum() * room).astype(np.int64)
            scaled[seen[np.argmax(counts[seen])]] += (1 << SCALE) - scaled.sum()
        self._derive(scaled)

    def _derive(self, scaled: np.ndarray) -> None:
        self.each = scaled.astype(np.uint64)
        self.below = (np.cumsum(scaled) - scaled).astype(np.uint64)
        self.owner = np.repeat(np.arange(scaled.size, dtype=np.uint32), scaled)

    def to_bytes(self) -> bytes:
        """The scaled frequency of each id as a uint32, behind the crc32 of them."""
        body = self.each.astype("<u4").tobytes()
        return struct.pack("<I", zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> Frequencies:
        """The table that ``to_bytes`` wrote; raises if it does not match its checksum."""
        if len(raw) < 4 or zlib.crc32(raw[4:]) != struct.unpack_from("<I", raw)[0]:
            raise ValueError("the frequency table is damaged")
        table = cls.__new__(cls)
        table._derive(np.frombuffer(raw, "<u4", offset=4).astype(np.int64))
        return table


def _lanes(n: int) -> int:
    """Lanes for n ids: fewer for a small block, whose states would outweigh its words."""
    return max(1, min(LANES, 1 << max(0, (n // 64).bit_length())))


def encode_block(ids: np.ndarray, keys: list, counts: np.ndarray, table: Frequencies) -> bytes:
    n, lanes = ids.size, _lanes(ids.size)
    rows = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    moved: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    words = 0
    for row in range(rows - 1, -1, -1):
        now = ids[row * lanes:(row + 1) * lanes]
        x = state[:now.size]
        each = table.each[now]
        full = x >= each << np.uint64(63 - SCALE)
        out = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        moved.append(out)
        words += out.size
        x = np.where(full, x >> _WORD, x)
        whole = x // each
        state[:now.size] = (whole << _BITS) + (x - whole * each) + table.below[now]
        if row % CHECK_ROWS == 0:
            marks.append((words, state.copy()))
    parts = [_HEAD.pack(MAGIC, lanes, len(keys), n, len(marks), words)]
    parts.append(np.array([0 if k is None else k for k in keys], "<i8").tobytes())
    parts.append(np.array([k is None for k in keys], np.uint8).tobytes())
    parts.append(np.asarray(counts, "<u4").tobytes())
    for k, (upto, states) in enumerate(reversed(marks)):
        part = ids[k * CHECK_ROWS * lanes:(k + 1) * CHECK_ROWS * lanes]
        parts.append(struct.pack("<II", words - upto, zlib.crc32(part.astype("<u4").tobytes())) + states.astype("<u8").tobytes())
    parts += [w.astype("<u4").tobytes() for w in reversed(moved)]
    return b"".join(parts)


class Block:
    """An encoded block; segments can be read on their own."""

    def __init__(self, raw: bytes):
        magic, self.lanes, documents, self.n, self.segments, words = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = _HEAD.size
        keys = np.frombuffer(raw, "<i8", documents, at)
        empty = np.frombuffer(raw, np.uint8, documents, at + 8 * documents)
        self.keys = [None if e else int(k) for k, e in zip(keys, empty)]
        self.counts = np.frombuffer(raw, "<u4", documents, at + 9 * documents).astype(np.int64)
        self._marks = at + 13 * documents
        self._step = 8 + 8 * self.lanes
        self._raw = raw
        self._words = np.frombuffer(raw, "<u4", words, self._marks + self.segments * self._step)

    def cut(self, k: int) -> bytes:
        """Segment k alone: lanes, ids, crc32, then the states and the words that it reads."""
        at = self._marks + k * self._step
        place, crc = struct.unpack_from("<II", self._raw, at)
        stop = struct.unpack_from("<I", self._raw, at + self._step)[0] if k + 1 < self.segments else self._words.size
        size = min(self.n, (k + 1) * CHECK_ROWS * self.lanes) - k * CHECK_ROWS * self.lanes
        states = self._raw[at + 8:at + self._step]
        return _CUT.pack(self.lanes, size, crc) + states + self._words[place:stop].tobytes()

    def segment(self, k: int, table: Frequencies) -> np.ndarray:
        """The ids of segment k; raises if they don't match its checksum."""
        return decode_segment(self.cut(k), table)

    def ids(self, table: Frequencies) -> np.ndarray:
        parts = [self.segment(k, table) for k in range(self.segments)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def decode_segment(raw: bytes, table: Frequencies) -> np.ndarray:
    """The ids of a segment that ``Block.cut`` took out; raises if they don't match its checksum."""
    lanes, size, crc = _CUT.unpack_from(raw)
    state = np.frombuffer(raw, "<u8", lanes, _CUT.size).copy()
    words = np.frombuffer(raw, "<u4", offset=_CUT.size + 8 * lanes)
    ids = np.empty(size, np.uint32)
    place = 0
    for row in range(0, size, lanes):
        x = state[:min(lanes, size - row)]
        slot = x & _MASK
        now = table.owner[slot]
        ids[row:row + x.size] = now
        x = table.each[now] * (x >> _BITS) + slot - table.below[now]
        low = x < _LOW
        taken = int(np.count_nonzero(low))
        if place + taken > words.size:
            raise ValueError("a segment is damaged")
        x[low] = (x[low] << _WORD) | words[place:place + taken]
        place += taken
        state[:x.size] = x
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a segment is damaged")
    return ids
