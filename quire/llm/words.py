"""Vectorised word scanning and hashing over the UTF-8 buffer of an Arrow string column.

A batch of texts arrives from Spark as one byte buffer plus row offsets, so words of all its rows
are found with a few numpy passes instead of a Python loop.  Hashes are polynomial prefix sums
modulo 2**64 (the multiplier is odd, hence invertible), finished with a 64-bit mixer: any run of
words gets its hash from two prefix values.  Work proceeds in row blocks of about
``BLOCK_BYTES``; one longer text forms a block of its own, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: Lower-cases A-Z and leaves every other byte alone.
LOWER = _lower_table()
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z is lower case.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of an odd 64-bit base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self._base, self._inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self._base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self._inverse, m, 1 << 64))])
        return self.up[:n], self.down[:n]


class RunHash:
    """Hashes runs of values: equal runs get equal hashes wherever they stand."""

    def __init__(self, seed: int):
        self._powers = Powers((seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % (1 << 64) | 1)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self._powers.upto(len(values))
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up, out=out[1:])
        return out

    def between(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self._powers.upto(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Block:
    """Words of consecutive rows ``first .. first + rows``; word i is ``data[starts[i]:ends[i]]``,
    and row r's words are ``bounds[r] .. bounds[r + 1]``."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null rows count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, at least one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def blocks(column: pa.Array, word_bytes: np.ndarray, lower: bool) -> Iterator[Block]:
    raw, offsets = text_buffer(column)
    for lo, hi in row_blocks(offsets):
        off = offsets[lo : hi + 1] - offsets[lo]
        data = raw[offsets[lo] : offsets[hi]]
        if lower:
            data = LOWER[data]
        inside = word_bytes[data]
        edge = off[(off > 0) & (off < len(data))]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[edge] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[edge - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        yield Block(lo, data, starts, ends, np.searchsorted(starts, off), off)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WORD_RUN, LONG_WORD = RunHash(1), 64


def word_hashes(block: Block) -> np.ndarray:
    """A 64-bit hash of each word's bytes.  Polynomials modulo a power of two are weak on long runs, so
    words of over ``LONG_WORD`` bytes are hashed by XXH3.  Equal hashes prove nothing; users compare words."""
    made = _WORD_RUN.between(_WORD_RUN.prefix(_BYTES[block.data]), block.starts, block.ends)
    for i in np.flatnonzero(block.ends - block.starts > LONG_WORD).tolist():
        made[i] = xxhash.xxh3_64_intdigest(block.data[block.starts[i] : block.ends[i]].tobytes())
    return made


def joined(block: Block, word_bytes: np.ndarray = NOT_SPACE) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The block's words with one blank between two of a row, none between rows, and where each begins
    and ends there."""
    keep = word_bytes[block.data]
    inner = np.setdiff1d(np.arange(len(block.starts)), block.bounds[:-1])
    keep[block.starts[inner] - 1] = True
    place = np.cumsum(keep)
    text = np.where(word_bytes, np.arange(256, dtype=np.uint8), np.uint8(32))[block.data[keep]].tobytes()
    return text, place[block.starts] - 1, place[block.ends - 1]


def row_of_words(block: Block) -> np.ndarray:
    return np.repeat(np.arange(block.rows), np.diff(block.bounds))


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """First words of all windows of ``width`` words that stay within one row."""
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(total)
