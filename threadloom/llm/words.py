"""Words of whole Arrow text batches, found and hashed with numpy. Runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at a time; a longer text is handled alone and whole.
PIECE = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _fmix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the usual finaliser of a multiplicative hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values belong to words: those outside the given inclusive ranges."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


# Words `[^\x20\x09-\x0D]+`. Bytes of other characters in UTF-8 are never below 0x80.
BY_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
# Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
BY_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MIX = _fmix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


def pieces(texts: pa.Array, limit: int = PIECE, rows: int = 60_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows: (first row, last row, bytes, offsets of the run's rows). Null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        stop = min(max(stop, at + 1), at + rows, len(texts))
        yield at, stop, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


class Words:
    """Word starts, ends, hashes, and for each text the range of its words (``bounds``)."""

    __slots__ = ("bounds", "ends", "hashes", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
        data = LOWER[data]
        inside = letters[data]
        filled = offsets[:-1] < offsets[1:]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        if len(self.starts) == 0:
            self.hashes = np.empty(0, np.uint64)
            return
        nth = np.arange(len(data), dtype=np.int64)
        nth -= np.repeat(np.append(0, self.starts), np.diff(np.concatenate(([0], self.starts, [len(data)]))))
        lengths = self.ends - self.starts
        power = np.full(int(lengths.max()) + 1, _ODD, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        value = _MIX[data] * power[np.minimum(nth, len(power) - 1)]
        value[~inside] = 0
        self.hashes = _fmix(np.add.reduceat(value, self.starts) + lengths.astype(np.uint64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, by the place of its first word; shorter than ``hashes`` by n - 1."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    factor = 1
    for i in range(n):
        factor = (factor * int(_ODD) + 2 * n) % (1 << 64)
        total += hashes[i : len(hashes) - n + 1 + i] * np.uint64(factor | 1)
    return _fmix(total)
