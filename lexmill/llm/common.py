"""Numeric kernels over Arrow text columns, shared by the corpus operators.

Word and window hashes are polynomial prefix sums modulo 2**64, so one pass of vector
arithmetic hashes every word and every window of a piece of text. Pieces bound memory: a
piece holds whole documents of about ``PIECE_BYTES`` together (a longer document is a piece
of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
U64 = np.uint64
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the bounds of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = (column if pa.types.is_binary(column.type) else column.cast(pa.large_string())).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text (single longer rows alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, bounds = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


@lru_cache(maxsize=None)
def _powers(log2: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (at least)."""
    return _powers(max(12, int(n).bit_length()), base)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64-bit words."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def _separators(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


#: Space and the control characters 9 to 13.
BLANKS = _separators([0x20, *range(0x09, 0x0E)])


class Words:
    """Words of a piece: byte spans, document of each word, and first word of each document."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray = BLANKS) -> None:
        self.raw, self.bounds = raw, bounds
        inside = np.empty(len(raw) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(separators[raw], out=inside[1:-1])
        opens = inside[1:] & ~inside[:-1]  # by byte, with one beyond the end
        closes = ~inside[1:] & inside[:-1]
        seams = bounds[1:-1]
        seams = seams[(seams > 0) & (seams < len(raw))]
        touching = seams[inside[seams] & inside[seams + 1]]
        opens[touching] = True
        closes[touching] = True
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes)
        self.firsts = np.searchsorted(self.starts, bounds)  # word bounds of documents
        self.counts = np.diff(self.firsts)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends, which)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; which picks one of four independent families."""
    up, down = powers(len(raw) + 1, BASES[which])
    prefix = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of spans of word hashes."""
    up, down = powers(len(words) + 1, BASES[(which + 2) % 4])
    prefix = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def rolling(firsts: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word spans of every window of `size` words inside one document, and the window bounds
    of documents. With short, a document of 1 to size-1 words has one window of all its words."""
    counts = np.diff(firsts)
    n = np.maximum(counts - size + 1, 0)
    if short:
        n = np.where((counts > 0) & (counts < size), 1, n)
    bounds = np.concatenate([[0], np.cumsum(n)])
    starts = np.arange(bounds[-1]) + np.repeat(firsts[:-1] - bounds[:-1], n)
    ends = np.minimum(starts + size, np.repeat(firsts[1:], n))
    return starts, ends, bounds


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one blank after each, and the bounds of texts."""
    codes = np.frombuffer("".join(f"{t} " for t in texts).encode("utf-32-le"), np.uint32)
    return codes, np.cumsum([0, *(len(t) + 1 for t in texts)])


class Bloom:
    """A Bloom filter of fixed size over 64-bit keys: safe to broadcast at any data size.

    It only ever saves work: keys it lets through wrongly take the exact path.
    """

    BITS = 1 << 25  # 4 MiB, whatever the number of keys

    @staticmethod
    def positions(keys: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
        a = mix(keys.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15))
        b = mix(a + U64(0xA0761D6478BD642F)) | U64(1)
        return tuple(((a + U64(i) * b) % U64(bits)).astype(np.int64) for i in range(4))

    @staticmethod
    def build(df, key: str, bits: int | None = None) -> np.ndarray:
        """Bits of the integer column `key` of df; the driver receives at most bits/8 bytes a part."""
        bits = bits or Bloom.BITS

        def part(batches):
            held = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                for p in Bloom.positions(keys, bits):
                    np.bitwise_or.at(held, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))
            used = np.flatnonzero(held.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(held.view(np.int64)[used])], ["word", "bits"])

        from pyspark.sql import functions as F

        merged = df.select(key).mapInArrow(part, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        table = merged.toArrow()
        out = np.zeros(bits // 64, np.int64)
        out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
        return out.view(np.uint8)

    @staticmethod
    def might_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
        bits, out = len(held) * 8, np.ones(len(keys), bool)
        for p in Bloom.positions(keys, bits):
            out &= (held[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def buckets(spark, gigabytes_hint: float | None = None) -> int:
    """Number of hash buckets: that of shuffle partitions, which the cluster sizes for the data."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
