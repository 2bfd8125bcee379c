"""FLAC streams as a media column: encode, decode with checksums, PCM blocks and seek offsets.

A stream here is mono with a fixed block size. Subframes are constant, verbatim, fixed linear
predictors of order 0 to 4, or (decoding only) quantised linear predictors; residuals are Rice
coded with one or more partitions. All frames of a batch advance together: the decoder loops
over sample positions and works on every frame at once, so numpy does the bit work.

Defined cases: a null text is an empty one; an empty payload still yields one padded block;
corrupt frames raise FlacError; equal payloads give equal streams, so repeated rows are equal; very
long texts are stored whole, in pieces of bounded size; an empty table gives no rows; other columns
are ignored, whatever their names. The query writes the media column to the shared folder, reads it
back and describes the PCM blocks that it decodes to.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import text_bytes
from lexmill.session import stash

BLOCK, BITS, RATE = 576, 8, 8000
ESCAPE_K, ORDERS = 15, 5
FRAMES_AT_ONCE = 4096


class FlacError(ValueError):
    """A stream that is not valid, or whose checksums don't hold."""


@lru_cache
def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        v = byte << (bits - 8)
        for _ in range(8):
            v = ((v << 1) ^ poly) & mask if v & top else (v << 1) & mask
        out.append(v)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


def crc8(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-8 of each row's first lengths bytes."""
    table, out = _crc_table(0x07, 8), np.zeros(len(rows), np.uint8)
    for i in range(int(lengths.max(initial=0))):
        out = np.where(i < lengths, table[out ^ rows[:, i]], out)
    return out


@lru_cache
def _crc16_words() -> np.ndarray:
    """CRC-16 after each possible pair of bytes."""
    table, c = _crc_table(0x8005, 16), np.arange(1 << 16).astype(np.uint16)
    for _ in range(2):
        c = (c << np.uint16(8)) ^ table[c >> np.uint16(8)]
    return c


def crc16(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of spans of flat, two bytes of every span at a time. Leading zeros leave this CRC
    as it is, so spans are aligned at their ends."""
    table, width = _crc16_words(), (int(lengths.max(initial=0)) + 1) // 2 * 2
    rows = np.zeros((len(starts), width), np.uint8)
    for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        rows[i, width - n :] = flat[s : s + n]
    out = np.zeros(len(starts), np.uint16)
    for pair in np.ascontiguousarray(rows.view(">u2").astype(np.uint16).T):
        out = table[out ^ pair]
    return out


def _utf8_number(n: int) -> bytes:
    """FLAC's extended UTF-8 coding of a frame number."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size) & 0xFF | n >> (6 * (size - 1)), *tail])


@lru_cache(maxsize=100_000)
def _header(number: int) -> bytes:
    """Frame header: fixed block size 576, rate and depth of the stream info, mono, 8 bits."""
    body = bytes([0xFF, 0xF8, 0x20, 0x02]) + _utf8_number(number)
    c = 0
    table = _crc_table(0x07, 8)
    for b in body:
        c = int(table[c ^ b])
    return body + bytes([c])


def _plan(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each block (0 constant, 1 verbatim, 2+o fixed order o), Rice parameter, residuals
    (order o's warm-up samples lead; constant and verbatim blocks keep their samples). The order
    is the one of the least absolute residuals; its exact size then competes with verbatim."""
    n = len(samples)
    diffs, costs = [samples], [np.abs(samples).sum(axis=1, dtype=np.int32)]
    for _ in range(ORDERS - 1):
        diffs.append(np.diff(diffs[-1], axis=1))
        costs.append(np.abs(diffs[-1]).sum(axis=1, dtype=np.int32))
    order = np.argmin(np.stack(costs), axis=0)
    residuals = samples.copy()
    for o in range(1, ORDERS):
        own = np.flatnonzero(order == o)
        residuals[own, o:] = diffs[o][own]
    zig = (residuals << 1) ^ (residuals >> 15)
    coded = np.arange(BLOCK)[None, :] >= order[:, None]
    zig *= coded
    number = BLOCK - order
    k0 = np.clip(np.floor(np.log2(np.maximum(zig.sum(axis=1, dtype=np.int64) / number * 0.693, 1e-9))), 0, 12).astype(np.int16)
    best, rice = None, k0
    for k in (k0, k0 + 1):
        size = 18 + order * BITS + number * (1 + k) + (zig >> k[:, None].astype(np.int16)).sum(axis=1, dtype=np.int32)
        rice = k if best is None else np.where(size < best, k, rice)
        best = size if best is None else np.minimum(best, size)
    kind = np.where(best < 8 + BLOCK * BITS, order + 2, 1)
    kind = np.where(costs[1] == 0, 0, kind)
    bare = np.flatnonzero(kind < 2)
    residuals[bare] = samples[bare]
    return kind, rice.astype(np.int64), residuals


def _pack(values: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of rows of (value, width) tokens, most significant first; rows end on whole bytes.
    values must fit 32 bits and widths may be any (leading zeros). Returns bytes and row bounds."""
    ends = np.cumsum(widths, axis=1, dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum((ends[:, -1] + 7) // 8)])
    ends += bounds[:-1, None] * 8 - 1  # last bit of each token
    last = ends.ravel()
    keep = np.flatnonzero(values.ravel())
    v, last = values.ravel()[keep].astype(np.uint64), last[keep]
    word, room = last >> 6, (63 - (last & 63)).astype(np.uint64)
    out = np.zeros(bounds[-1] // 8 + 2, np.uint64)
    if len(v):
        heads = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out[word[heads]] = np.add.reduceat(v << room, heads)  # tokens never share bits
        over = np.flatnonzero((v >> (np.uint64(63) - room)) >> np.uint64(1))
        out[word[over] - 1] |= (v[over] >> (np.uint64(63) - room[over])) >> np.uint64(1)
    return out.byteswap().view(np.uint8)[: bounds[-1]], bounds


def encode_blocks(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of rows of BLOCK signed 8-bit samples."""
    kind, rice, residuals = _plan(samples.astype(np.int16))
    n, order = len(samples), kind - 2
    # Tokens: subframe header, then samples; the residual header (method, partition order and
    # Rice parameter: 10 bits) has the place after the warm-up samples.
    residuals = np.insert(residuals, 0, 0, axis=1)
    for o in range(1, ORDERS):
        own = np.flatnonzero(order == o)
        residuals[own, :o] = residuals[own, 1 : o + 1]
    at = np.arange(BLOCK + 1, dtype=np.int16)[None, :]
    slot = np.where(kind >= 2, order, 0).astype(np.int16)[:, None]
    coded = (kind[:, None] >= 2) & (at > slot)
    zig = (residuals << 1) ^ (residuals >> 15)
    k = rice[:, None].astype(np.int16)
    values, widths = np.empty((n, BLOCK + 2), np.int32), np.empty((n, BLOCK + 2), np.int32)
    values[:, 0], widths[:, 0] = np.where(kind == 0, 0, np.where(kind == 1, 1, 8 + order)) << 1, 8
    values[:, 1:] = np.where(coded, (1 << k) | zig & ((1 << k) - 1), residuals & 0xFF)
    widths[:, 1:] = np.where(coded, (zig >> k) + 1 + k, BITS)
    rows = np.arange(n)
    values[rows, slot[:, 0] + 1] = np.where(kind >= 2, rice, 0)
    widths[rows, slot[:, 0] + 1] = np.where(kind >= 2, 10, 0)
    values[kind == 0, 3:] = widths[kind == 0, 3:] = 0
    body, bounds = _pack(values, widths)
    heads = [_header(int(x)) for x in numbers]
    frames = [h + body[a:b].tobytes() for h, a, b in zip(heads, bounds[:-1], bounds[1:], strict=True)]
    flat = np.frombuffer(b"".join(frames), np.uint8)
    lengths = np.array([len(f) for f in frames])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, crc16(flat, starts, lengths), strict=True)]


def stream_head(total: int, sizes: tuple[int, int], md5: bytes, seek: list[tuple[int, int, int]]) -> bytes:
    """Marker, stream info and seek table (sample, byte offset from the first frame, samples)."""
    info = BLOCK.to_bytes(2, "big") * 2 + sizes[0].to_bytes(3, "big") + sizes[1].to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | ((BITS - 1) << 36) | total).to_bytes(8, "big") + md5
    points = b"".join(s.to_bytes(8, "big") + o.to_bytes(8, "big") + c.to_bytes(2, "big") for s, o, c in seek)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points


SEEK_EVERY = 64  # frames between seek points


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the block size."""
    short = -len(payload) % BLOCK if payload else BLOCK
    return payload + b"\xff" * short


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of padded payloads, each byte an unsigned 8-bit sample less 128."""
    counts = [len(p) // BLOCK for p in payloads]
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, int)
    frames: list[bytes] = []
    for at in range(0, len(flat), FRAMES_AT_ONCE):
        frames += encode_blocks(flat[at : at + FRAMES_AT_ONCE].astype(np.int16) - 128, numbers[at : at + FRAMES_AT_ONCE])
    out, at = [], 0
    for payload, c in zip(payloads, counts, strict=True):
        own = frames[at : at + c]
        at += c
        lengths = [len(f) for f in own]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        seek = [(i * BLOCK, int(offsets[i]), BLOCK) for i in range(0, c, SEEK_EVERY)]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        head = stream_head(len(payload), (min(lengths), max(lengths)), hashlib.md5(signed).digest(), seek)
        out.append(head + b"".join(own))
    return out


@dataclass
class Stream:
    """A parsed stream: where its frames lie, and what the stream info promises."""

    data: bytes
    block: int
    bits: int
    total: int
    md5: bytes
    first: int
    seek: list[tuple[int, int, int]]


def parse(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, info, seek = 4, None, []
    while True:
        if at + 4 > len(data):
            raise FlacError("metadata are cut off")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise FlacError("metadata are cut off")
        if kind & 0x7F == 0:
            info = body
        elif kind & 0x7F == 3:
            seek = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
        if kind & 0x80:
            break
    if info is None or len(info) != 34:
        raise FlacError("no stream info")
    packed = int.from_bytes(info[10:18], "big")
    if info[:2] != info[2:4]:
        raise FlacError("variable block sizes are not supported")
    if (packed >> 41) & 7:
        raise FlacError("only mono streams are supported")
    return Stream(data, int.from_bytes(info[:2], "big"), ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1), info[18:], at, seek)


class Bits:
    """Bit cursors of many frames over one flat buffer."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, ends: np.ndarray) -> None:
        padded = np.concatenate([flat, np.zeros(16, np.uint8)])
        words = padded.astype(np.uint64)
        for size in (1, 2, 4):
            words = (words[:-size] << np.uint64(8 * size)) | words[size:]
        self.words, self.at, self.ends = words, at.astype(np.int64) * 8, ends.astype(np.int64) * 8

    def window(self, rows=slice(None)) -> np.ndarray:
        """At least 56 bits from each cursor, left aligned."""
        at = self.at[rows]
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def take(self, width, rows=slice(None)) -> np.ndarray:
        width = np.asarray(width, np.int64)
        got = np.where(width > 0, self.window(rows) >> (64 - np.maximum(width, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)
        self.at[rows] += width
        if (self.at[rows] > self.ends[rows]).any():
            raise FlacError("a frame is cut off")
        return got

    def signed(self, width, rows=slice(None)) -> np.ndarray:
        got = self.take(width, rows)
        return got - ((got >> (np.asarray(width) - 1)) << np.asarray(width))

    def unary(self, rows: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is consumed too."""
        out, todo = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo):
            own = rows[todo]
            w = self.window(own) & ~np.uint64(0xFF)  # 56 sure bits
            zeros = np.where(w == 0, 56, 63 - _log2(w))
            out[todo] += zeros
            done = w != 0
            self.at[own] += zeros + done
            if (self.at[own] > self.ends[own]).any():
                raise FlacError("a frame is cut off")
            todo = todo[~done]
        return out


def _log2(w: np.ndarray) -> np.ndarray:
    """Position of the highest set bit of words that have one."""
    high = w >> np.uint64(32)
    top = np.where(high > 0, high, w & np.uint64(0xFFFFFFFF))
    return (np.frexp(top.astype(np.float64))[1] - 1) + np.where(high > 0, 32, 0)


def _peek(cursor: Bits, rows: np.ndarray, width: int) -> np.ndarray:
    return (cursor.window(rows) >> np.uint64(64 - width)).astype(np.int64)


def _rice_run(cursor: Bits, rows: np.ndarray, k: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The next counts residuals of each row, all with the row's parameter k."""
    out = np.zeros((int(counts.max()), len(rows)), np.int64)
    at, words, one, ku, least = cursor.at[rows], cursor.words, np.uint64(1), k.astype(np.uint64), int(counts.min())
    down, last = np.uint64(63) - ku, len(cursor.words) - 1
    for j in range(len(out)):
        live = slice(None) if j < least else np.flatnonzero(counts > j)
        a = at[live]
        w = words[np.minimum(a >> 3, last)] << (a & 7).astype(np.uint64)
        top = (w >> np.uint64(16)).astype(np.float64)  # exact: 48 bits
        zeros = 1070 - (top.view(np.int64) >> 52)
        far = zeros + k[live] > 40
        if far.any():  # long codes, or none: the general reader
            own = (np.arange(len(rows))[live])[far]
            cursor.at[rows[own]] = a[far]
            q = cursor.unary(rows[own])
            rest = cursor.take(k[own], rows[own])
            zeros[far] = 0
        shifted = w << (zeros.astype(np.uint64) + one)
        z = (zeros << k[live]) | ((shifted >> one) >> down[live]).astype(np.int64)
        a = a + zeros + 1 + k[live]
        if far.any():
            z[far] = (q << k[own]) | rest
            a[far] = cursor.at[rows[own]]
        at[live] = a
        out[j, live] = z
    if (at > cursor.ends[rows]).any():
        raise FlacError("a frame is cut off")
    cursor.at[rows] = at
    return (out >> 1) ^ -(out & 1)


def _undo_fixed(out: np.ndarray, rows: np.ndarray, order: np.ndarray, residuals: np.ndarray, block: int) -> None:
    """Sum residuals up again: order o is o running sums, each started by a warm-up difference."""
    for o in range(ORDERS):
        own = np.flatnonzero(order == o)
        if not len(own):
            continue
        warm, x = out[rows[own], :o], residuals[: block - o, own].T
        starts = [warm]
        for _ in range(o - 1):
            starts.append(np.diff(starts[-1], axis=1))
        for level in range(o - 1, -1, -1):  # the level-th difference, from the one above it
            x = np.cumsum(np.concatenate([starts[level][:, -1:], x], axis=1), axis=1)[:, 1:]
        out[rows[own], o:] = x


FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)


def decode_frames(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Samples of frames [start, end) of flat (whole frames of `block` samples), checksums verified."""
    n = len(starts)
    own = np.concatenate([flat, np.zeros(16, np.uint8)])
    if (ends - starts < 9).any() or not ((own[starts] == 0xFF) & (own[starts + 1] == 0xF8)).all():
        raise FlacError("no frame where one should start")
    heads = own[starts[:, None] + np.arange(16)]
    lead = heads[:, 4]
    utf = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, np.where(lead < 0xFC, 5, np.where(lead < 0xFE, 6, 7))))))
    size_code, rate_code = heads[:, 2] >> 4, heads[:, 2] & 15
    length = 4 + utf + np.where(size_code == 6, 1, np.where(size_code == 7, 2, 0)) + np.where(rate_code == 12, 1, np.where(rate_code > 12, 2, 0))
    if (heads[:, 3] >> 4).any():
        raise FlacError("only mono frames are supported")
    if (crc8(heads, length) != heads[np.arange(n), length]).any():
        raise FlacError("a frame header's checksum is wrong")
    if (crc16(own, starts, ends - starts - 2) != own[ends - 2].astype(np.uint16) * 256 + own[ends - 1]).any():
        raise FlacError("a frame's checksum is wrong")
    cursor = Bits(flat, starts + length + 1, ends - 2)
    lead = cursor.take(np.full(n, 8))
    if (lead & 0x81).any():
        raise FlacError("wasted bits or a bad subframe header")
    kind = lead >> 1
    constant, verbatim = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise FlacError("a reserved subframe type")
    out = np.zeros((n, block), np.int64)
    if constant.any():
        rows = np.flatnonzero(constant)
        out[rows] = cursor.signed(np.full(len(rows), bits), rows)[:, None]
    rows = np.flatnonzero(verbatim)
    for i in range(block if len(rows) else 0):
        out[rows, i] = cursor.signed(np.full(len(rows), bits), rows)
    rows = np.flatnonzero(fixed | lpc)
    if len(rows) and not lpc.any():
        order = kind[rows] - 8
        for i in range(int(order.max())):
            own_rows = rows[order > i]
            out[own_rows, i] = cursor.signed(np.full(len(own_rows), bits), own_rows)
        plain = _peek(cursor, rows, 10)
        easy = (plain >> 4 == 0) & (plain & 15 != 15)  # method 0, one partition, no escape
        if easy.all():
            cursor.at[rows] += 10
            _undo_fixed(out, rows, order, _rice_run(cursor, rows, plain & 15, block - order), block)
            return out
    if not len(rows):
        return out
    order = np.where(fixed, kind - 8, kind - 31)[rows]
    most = int(order.max())
    for i in range(most if lpc.any() else 0):
        own_rows = rows[order > i]
        out[own_rows, i] = cursor.signed(np.full(len(own_rows), bits), own_rows)
    coefs, shift = np.zeros((len(rows), max(1, most)), np.int64), np.zeros(len(rows), np.int64)
    is_fixed = fixed[rows]
    wide = min(4, coefs.shape[1])
    coefs[is_fixed, :wide] = FIXED[order[is_fixed]][:, :wide]
    free = np.flatnonzero(~is_fixed)
    if len(free):
        precision = cursor.take(np.full(len(free), 4), rows[free]) + 1
        shift[free] = cursor.signed(np.full(len(free), 5), rows[free])
        for i in range(int(order[free].max())):
            has = order[free] > i
            coefs[free[has], i] = cursor.signed(precision[has], rows[free[has]])
    method, parts = cursor.take(np.full(len(rows), 2), rows), cursor.take(np.full(len(rows), 4), rows)
    if (method > 1).any() or (block % (1 << parts)).any():
        raise FlacError("a bad residual header")
    width, escape = np.where(method == 0, 4, 5), np.where(method == 0, 15, 31)
    per, k, raw = block >> parts, np.zeros(len(rows), np.int64), np.full(len(rows), -1)
    recent = out[rows]
    simple = bool((parts == 0).all() and is_fixed.all())
    for i in range(block):
        live = np.flatnonzero(order <= i) if i < most else np.arange(len(rows))
        if not len(live):
            continue
        opens = live[(i % per[live] == 0) | (i == order[live])] if not simple or i <= most else live[:0]
        if len(opens):
            k[opens] = cursor.take(width[opens], rows[opens])
            bare = opens[k[opens] == escape[opens]]
            raw[opens] = -1
            if len(bare):
                raw[bare] = cursor.take(np.full(len(bare), 5), rows[bare])
        value = np.zeros(len(live), np.int64)
        riced = np.flatnonzero(raw[live] < 0)
        if len(riced):
            r = live[riced]
            z = (cursor.unary(rows[r]) << k[r]) | cursor.take(k[r], rows[r])
            value[riced] = (z >> 1) ^ -(z & 1)
        plain = np.flatnonzero(raw[live] > 0)
        if len(plain):
            r = live[plain]
            value[plain] = cursor.signed(raw[r], rows[r])
        back = min(i, coefs.shape[1])
        if back:
            past = recent[live, i - back : i][:, ::-1]
            value = value + ((past * coefs[live, :back]).sum(axis=1) >> shift[live])
        recent[live, i] = value
    out[rows] = recent
    return out


def frame_spans(s: Stream) -> tuple[np.ndarray, np.ndarray]:
    """Frames are found by their sync code, header and expected number, not by the seek table."""
    starts, at, number, data = [], s.first, 0, s.data
    while at < len(data):
        starts.append(at)
        number += 1
        if number * s.block >= s.total:
            break
        at = data.find(_header(number), at + 9) if (s.block, s.bits) == (BLOCK, BITS) else _next_frame(data, at, number)
        if at < 0:
            raise FlacError("a frame is missing")
    return np.array(starts, np.int64), np.array([*starts[1:], len(data)], np.int64)


def _next_frame(data: bytes, at: int, number: int) -> int:
    coded, table = _utf8_number(number), _crc_table(0x07, 8)
    while (at := data.find(data[:0] + b"\xff\xf8", at + 2)) >= 0:
        extra = {6: 1, 7: 2}.get(data[at + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
        size, c = 4 + len(coded) + extra, 0
        if data[at + 4 : at + 4 + len(coded)] != coded:
            continue
        for b in data[at : at + size]:
            c = int(table[c ^ b])
        if c == data[at + size]:
            return at
    return -1


def decode(streams: list[bytes]) -> list[bytes]:
    """PCM of streams as signed samples of whole bytes (8-bit ones: one byte each), verified
    against frame checksums, the promised number of samples and the MD5 of the stream info."""
    parsed = [parse(x) for x in streams]
    spans = [frame_spans(s) for s in parsed]
    out: list[bytes] = []
    group: list[int] = []
    held = 0
    for i in range(len(parsed) + 1):
        whole = i == len(parsed)
        if not whole and (parsed[i].total % parsed[i].block):
            raise FlacError("a short last block is not supported")
        if group and (whole or held + len(spans[i][0]) > FRAMES_AT_ONCE or (parsed[i].block, parsed[i].bits) != (parsed[group[0]].block, parsed[group[0]].bits)):
            base = np.cumsum([0, *(len(streams[j]) for j in group)])
            flat = np.frombuffer(b"".join(streams[j] for j in group), np.uint8)
            starts = np.concatenate([spans[j][0] + b for j, b in zip(group, base, strict=False)])
            ends = np.concatenate([spans[j][1] + b for j, b in zip(group, base, strict=False)])
            got = decode_frames(flat, starts, ends, parsed[group[0]].block, parsed[group[0]].bits)
            at = 0
            for j in group:
                own = got[at : at + len(spans[j][0])].ravel()
                at += len(spans[j][0])
                pcm = own.astype(np.int8 if parsed[j].bits <= 8 else "<i2" if parsed[j].bits <= 16 else "<i4").tobytes()
                if len(own) != parsed[j].total or hashlib.md5(pcm).digest() != parsed[j].md5:
                    raise FlacError("the samples don't match the stream info")
                out.append(pcm)
            group, held = [], 0
        if not whole:
            group.append(i)
            held += len(spans[i][0])
    return out


def payload(pcm: bytes) -> bytes:
    """Unsigned bytes of signed 8-bit samples."""
    return (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()


def feature(data: bytes) -> str:
    """Energy, zero crossings of the centred samples and mean step, as fixed decimals."""
    x = np.frombuffer(data, np.uint8).astype(np.float32) - 128
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"rms={float(np.sqrt(np.dot(x, x) / len(x))):.3f};zc={crossings};step={float(np.abs(np.diff(x)).mean()):.3f}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Media column: (key, n_bytes, media) with one FLAC stream a row."""
    schema = docs.select(key).schema.add("n_bytes", "long").add("media", "binary")

    def run(batches):
        for batch in batches:
            for part, data in _slices(batch):
                n = [len(x) for x in data]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(encode([pad(x) for x in data]), pa.binary())], [key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, limit: int = FRAMES_AT_ONCE * BLOCK):
    raw, bounds = text_bytes(batch.column(1))
    raw, at = raw.tobytes(), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), [raw[bounds[i] : bounds[i + 1]] for i in range(at, end)]
        at = end


def blocks_of(pcm: bytes, per_row: int) -> tuple[list[int], list[bytes]]:
    """First samples of the PCM blocks of `per_row` frames each, and the blocks."""
    step = per_row * BLOCK
    at = list(range(0, len(pcm), step))
    return at, [pcm[a : a + step] for a in at]


def pcm_blocks(media: DataFrame, key: str = "doc_id", per_row: int = SEEK_EVERY) -> DataFrame:
    """Rows (key, first_sample, samples, pcm): decoded blocks with seekable sample offsets."""
    schema = media.select(key).schema.add("first_sample", "long").add("samples", "long").add("pcm", "binary")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at, parts = blocks_of(decode([batch.column(1)[row].as_py()])[0], per_row)
                own = batch.column(0).take(pa.array([row] * len(at)))
                yield pa.RecordBatch.from_arrays([own, pa.array(at, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())], [key, "first_sample", "samples", "pcm"])

    return media.select(key, "media").mapInArrow(run, schema)


def write_pcm_blocks(media: DataFrame, path: str, key: str = "doc_id", per_row: int = SEEK_EVERY) -> DataFrame:
    """Write the PCM blocks of a media column as Parquet, and read them back: a sample is found by a
    filter on key and first_sample, which is pushed to the files."""
    pcm_blocks(media, key, per_row).write.options(compression="zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


def samples_at(blocks: DataFrame, key: str, value, first: int, count: int) -> bytes:
    """`count` samples of one stream from `first` on, out of the written blocks that hold them."""
    near = (F.col("first_sample") < first + count) & (F.col("first_sample") + F.col("samples") > first)
    held = sorted((r["first_sample"], bytes(r["pcm"])) for r in blocks.where((F.col(key) == value) & near).distinct().collect())
    return b"".join(pcm for _, pcm in held)[first - held[0][0] :][:count] if held else b""


def seek(data: bytes, sample: int) -> tuple[int, bytes]:
    """First sample and PCM of the block that holds `sample`, through the seek table."""
    s = parse(data)
    if not 0 <= sample < s.total:
        raise FlacError("no such sample")
    point = max((p for p in s.seek if p[0] <= sample), default=(0, 0, 0))
    number, at = point[0] // s.block, s.first + point[1]
    while True:
        last = (number + 1) * s.block >= s.total
        end = len(data) if last else data.find(_header(number + 1), at + 9)
        if (number + 1) * s.block > sample:
            break
        number, at = number + 1, end
    got = decode_frames(np.frombuffer(data, np.uint8), np.array([at]), np.array([end]), s.block, s.bits)
    return number * s.block, got[0].astype(np.int8).tobytes()


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, last_block_at long"


def digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decode each stream to PCM blocks and describe what was read back: the payload that the blocks
    join to, the stored form, features, the number of blocks and the last one's sample offset."""
    names = [key, *(x.split()[0] for x in DIGESTS.split(", "))]
    schema = media.select(key).schema
    for x in DIGESTS.split(", "):
        schema = schema.add(*x.split())

    def run(batches):
        for batch in batches:
            at = 0
            streams = batch.column(2).to_pylist()
            while at < len(streams):
                end, held = at, 0
                while end < len(streams) and (end == at or held + len(streams[end]) < FRAMES_AT_ONCE * BLOCK // 2):
                    held += len(streams[end])
                    end += 1
                blocks = [blocks_of(p, SEEK_EVERY) for p in decode(streams[at:end])]
                own = [payload(b"".join(parts)) for _, parts in blocks]
                columns = [
                    batch.column(0).slice(at, end - at),
                    batch.column(1).slice(at, end - at),
                    pa.array([len(p) for p in own], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in own]),
                    pa.array([zlib.crc32(p[-32:]) for p in own], pa.int64()),
                    pa.array([len(x) for x in streams[at:end]], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in streams[at:end]]),
                    pa.array([feature(p) for p in own]),
                    pa.array([len(offsets) for offsets, _ in blocks], pa.int64()),
                    pa.array([offsets[-1] for offsets, _ in blocks], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                at = end

    return media.select(key, "n_bytes", "media").mapInArrow(run, schema)


#: Rice codes of text still have patterns, which a slower setting of the files' codec finds.
STORED = {"parquet.compression.codec.zstd.level": "9"}


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digests(stash(store(docs), "media", **STORED))
