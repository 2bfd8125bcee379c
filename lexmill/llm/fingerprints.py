"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes sets chunk boundaries, with a strict mask below the normal
size and a loose one above it (normalised chunking), between a least and a greatest size. A
fingerprint is the set of chunk digests with their lengths; containment is the shared length
over the smaller fingerprint's. Boundaries depend on content alone, so shifted text keeps them.

Defined cases: a null text is an empty one; an empty text has the empty fingerprint, which is
like another empty one by 1 and like any other by 0; rows with equal or null doc_id keep a fixed
order (nulls first, then by text); the last document's next one is the first, which with a single
row is the row itself; an empty table gives no rows; very long texts are cut whole; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import PIECE_BYTES, buckets, mix, pieces, span_hashes

LEAST, USUAL, MOST = 16, 64, 256
STRICT, LOOSE = 7, 5  # leading zero bits asked of the hash below and above the usual size
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
NONE = -(1 << 63)


def gear(raw: np.ndarray) -> np.ndarray:
    """Gear hash of the 16 bytes that end at each byte, by doubling."""
    h = GEAR[raw]
    for s in (1, 2, 4, 8):
        more = h.copy()
        more[s:] += h[:-s] << np.uint32(s)
        h = more
    return h


def chunk_ends(size: int, at: list[int], strict: list[bool]) -> list[int]:
    """Ends of chunks of a text of `size` bytes; at: ends whose hash passes the loose mask. The
    window of an end lies inside its document, as no chunk is shorter than the window."""
    out, start = [], 0
    for p, hard in zip(at, strict, strict=True):
        while p - start > MOST:
            start += MOST
            out.append(start)
        if p - start >= USUAL or hard and p - start >= LEAST:
            out.append(p)
            start = p
    while size - start > MOST:
        start += MOST
        out.append(start)
    if size > start:
        out.append(size)
    return out


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct entries of each text: 48 bits of digest over 16 bits of length."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    if not len(raw):
        return [np.zeros(0, np.uint64) for _ in texts]
    h = gear(raw)
    cut = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE)))
    hard = (h[cut] < np.uint32(1 << (32 - STRICT))).tolist()
    cut += 1
    where = np.searchsorted(cut, bounds, "right")
    ends, counts = [], []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        lo, hi = where[i], where[i + 1]
        own = chunk_ends(int(b - a), (cut[lo:hi] - a).tolist(), hard[lo:hi])
        counts.append(len(own))
        ends.append(np.array(own, np.int64) + a)
    end = np.concatenate(ends).astype(np.int64)
    start = np.concatenate([[0], end[:-1]])
    entry = (span_hashes(raw, start, end) & np.uint64(0xFFFFFFFFFFFF0000)) | (end - start).astype(np.uint64)
    return [np.unique(x) for x in np.split(entry, np.cumsum(counts)[:-1])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment weighted by chunk length, of the smaller in the larger."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weight = np.uint64(0xFFFF)
    shared = int((np.intersect1d(a, b, assume_unique=True) & weight).sum())
    return shared / min(int((a & weight).sum()), int((b & weight).sum()))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def show(entries: np.ndarray) -> str:
    return entries.astype(">u8").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of `text` added (a column of that name is replaced)."""
    kept = [c for c in docs.columns if c != name]
    at = kept.index(text)

    def run(batches):
        for batch in pieces(batches, text):
            found = fingerprints([(x or "").encode() for x in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([show(x) for x in found])], [*kept, name])

    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add(name, "string"))


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text, tail) range partitioned and sorted by key. Bounds are keys of rows, and a
    bound's first row also ends the partition before, as its tail: each row's next one is beside it
    without a global window. The first row of all ends the last partition. A task sends one row a
    piece and tail, whatever the number of rows of that key."""
    n = buckets(docs.sparkSession)
    keyed = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text), F.coalesce(F.col(key).cast("long"), F.lit(NONE)).alias("__k"))
    row = keyed.agg(F.min("__k").alias("least"), F.percentile_approx("__k", [i / n for i in range(1, n)], 100 * n).alias("q")).first()
    bounds = np.array(sorted({q for q in row["q"] or [] if q > row["least"]}), np.int64)  # as many as partitions
    least, last = row["least"], len(bounds)

    def foremost(batch, k, rows):
        """Of rows of one key, that of the least text."""
        found: dict[int, tuple[bytes, int]] = {}
        for row in rows.tolist():
            own = (batch.column(1)[row].as_py().encode(), row)
            found[k[row]] = min(own, found.get(k[row], own))
        return np.array([row for _, row in found.values()], np.int64)

    def deal(batches):
        for batch in pieces(batches, text):
            k = batch.column(2).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, k, "right")
            again = foremost(batch, k, np.flatnonzero((part > 0) & (k == bounds[np.maximum(part, 1) - 1]))) if last else np.zeros(0, np.int64)
            first = foremost(batch, k, np.flatnonzero(k == least))
            rows = np.concatenate([np.arange(len(k)), again, first])
            tail = np.concatenate([np.zeros(len(k), np.int32), np.ones(len(again) + len(first), np.int32)])
            to = np.concatenate([part, part[again] - 1, np.full(len(first), last)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(tail), pa.array(to)], ["key", "text", "__k", "tail", "part"])

    schema = keyed.select(F.col(key).alias("key"), F.col(text).alias("text"), "__k").schema.add("tail", "integer").add("part", "integer")
    dealt = keyed.mapInArrow(deal, schema)
    return dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("tail", "__k", "text")


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of runs of rows, with one text more than keys: the next row's."""
    keys: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for key, text, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if tail:
                if keys:
                    yield keys, [*texts, text]
                return
            if held > PIECE_BYTES:
                yield keys, [*texts, text]
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(text)
            held += len(text)
    if keys:
        raise ValueError("a partition has no tail")


COLUMNS = (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of its text edited with the next row's, and likenesses."""
    schema = docs.select(key).schema
    for column in COLUMNS:
        schema = schema.add(*column)

    def run(batches):
        for keys, texts in with_next(batches):
            n = len(keys)
            changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            coded = [x.encode() for x in changed]
            found = fingerprints([*(x.encode() for x in texts), *coded])
            own, other = found[: n + 1], found[n + 1 :]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, schema_type),
                    pa.array([len(x) for x in texts[:n]], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([show(x) for x in own[:n]]),
                    pa.array([show(x) for x in other]),
                    pa.array([likeness(a, b) for a, b in zip(own[:n], other, strict=True)]),
                    pa.array([likeness(a, b) for a, b in zip(own[:n], own[1:], strict=True)]),
                ],
                schema.names,
            )

    from pyspark.sql.pandas.types import to_arrow_type

    schema_type = to_arrow_type(schema[0].dataType)
    return in_order(docs, key, text).mapInArrow(run, schema)


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return compare_with_next(docs)
