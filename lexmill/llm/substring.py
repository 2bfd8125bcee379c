"""Removal of long passages that an earlier document has too, by fixed-block anchors.

A window is `WINDOW` consecutive words. Every window holds a whole block of `BLOCK` words that
starts at a multiple of `BLOCK` in its document, so non-overlapping blocks index all windows:

1. blocks of all documents are indexed by hash and probed with every rolling block-long window;
2. around hits, the windows themselves are compared (96 and more bits of their words), which
   extends hits to maximal exact repeats: a window goes if a smaller doc_id has it;
3. words covered by such windows are removed.

Hashes travel packed: a task sends one binary value per bucket, of 32-bit hash remainders and
compressed positions. Within a task, entries of one hash that the task itself can decide are
decided there, so a passage that a third of all documents share sends a few entries a task.
Texts move only if a Bloom filter of fixed size says that the document may have a hit.

Defined cases: a null or blank text has no words; a null doc_id is smaller than all others; rows
with equal doc_id never remove each other's words; documents of fewer than `WINDOW` words keep
all; windows are judged on the input, not on what is left; very long texts are probed whole; of
tied first documents the smallest doc_id keeps the window; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import Bloom, Words, buckets, pieces, rolling, text_bytes, window_hashes
from lexmill.session import stash

WINDOW, BLOCK = 50, 25
PACK = 1_500_000  # entries a task gathers before it sends them
FIRST = -(1 << 63)
ENTRIES, DECIDED = 0, 1


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(per_doc: list[np.ndarray], counts: np.ndarray, pos: np.ndarray, hashes: list[np.ndarray]) -> bytes:
    """Entries grouped by document: int64 values per document, numbers of entries, positions
    (ascending in a document), and any hash columns, which don't compress."""
    steps = np.diff(pos.astype(np.int64), prepend=0)
    heads = np.cumsum(counts) - counts
    steps[heads] = pos[heads]
    planes = steps.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()  # bytes of a rank together
    meta = b"".join([*(np.diff(x, prepend=0).tobytes() for x in per_doc), counts.astype(np.uint32).tobytes(), planes])
    packed = _zstd()[0].compress(meta)
    sizes = np.array([len(counts), len(pos), len(packed)], np.int64).tobytes()
    return sizes + packed + b"".join(h.tobytes() for h in hashes)


def unpack(data: bytes, values: int, kinds: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    docs, n, size = np.frombuffer(data, np.int64, 3).tolist()
    meta = _zstd()[1].decompress(data[24 : 24 + size])
    per_doc = [np.cumsum(np.frombuffer(meta, np.int64, docs, 8 * docs * i)) for i in range(values)]
    counts = np.frombuffer(meta, np.uint32, docs, 8 * docs * values).astype(np.int64)
    planes = np.frombuffer(meta, np.uint8, 4 * n, 8 * docs * values + 4 * docs).reshape(4, n)
    steps = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
    total = np.cumsum(steps)
    heads = np.cumsum(counts) - counts
    pos = total - np.repeat(total[heads] - steps[heads], counts)
    hashes, at = [], 24 + size
    for kind in kinds:
        hashes.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return per_doc, counts, pos, hashes


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    heads = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1]) if len(doc) else np.zeros(0, np.int64)
    return heads, np.diff(np.concatenate([heads, [len(doc)]]))


def _batch(bucket, kind, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


PACKED = "bucket int, kind int, data binary"


def deal(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, per_doc: list[np.ndarray], hashes: list[np.ndarray], decided: np.ndarray, sent: np.ndarray, n: int):
    """Batches of packed rows: entries to send by bucket of their hash, decided ones as they are.
    doc ascends, and pos does within a document."""
    rows: list[tuple] = []
    at = np.flatnonzero(sent)
    bucket = ((h[at] >> np.uint64(32)) % np.uint64(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    at, bucket = at[order], bucket[order]
    for head, size in zip(*_runs(bucket), strict=True):
        own = at[head : head + size]
        runs, counts = _runs(doc[own])
        docs = doc[own[runs]]
        rows.append((int(bucket[head]), ENTRIES, pack([x[docs] for x in per_doc], counts, pos[own], [c[own] for c in hashes])))
    at = np.flatnonzero(decided)
    if len(at):
        runs, counts = _runs(doc[at])
        docs = doc[at[runs]]
        rows.append((int(per_doc[0][docs[0]] % n), DECIDED, pack([x[docs] for x in per_doc], counts, pos[at], [])))
    if rows:
        yield _batch(*zip(*rows, strict=True))


class Gather:
    """Entries of a task, dealt out when there are enough."""

    def __init__(self, values: int, columns: int, decide, n: int) -> None:
        self.values, self.columns, self.decide, self.n = values, columns, decide, n
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.size = self.docs = 0

    def add(self, per_doc: list[np.ndarray], doc: np.ndarray, pos: np.ndarray, hashes: list[np.ndarray]):
        self.parts.append((per_doc, doc + self.docs, pos.astype(np.uint32), hashes))
        self.size += len(pos)
        self.docs += len(per_doc[0])
        if self.size >= PACK:
            yield from self.flush()

    def flush(self):
        if self.size:
            per_doc = [np.concatenate([p[0][i] for p in self.parts]) for i in range(self.values)]
            doc, pos = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2))
            hashes = [np.concatenate([p[3][i] for p in self.parts]) for i in range(self.columns)]
            decided, sent = self.decide(hashes, per_doc[0][doc], pos)
            low = (hashes[0] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield from deal(hashes[0], doc, pos, per_doc, [low, *hashes[1:]], decided, sent, self.n)
        self.clear()


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts entries by keys, heads and lengths of runs of equal keys."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    differ = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        sorted_ = k[order]
        differ |= sorted_[1:] != sorted_[:-1]
    heads = np.concatenate([[0], np.flatnonzero(differ) + 1]) if len(order) else np.zeros(0, np.int64)
    return order, heads, np.diff(np.concatenate([heads, [len(order)]]))


def _shared(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries whose keys occur more than once, by group: order, heads and lengths."""
    order, heads, counts = _groups(keys)
    many = counts > 1
    keep = np.repeat(many, counts)
    counts = counts[many]
    return order[keep], np.cumsum(counts) - counts, counts


def hits_of(keys: list[np.ndarray], ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose block's hash is indexed by a smaller document, or that index a hash which a
    larger document has; and one entry of each least indexing and each greatest document."""
    hit, stand = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    order, heads, counts = _shared(keys)
    if len(order):
        own, anchor = ids[order], pos[order] % BLOCK == 0
        least = np.repeat(np.minimum.reduceat(np.where(anchor, own, np.iinfo(np.int64).max), heads), counts)
        most = np.repeat(np.maximum.reduceat(own, heads), counts)
        hit[order] = (own > least) | anchor & (own < most)
        group = np.repeat(np.arange(len(heads)), counts)
        for which in (anchor & (own == least), own == most):
            at = np.flatnonzero(which)
            stand[order[at[np.unique(group[at], return_index=True)[1]]]] = True
    return hit, stand


def probes(docs: DataFrame) -> DataFrame:
    """Packed entries of every rolling block-long window of docs(id, text)."""
    n = buckets(docs.sparkSession)

    def decide(hashes, ids, pos):
        hit, stand = hits_of(hashes, ids, pos)
        return hit, ~hit | stand

    def run(batches):
        held = Gather(1, 1, decide, n)
        for batch in pieces(batches):
            words = Words(*text_bytes(batch.column(1)))
            enough = words.counts >= WINDOW
            starts, ends, bounds = rolling(words.firsts, BLOCK)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            keep = enough[doc]
            h = window_hashes(words.hashes(), starts, ends)[keep]
            doc = doc[keep]
            yield from held.add([batch.column(0).to_numpy()], doc, starts[keep] - words.firsts[doc], [h])
        yield from held.flush()

    return docs.select("id", "text").mapInArrow(run, PACKED)


def _by_bucket(packed: DataFrame) -> DataFrame:
    return packed.repartitionById(buckets(packed.sparkSession), F.col("bucket"))


def _answers(ids: np.ndarray, pos: np.ndarray, n: int):
    """Batches of packed (id, positions), by bucket of the id: a task sends a row per bucket, and
    not one per document."""
    bucket = (ids.view(np.uint64) % np.uint64(n)).astype(np.int32)
    order = np.lexsort((pos, ids, bucket))
    ids, pos, bucket = ids[order], pos[order].astype(np.uint32), bucket[order]
    rows = []
    for head, size in zip(*_runs(bucket), strict=True):
        own = slice(head, head + size)
        runs, counts = _runs(ids[own])
        rows.append((int(bucket[head]), DECIDED, pack([ids[own][runs]], counts, pos[own], [])))
    if rows:
        yield _batch(*zip(*rows, strict=True))


def _by_id(packed: DataFrame, name: str) -> DataFrame:
    """(name, pos binary): the distinct positions of each id, from all tasks' answers."""

    def run(batches):
        parts = [unpack(data.as_py(), 1, []) for batch in batches for data in batch.column(2)]
        if not parts:
            return
        ids = np.concatenate([np.repeat(p[0][0], p[1]) for p in parts])
        pos = np.concatenate([p[2] for p in parts])
        order = np.lexsort((pos, ids))
        ids, pos = ids[order], pos[order]
        fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])])
        ids, pos = ids[fresh], pos[fresh].astype(np.uint32)
        heads, counts = _runs(ids)
        for at in range(0, len(heads), 20_000):
            h, c = heads[at : at + 20_000], counts[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[h], pa.int64()), pa.array([pos[a : a + k].tobytes() for a, k in zip(h, c, strict=True)], pa.binary())], [name, "pos"])

    return _by_bucket(packed).mapInArrow(run, f"{name} long, pos binary")


def block_hits(packed: DataFrame) -> DataFrame:
    """(id, pos binary): positions of block-long windows with a hit, by document."""
    n = buckets(packed.sparkSession)

    def run(batches):
        entries: list[tuple] = []
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                (ids,), counts, pos, hashes = unpack(data.as_py(), 1, [np.uint32] if kind == ENTRIES else [])
                if kind == DECIDED:
                    yield from _answers(np.repeat(ids, counts), pos, n)
                else:
                    entries.append((np.repeat(ids, counts), pos.astype(np.uint32), hashes[0]))
        if entries:
            ids, pos, h = (np.concatenate(x) for x in zip(*entries, strict=True))
            entries.clear()
            hit, _ = hits_of([h], ids, pos)
            yield from _answers(ids[hit], pos[hit], n)

    return _by_id(_by_bucket(packed).mapInArrow(run, PACKED), "id")


def _starts(at: bytes | None, n_words: int) -> np.ndarray:
    """Starts of windows that hold a block-long window with a hit."""
    if not at or n_words < WINDOW:
        return np.zeros(0, np.int64)
    p = np.frombuffer(at, np.uint32).astype(np.int64)
    p = p[p <= n_words - BLOCK]
    edge = np.zeros(n_words + 2, np.int32)
    np.add.at(edge, np.maximum(0, p - (WINDOW - BLOCK)), 1)
    np.add.at(edge, p + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: n_words - WINDOW + 1] > 0)


def windows(flagged: DataFrame) -> DataFrame:
    """Packed entries of the windows around hits, of flagged(id, uid, text, pos)."""
    n = buckets(flagged.sparkSession)

    def decide(hashes, ids, pos):
        decided = np.zeros(len(ids), bool)
        order, heads, counts = _shared(hashes)
        if len(order):
            own = ids[order]
            decided[order] = own > np.repeat(np.minimum.reduceat(own, heads), counts)
        return decided, ~decided

    def run(batches):
        held = Gather(2, 2, decide, n)
        for batch in pieces(batches):
            words = Words(*text_bytes(batch.column(2)))
            hits = [_starts(at, int(k)) for at, k in zip(batch.column(3).to_pylist(), words.counts, strict=True)]
            doc = np.repeat(np.arange(len(hits)), [len(x) for x in hits])
            pos = np.concatenate(hits) if hits else np.zeros(0, np.int64)
            if not len(pos):
                continue
            starts = pos + words.firsts[doc]
            h = words.hashes()
            pair = [window_hashes(h, starts, starts + WINDOW), window_hashes(words.hashes(1), starts, starts + WINDOW, 1)]
            yield from held.add([batch.column(0).to_numpy(), batch.column(1).to_numpy()], doc, pos, pair)
        yield from held.flush()

    return flagged.select("id", "uid", "text", "pos").mapInArrow(run, PACKED)


def repeats(packed: DataFrame) -> DataFrame:
    """(uid, pos binary): starts of windows that a smaller document has, by row."""
    n = buckets(packed.sparkSession)

    def run(batches):
        entries: list[tuple] = []
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                (ids, uids), counts, pos, hashes = unpack(data.as_py(), 2, [np.uint32, np.uint64] if kind == ENTRIES else [])
                if kind == DECIDED:
                    yield from _answers(np.repeat(uids, counts), pos, n)
                else:
                    entries.append((np.repeat(ids, counts), np.repeat(uids, counts), pos.astype(np.uint32), *hashes))
        if entries:
            ids, uids, pos, low, high = (np.concatenate(x) for x in zip(*entries, strict=True))
            entries.clear()
            order, heads, counts = _shared([high, low])
            if len(order):
                own = ids[order]
                cut = order[own > np.repeat(np.minimum.reduceat(own, heads), counts)]
                yield from _answers(uids[cut], pos[cut], n)

    return _by_id(_by_bucket(packed).mapInArrow(run, PACKED), "uid")


def cut_words(raw: bytes, cut: bytes | None) -> tuple[bytes, int, int]:
    """Kept words joined by one space, number of words, number removed."""
    words = raw.split()  # bytes split at exactly space and 9 to 13
    if not cut:
        return b" ".join(words), len(words), 0
    edge = np.zeros(len(words) + 1, np.int32)
    starts = np.frombuffer(cut, np.uint32).astype(np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + WINDOW, len(words)), -1)
    keep = (np.cumsum(edge[:-1]) == 0).tolist()
    kept = [w for w, k in zip(words, keep, strict=True) if k]
    return b" ".join(kept), len(words), len(words) - len(kept)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row of docs: key, n_words, n_removed and the kept words as `text`, or with digest their
    SHA-256 as kept_sha256."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(FIRST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hits = stash(block_hits(probes(rows)), "block-hits")
    held = docs.sparkSession.sparkContext.broadcast(Bloom.build(hits, "id"))
    value = "kept_sha256" if digest else "text"

    def out(keys, pairs):
        kept, n, removed = zip(*[cut_words(raw, cut) for raw, cut in pairs], strict=True)
        values = [hashlib.sha256(x).hexdigest() if digest else x.decode() for x in kept]
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(values, pa.string())], [key, "n_words", "n_removed", value])

    def split(wanted: bool):
        def run(batches):
            for batch in pieces(batches):
                may = Bloom.might_hold(held.value, batch.column(1).to_numpy())
                chosen = batch.filter(pa.array(may == wanted))
                if not chosen.num_rows:
                    continue
                if wanted:
                    yield chosen
                else:
                    yield out(chosen.column(0), [(x.encode(), None) for x in chosen.column(2).to_pylist()])

        return run

    schema = docs.select(key).schema.add("n_words", "long").add("n_removed", "long").add(value, "string")
    clean = rows.mapInArrow(split(False), schema)
    maybe = rows.mapInArrow(split(True), rows.schema).join(hits, "id", "left")
    flagged = stash(maybe.withColumn("uid", F.monotonically_increasing_id()), "flagged")  # written once, so fixed
    cuts = repeats(windows(flagged.where("pos is not null")))

    def finish(batches):
        for batch in pieces(batches):
            yield out(batch.column(0), list(zip((x.encode() for x in batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True)))

    return clean.unionByName(flagged.drop("pos").join(cuts, "uid", "left").select("key", "text", "pos").mapInArrow(finish, schema))


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True)


#: Every window of 50 words by its text.
ORACLE = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY 1), c AS (SELECT doc_id, list(i) AS starts FROM w JOIN f USING (h) WHERE first < doc_id GROUP BY 1),
p AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS x FROM d),
u AS (SELECT DISTINCT doc_id, s + unnest(range(50)) AS i FROM (SELECT doc_id, unnest(starts) AS s FROM c)),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN u USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
