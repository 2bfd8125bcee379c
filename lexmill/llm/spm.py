"""SentencePiece models run by the tokenizers library.

The model protobuf is parsed here; the normaliser, the metaspace marker, BPE merges or unigram
scores, and byte fallback are rebuilt in tokenizers, which encodes batches on several threads.
Where a model's words are independent (see `independent`), each word of a batch is encoded once and
texts are put together from their words. The sentencepiece library encodes every text whole, and
parity is that of its ids with ours: it verifies this shortcut too.

Defined cases: null and empty texts have no tokens and agree; repeated rows encode alike; texts of
one unbroken word, and very long ones, are encoded whole; the strings of control pieces inside a
text are ordinary text (but a unigram model takes them, and those of byte pieces, for these pieces,
which parity shows); models with user-defined pieces are refused; an empty table gives no rows;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from lexmill.llm.common import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
KNOWN, LONGEST = 1 << 18, 64  # words a worker keeps the ids of, and the longest of them
WORDS = 2000  # that are encoded in one string


def wire(data: bytes):
    """(field number, value) of a protobuf message: ints for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if size is None or at + size > len(data):
            raise ValueError("not a SentencePiece model")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Spec:
    """What of a model file bears on encoding and decoding."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Spec:
    spec = Spec()
    for number, value in wire(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in wire(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((text, score, kind))
        elif number == 2:
            own = dict(wire(value))
            spec.kind, spec.byte_fallback, spec.suffix = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
        elif number == 3:
            own = dict(wire(value))
            spec.charsmap = own.get(2, b"")
            spec.prefix, spec.squeeze, spec.escape = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    if not spec.pieces:
        raise ValueError("not a SentencePiece model")
    if spec.kind not in (UNIGRAM, BPE) or spec.suffix or not spec.escape:
        raise ValueError("only unigram and BPE models with a leading marker are supported")
    if any(k == USER for _, _, k in spec.pieces):
        raise ValueError("user-defined pieces are not supported")
    return spec


def independent(spec: Spec) -> bool:
    """Whether a word's tokens don't depend on its neighbours: no piece goes on past a marker, what no
    piece covers falls back to bytes, alone, and a text is normalised by markers only. A run of
    markers belongs to the word after it."""
    plain = spec.prefix and not spec.squeeze and not spec.charsmap
    return plain and spec.byte_fallback and not any(re.search(f"[^{SPACE}]{SPACE}", t) for t, _, k in spec.pieces if k == NORMAL)


def build(spec: Spec):
    """The same tokenizer in the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = next((i for i, (_, _, k) in enumerate(spec.pieces) if k == UNKNOWN), None)
    if spec.kind == BPE:
        vocab = {t: i for i, (t, _, _) in enumerate(spec.pieces)}
        usable = {t: s for t, s, k in spec.pieces if k == NORMAL}
        merges = []
        for text, score in usable.items():
            splits = [(text[:i], text[i:]) for i in range(1, len(text)) if text[:i] in usable and text[i:] in usable]
            merges += [(-score, vocab[text], vocab[a], vocab[b], a, b) for a, b in splits]
        merges.sort()
        model = models.BPE(vocab, [(m[4], m[5]) for m in merges], unk_token=spec.pieces[unk][0] if unk is not None else None, fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:  # control and byte pieces are the last resort
        model = models.Unigram([(t, s if k == NORMAL else -1e6) for t, s, k in spec.pieces], unk_id=unk, byte_fallback=spec.byte_fallback)
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.prefix:
        steps.append(normalizers.Prepend(SPACE))
    steps.append(normalizers.Replace(" ", SPACE))
    tok.normalizer = normalizers.Sequence(steps)
    # Where no piece goes on into a next word, words are independent: they are cut before the
    # model, which then caches them. A run of markers stays with the word that follows it.
    if not any(re.search(f"[^{SPACE}]{SPACE}", t) for t, _, k in spec.pieces if k == NORMAL):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+"), "isolated")
    tail = [decoders.Strip(content=" ", left=1, right=0)] if spec.prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tok


class Ids:
    """Token ids of texts: all in a row, and the bounds of texts."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray) -> None:
        self.flat, self.bounds = flat, bounds

    @staticmethod
    def of(lists: list[list[int]]) -> Ids:
        return Ids(np.array(list(chain.from_iterable(lists)), np.int32), np.cumsum([0, *map(len, lists)]))

    def __iter__(self):
        return (self.flat[a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True))

    def lists(self) -> list[list[int]]:
        return [x.tolist() for x in self]

    def arrow(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.bounds, pa.int32()), pa.array(self.flat, pa.int32()))


class Backend:
    """Encodes and decodes with the tokenizers library."""

    def __init__(self, spec: Spec) -> None:
        self.whole, self.prefix = build(spec), spec.prefix
        self.bytes = [bytes([int(t[1:-1], 16)]) if k == BYTE else t.replace(SPACE, " ").encode() for t, _, k in spec.pieces]
        self.by_words = independent(spec)
        if self.by_words:
            from tokenizers import normalizers

            self.words = build(spec)
            self.words.normalizer = normalizers.Sequence([])
            self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
            self.opens = np.array([t.startswith(SPACE) and k == NORMAL for t, _, k in spec.pieces])
            self.forget()

    def forget(self) -> None:
        """The number of each word known, and the ids of words in a row with their bounds."""
        self.known, self.flat, self.bounds = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: list[str], ids: np.ndarray, starts: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.bounds = np.concatenate([self.bounds[:-1], len(self.flat) + starts, [len(self.flat) + len(ids)]])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def encode(self, texts: list[str]) -> Ids:
        run = lambda tok, x: [e.ids for e in tok.encode_batch_fast(x, add_special_tokens=False)]
        if not self.by_words:
            return Ids.of(run(self.whole, texts))
        if len(self.known) > KNOWN:
            self.forget()
        words = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set(chain.from_iterable(words)).difference(self.known)
        # Words of one marker are encoded in a row: a token that opens with a marker opens a word.
        short = [w for w in fresh if len(w) <= LONGEST and w[1:2] not in ("", SPACE)]
        odd = sorted(fresh.difference(short), key=len)
        ids = np.array(list(chain.from_iterable(run(self.words, ["".join(short[i : i + WORDS]) for i in range(0, len(short), WORDS)]))), np.int32)
        self.learn(short, ids, np.flatnonzero(self.opens[ids]))
        others = Ids.of(run(self.words, odd))
        self.learn(odd, others.flat, others.bounds[:-1])
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64)
        sizes = np.diff(self.bounds)[at]
        ends = np.cumsum(sizes)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[at] - ends + sizes, sizes)]
        if long := [w for w in odd if len(w) > LONGEST]:  # the last ones learnt, which aren't kept
            for w in long:
                del self.known[w]
            self.bounds = self.bounds[: len(self.known) + 1]
            self.flat = self.flat[: self.bounds[-1]]
        return Ids(flat, np.concatenate([[0], ends])[np.cumsum([0, *map(len, words)])])

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts by the bytes of pieces; if a list isn't valid UTF-8, by the library's decoder."""
        try:
            found = [b"".join(map(self.bytes.__getitem__, x)).decode() for x in ids]
        except UnicodeDecodeError:
            return self.whole.decode_batch(ids, skip_special_tokens=False)
        return [x.removeprefix(" ") for x in found] if self.prefix else found


@lru_cache(maxsize=4)
def backend(data: bytes, threads: int = THREADS) -> Backend:
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    return Backend(parse(data))


@lru_cache(maxsize=4)
def original(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def encode_texts(data: bytes, texts: list[str], threads: int = THREADS) -> Ids:
    return backend(data, threads).encode(texts)


def decode_ids(data: bytes, ids: list[list[int]], threads: int = THREADS) -> list[str]:
    return backend(data, threads).decode(ids)


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "token_ids", n: str = "n_tokens", threads: int = THREADS) -> DataFrame:
    """docs with `ids` (array of int) and `n` added (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))  # bounded by the model file
    kept = [c for c in docs.columns if c not in (ids, n)]
    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType())).add(n, "long")
    at = kept.index(text)

    def run(batches):
        for batch in pieces(batches, text):
            found = encode_texts(shared.value, [x or "" for x in batch.column(at).to_pylist()], threads)
            yield pa.RecordBatch.from_arrays([*batch.columns, found.arrow(), pa.array(np.diff(found.bounds))], [*kept, ids, n])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(docs: DataFrame, model: str = MODEL, ids: str = "token_ids", text: str = "decoded", threads: int = THREADS) -> DataFrame:
    """docs with the text of `ids` added as `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    kept = [c for c in docs.columns if c != text]
    at = kept.index(ids)

    def run(batches):
        for batch in batches:
            got = decode_ids(shared.value, [x or [] for x in batch.column(at).to_pylist()], threads)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*kept, text])

    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add(text, "string"))


def theirs(data: bytes, texts: list[str], threads: int = THREADS) -> list[list[int]]:
    """Token ids by the sentencepiece library."""
    return original(data).encode(texts, num_threads=threads) if texts else []


def came_back(texts: list[str], back: list[str]) -> list[bool]:
    """Whether each text was decoded to itself (markers in it count as spaces)."""
    return [x == t.replace(SPACE, " ") for x, t in zip(back, texts, strict=True)]


def encode_checked(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "token_ids", n: str = "n_tokens", threads: int = THREADS) -> DataFrame:
    """As encode(), with each text decoded again and encoded by the sentencepiece library: adds
    `round_trip` and `parity` (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    added = (ids, n, "round_trip", "parity")
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType())).add(n, "long").add("round_trip", "boolean").add("parity", "boolean")
    at = kept.index(text)

    def run(batches):
        data = shared.value
        for batch in pieces(batches, text):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            found = encode_texts(data, texts, threads)
            lists = found.lists()
            same = [a == b for a, b in zip(lists, theirs(data, texts, threads), strict=True)]
            columns = [found.arrow(), pa.array(np.diff(found.bounds)), pa.array(came_back(texts, decode_ids(data, lists, threads))), pa.array(same)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*kept, *added])

    return docs.select(*kept).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text", threads: int = THREADS) -> DataFrame:
    """Encode and decode each text: its number of tokens, digests of ids and decoded text, whether
    the text came back (markers in it count as spaces), and `parity` with the sentencepiece library."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    schema = docs.select(key).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("round_trip", "boolean"), ("parity", "boolean")):
        schema = schema.add(name, kind)

    def run(batches):
        data = shared.value
        for batch in pieces(batches, text):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = encode_texts(data, texts, threads)
            lists = ids.lists()
            back = decode_ids(data, lists, threads)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(ids.bounds)),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                    pa.array(came_back(texts, back)),
                    pa.array([a == b for a, b in zip(lists, theirs(data, texts, threads), strict=True)]),
                ],
                schema.names,
            )

    return docs.select(key, text).mapInArrow(run, schema)


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return round_trip(docs)
