"""Operators without Spark: codecs, archives, tokenizers, patterns."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
import sentencepiece

from lexmill.llm import fingerprints as fp, flac, ngram_join as nj, pii, spm, substring, warc


def test_flac_round_trip():
    rng = np.random.default_rng(1)
    data = [b"", b"a", bytes(range(256)) * 7, rng.integers(0, 256, 5000, np.uint8).tobytes(), b"\xff" * 1200, ("é long text. " * 3000).encode()]
    padded = [flac.pad(x) for x in data]
    assert all(len(p) % flac.BLOCK == 0 and p for p in padded)
    coded = flac.encode(padded)
    assert [flac.payload(x) for x in flac.decode(coded)] == padded
    first, pcm = flac.seek(coded[5], 30_000)
    assert first <= 30_000 < first + flac.BLOCK and flac.payload(pcm) == padded[5][first : first + flac.BLOCK]


@pytest.mark.parametrize("at", [-1, -20, 200])
def test_flac_finds_damage(at):
    coded = bytearray(flac.encode([flac.pad(b"some text here " * 200)])[0])
    coded[at] ^= 0x10
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(coded)])


class Writer:
    """Bits of a hand-made frame."""

    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & ((1 << width) - 1), f"0{width}b")

    def rice(self, value, k):
        z = 2 * value if value >= 0 else -2 * value - 1
        self.bits += "0" * (z >> k) + "1" + (format(z & ((1 << k) - 1), f"0{k}b") if k else "")

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")


def test_flac_linear_predictor_and_partitions():
    """A frame of another encoder's kind: LPC order 2, four partitions, one of them escaped."""
    x = np.round(60 * np.sin(np.arange(flac.BLOCK) / 9)).astype(int)
    coefs, shift = (29, -15), 4
    w = Writer()
    w.put((32 + 1) << 1, 8)
    for v in x[:2]:
        w.put(int(v), 8)
    w.put(6 - 1, 4), w.put(shift, 5)
    for c in coefs:
        w.put(c, 6)
    w.put(0, 2), w.put(2, 4)
    residual = [int(x[i] - ((coefs[0] * x[i - 1] + coefs[1] * x[i - 2]) >> shift)) for i in range(2, flac.BLOCK)]
    per = flac.BLOCK // 4
    at = 0
    for part in range(4):
        n = per - 2 * (part == 0)
        own = residual[at : at + n]
        at += n
        if part == 2:
            w.put(15, 4), w.put(9, 5)
            for r in own:
                w.put(r, 9)
        else:
            w.put(3, 4)
            for r in own:
                w.rice(r, 3)
    frame = flac._header(0) + w.bytes()
    crc = flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]
    frame += int(crc).to_bytes(2, "big")
    pcm = x.astype(np.int8).tobytes()
    stream = flac.stream_head(len(x), (len(frame), len(frame)), hashlib.md5(pcm).digest(), []) + frame
    assert flac.decode([stream]) == [pcm]


def test_warc_archive():
    records = [warc.record(i, f"http://x/{i}", f"<p>page {i} {'text ' * 50}</p>".encode()) for i in range(40)]
    records.append(warc.record(40, None, b"<p>page 0</p>", 0, True))
    data = warc.compress(records)
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    found = list(warc.frames(data))
    assert [c for _, c in found] == records
    assert warc.describe(found[0][1])[:4] == (0, len(f"<p>page 0 {'text ' * 50}</p>"), warc.digest(f"<p>page 0 {'text ' * 50}</p>".encode()), "response")
    assert warc.describe(found[-1][1])[:5] == (40, 13, warc.digest(b"<p>page 0</p>"), "revisit", 0)
    for bad in (records[0][:-1], records[0].replace(b"Content-Length: ", b"Content-Length: 9", 1), records[0].replace(b"WARC-Type", b"X-Type"), records[0].replace(b"page 0", b"page 1")):
        with pytest.raises(warc.WarcError):
            warc.describe(bad)
    with pytest.raises(warc.WarcError):
        list(warc.frames(data[:-3]))


def pattern_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii._luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_patterns():
    random.seed(5)
    for _ in range(20_000):
        t = "".join(random.choice("ab@.@-+ 0123456789()é") for _ in range(random.randint(0, 40)))
        assert pii.base_spans(t) == pattern_spans(t), t
    t = "card 4111 1111 1111 1111, ip 10.0.0.256 and 10.0.0.1, +33 1 23 45 67 89, a.b@c.de"
    assert pii.base_spans(t) == pattern_spans(t) and [k for k, _, _ in pii.base_spans(t)] == ["email", "ip", "card", "phone"]
    assert pii.rewrite("mail a@b.cd to Smith now", [(15, 20, 1.0)]) == "mail [EMAIL] to […] now"
    assert pii.base_spans("a" * 300_000 + "." * 300_000 + "7" * 300_000) == []


def _message(*fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model():
    """A small unigram model with byte fallback, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁abc", "é", "▁b", "ca"]
    pieces += [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    out = b"".join(_message((1, _message((1, t.encode()), (2, s), (3, k)))) for t, s, k in pieces)
    return out + _message((2, _message((3, 1), (4, len(pieces)), (35, 1), (40, 0), (41, 1), (42, 2))), (3, _message((1, b"identity"), (3, 1), (4, 0))))


@pytest.mark.parametrize("data", [spm.model_bytes(), unigram_model()], ids=["bpe", "unigram"])
def test_tokenizer_parity(data):
    random.seed(2)
    texts = ["", " ", "abc", "a  b", " lead", "tail ", "\n\t x", "日本 é ñ 😀", "</s> <0x41> <unk>", "ab" * 3000]
    texts += ["".join(random.choice("abcabc  é\nz▁") for _ in range(random.randint(1, 60))) for _ in range(400)]
    if spm.parse(data).kind == spm.UNIGRAM:  # see the docstring of spm
        texts.remove("</s> <0x41> <unk>")
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    ids = spm.encode_texts(data, texts).lists()
    assert ids == theirs.encode(texts)
    back = spm.decode_ids(data, ids)
    assert back == spm.backend(data).whole.decode_batch(ids, skip_special_tokens=False)
    assert [b == t.replace("▁", " ") for b, t in zip(back, texts, strict=True)].count(False) == 0


def test_chunks():
    random.seed(3)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    text = " ".join(words)
    a, b, c = fp.fingerprints([text.encode(), (text[:2000] + "inserted words " + text[2000:]).encode(), b""])
    assert 0.9 < fp.likeness(a, b) < 1 and fp.likeness(a, c) == 0 and fp.likeness(c, c) == 1 and fp.show(c) == ""
    assert int((a & np.uint64(0xFFFF)).sum()) <= len(text)
    one = fp.fingerprints([b"x", text.encode()])
    assert (one[1] == a).all() and len(one[0]) == 1  # neighbours in a batch don't matter
    assert fp.edited("abcd", "xyz") == "abxy" and fp.edited("abcde", "x") == "abcx" and fp.edited("a", "") == "a"


def test_packs():
    ids, uids = np.array([5, -3, 9]), np.array([1, 2, -(1 << 63)])
    counts, pos, h = np.array([2, 1, 3]), np.array([7, 300_000, 0, 1, 2, 70_000], np.uint32), np.arange(6, dtype=np.uint32)
    (a, b), n, p, (g,) = substring.unpack(substring.pack([ids, uids], counts, pos, [h]), 2, [np.uint32])
    assert (a == ids).all() and (b == uids).all() and (n == counts).all() and (p == pos).all() and (g == h).all()


def test_expected_recall():
    assert nj.expected_recall(6) > 0.995 > nj.expected_recall(7) > nj.expected_recall(8)
    assert nj.measured({128: 1000, 150: 5000}, 6) == nj.expected_recall(6) and nj.measured({100: 7, 150: 9}, 8) == 1 == nj.measured({}, 8)


def test_words_are_learnt_and_forgotten(monkeypatch):
    """Ids put together from words equal those of whole texts, whatever of the words is kept."""
    data, rng = spm.model_bytes(), random.Random(4)
    texts = ["", " ", "  ", "x" * 500, "a" * 70 + " b", "▁ ▁▁a", " a  b   c ", "\x00\n\té 漢字 😀"] + ["".join(rng.choice("ab ▁\n\té漢😀., ") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    want = spm.original(data).encode(texts)
    for known in (1 << 18, 5):
        monkeypatch.setattr(spm, "KNOWN", known)
        own = spm.Backend(spm.parse(data))
        assert own.by_words
        got = [x for i in range(0, len(texts), 50) for x in own.encode(texts[i : i + 50]).lists()]
        assert got == want and all(len(w) <= spm.LONGEST for w in own.known) and len(own.bounds) == len(own.known) + 1
    assert own.encode([]).lists() == []
