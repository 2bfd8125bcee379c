"""Registered opN_ queries against plain loops written from their definitions, on one small folder."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lexmill.llm import common, fingerprints as fp, flac, langid, pii, substring

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def rows():
    rng = random.Random(12)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(120)] for x, letters in (("en", "thearnoisd"), ("fr", "éèlauqmonv"))}
    personal = ["ann.lee@mail.example", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 (20) 7946-0958", "+1 2", "a@b", "1.2.3.4.5.6.7.8", "x@y.z@w.v"]
    out = []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        text = [rng.choice(words[lang]) for _ in range(rng.randint(8, 160))]
        if i % 4 == 1:
            text.insert(rng.randint(0, len(text)), rng.choice(personal))
        if i % 10 == 3:
            text += ["zorblat", "10.9.8.7"]
        if i % 12 == 7 and out:
            text = out[rng.randrange(len(out))][1].split()
        out.append((i * 7, " ".join(text) + ("\nShared line.\n" if i % 5 == 0 else ""), lang if i % 9 else None, f"s{i % 12}", 0))
    return out + [(2000, None, "en", "s1", 0), (2001, "", "fr", None, 0), (2002, "12 ! é" * 3, None, "s2", 0), (2003, "w " * 9000, "en", "s3", 0), (2004, out[3][1], "en", "s4", 0), (2005, out[3][1], "fr", "s5", 0)]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(data, DOCUMENTS).repartition(3).write.parquet(f"file://{at}/documents.parquet")
    pages = [(i, f"http://x/{i}", None if i == 4 else "" if i == 5 else f"<p>é {i % 3}</p>") for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"file://{at}/pages.parquet")
    return f"file://{at}"


CONTRACTS = {
    "op1_warc_archive": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_ngram_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op4_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_flac_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_columns(spark, folder, data, name):
    out = entry.queries()[name](spark, folder)
    types = dict(out.dtypes)
    for column in CONTRACTS.get(name, "").split(", ") if name in CONTRACTS else []:
        assert types[column.split()[0]] == column.split()[1]
    assert out.count() == (12 if name.startswith("op1_") else len(data))


def test_warc(spark, folder):
    import base64

    got = {r["page_id"]: r for r in entry.queries()["op1_warc_archive"](spark, folder).collect()}
    first = {}
    for i in range(12):
        html = (b"" if i in (4, 5) else f"<p>é {i % 3}</p>".encode())
        to = first.setdefault(html, i)
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(html), digest, "response" if to == i else "revisit", None if to == i else to)


def base(text):
    """Spans by the patterns, leftmost and without retries."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in doubled) % 10:
                    continue
            out.append((kind, *m.span()))
    return out


def terms(texts):
    """Disclosing words by lower-case form, and all words of each text, by counting documents."""
    found, entities, n, pairs = [], [], collections.Counter(), collections.Counter()
    for text in texts:
        spans = base(text)
        words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        own = {(k, text[a:b].lower() if k == "email" else re.sub(r"[^0-9.]" if k == "ip" else "[^0-9]", "", text[a:b])) for k, a, b in spans}
        found.append(words)
        entities.append(own)
        n.update({w for w, *_ in words})
        pairs.update((w, e) for w in {w for w, *_ in words} for e in own)
    of = collections.Counter(e for own in entities for e in own)
    best = {}
    for (w, e), k in pairs.items():
        content = -math.log2(of[e] / len(texts))
        if k >= 2 and of[e] >= 2 and content > 0:
            best[w] = max(best.get(w, -9), 1 + math.log2(k / n[w]) / content)
    return {w: s for w, s in best.items() if s >= pii.GENERALISE}, found


def test_pii(spark, folder, data):
    texts = [t or "" for _, t, *_ in data]
    telling, words = terms(texts)
    assert "zorblat" in telling
    got = {r["doc_id"]: r for r in entry.queries()["op4_pii"](spark, folder).collect()}
    for (i, *_), text, own in zip(data, texts, words, strict=True):
        spans = base(text)
        r = got[i]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        more = [f"term:{a}:{b}" for w, a, b in own if w in telling]
        assert r["spans"] == ",".join([*([shown] if shown else []), *more])
        assert r["n_term"] == len(more) and r["n_removed"] == sum(telling[w] >= pii.REMOVE for w, *_ in own if w in telling)
        cuts = [(a, b, f"[{k.upper()}]") for k, a, b in spans] + [(a, b, "[…]" if telling[w] >= pii.REMOVE else f"[{pii.shape(text[a:b])}]") for w, a, b in own if w in telling]
        clean, at = "", 0
        for a, b, by in sorted(cuts):
            if b > at:
                clean, at = clean + text[at : max(a, at)] + by, b
        assert r["sanitised_sha256"] == hashlib.sha256((clean + text[at:]).encode()).hexdigest()


def test_sanitised_texts(spark):
    """Base spans become their kinds, words that always come with an entity go, and those that nearly
    always do keep their shape only; a column of any name passes through."""
    texts = [f"Zorblat and Quibble write to a@b.cd number{'s' * (i % 2)}" for i in range(40)] + ["quibble alone", None, ""] + ["the quibble again"] * 9 + [f"other text {i}" for i in range(400)]
    telling, _ = terms([t or "" for t in texts])
    assert telling["zorblat"] >= pii.REMOVE > telling["quibble"] >= pii.GENERALISE
    d = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, text_sha string")
    got = {r["doc_id"]: r for r in pii.sanitise(d).collect()}
    assert len(got) == len(texts) and got[0]["text_sha"] == "kept"
    assert got[0]["text"].startswith("[…] ") and "[EMAIL]" in got[0]["text"] and f"[{pii.shape('Quibble')}]" in got[0]["text"]
    assert got[40]["text"] == f"[{pii.shape('quibble')}] alone" and got[41]["text"] is None and got[100]["text"] == texts[100]
    assert (pii.shape("Quibble"), pii.shape("abc")) == ("X+", "x")


def test_media(spark, folder, data):
    media = {r["doc_id"]: bytes(r["media"]) for r in flac.store(spark.createDataFrame(data, DOCUMENTS)).collect()}
    got = {r["doc_id"]: r for r in entry.queries()["op6_flac_media"](spark, folder).collect()}
    for i, text, *_ in data:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) & 0xFFFFFFFF
        assert media[i][:4] == b"fLaC" and (r["media_bytes"], r["media_sha256"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        assert r["feature"] == flac.feature(payload)
        step = flac.SEEK_EVERY * flac.BLOCK
        assert (r["n_blocks"], r["last_block_at"]) == (-(-len(payload) // step), (len(payload) - 1) // step * step)
    assert got[2004]["feature"] == got[2005]["feature"] and len({r["feature"] for r in got.values()}) > 50


def language_scores(counts, text):
    """Score of each language by plain loops: words first, then ever shorter n-grams."""
    langs, smooth = sorted(counts), 0.5
    tables = {0: {x: collections.Counter(counts[x]) for x in langs}}
    for size in range(1, 6):
        tables[size] = {x: collections.Counter() for x in langs}
        for x in langs:
            for w, k in counts[x].items():
                marked = f"▁{w}▁"
                for i in range(len(marked) - size + 1):
                    tables[size][x][marked[i : i + size]] += k

    def score(size, key):
        keys = set().union(*tables[size].values())
        return [math.log((tables[size][x][key] + smooth) / (sum(tables[size][x].values()) + smooth * len(keys))) for x in langs]

    words = re.findall(r"[^\W\d_]+", text.lower())
    total = np.zeros(len(langs))
    for w in words:
        if any(w in tables[0][x] for x in langs):
            total += score(0, w)
            continue
        for size in range(5, 0, -1):
            grams = [g for i in range(len(w) + 3 - size) if any((g := f"▁{w}▁"[i : i + size]) in tables[size][x] for x in langs)]
            if grams:
                total += np.mean([score(size, g) for g in grams], axis=0)
                break
    z = np.exp((total - total.max()) / max(1, len(words)) ** 0.5)
    return langs[int(total.argmax())], 1 / z.sum(), len(words)


def test_language(spark, folder, data):
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in data}
    counts = collections.defaultdict(collections.Counter)
    for i, text, lang, *_ in data:
        if lang and text is not None and not held[i]:
            counts[lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    got = {r["doc_id"]: r for r in entry.queries()["op9_language_id"](spark, folder).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == held and any(held.values())
    for i, text, *_ in data[:25] + data[-6:]:
        if i == 2003:
            continue
        lang, score, n = language_scores(counts, text or "")
        assert (got[i]["lang_pred"], round(got[i]["score"], 5)) == ((lang, round(score, 5)) if n else ("und", 0.0))


def test_held_out_labels_do_not_matter(spark, data):
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in data]
    changed = [(i, t, "xx" if h else lang, "other", n) for (i, t, lang, _, n), h in zip(data, held, strict=True)]
    predict = lambda d: sorted(map(tuple, langid.op9(spark, spark.createDataFrame(d, DOCUMENTS)).collect()), key=repr)
    assert predict(data) == predict(changed)


def chunk_lengths(raw):
    """Chunks by one pass over the bytes."""
    lengths, start = [], 0
    for end in range(1, len(raw) + 1):
        h = sum(int(fp.GEAR[raw[end - 1 - j]]) << j for j in range(min(16, end))) % (1 << 32)
        size = end - start
        if size == fp.MOST or size >= fp.USUAL and h < 1 << (32 - fp.LOOSE) or size >= fp.LEAST and h < 1 << (32 - fp.STRICT):
            lengths.append(size)
            start = end
    return [*lengths, *([len(raw) - start] if len(raw) > start else [])]


def test_chunks(spark, folder, data):
    got = {r["doc_id"]: r for r in entry.queries()["op10_fingerprints"](spark, folder).collect()}
    for at, (i, text, *_) in enumerate(data):
        raw, r = (text or "").encode(), got[i]
        after = (data[(at + 1) % len(data)][1]) or ""  # rows are in order of doc_id
        half = len(text or "") // 2
        changed = (text or "")[: len(text or "") - half] + after[:half]
        assert r["n_chars"] == len(text or "") and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        if len(raw) > 3000:
            continue
        for shown, source in ((r["fingerprint"], raw), (r["edited_fingerprint"], changed.encode())):
            entries = [int(shown[k : k + 16], 16) for k in range(0, len(shown), 16)]
            lengths, pos, want = chunk_lengths(source), 0, {}
            for n in lengths:
                want[source[pos : pos + n]] = n
                pos += n
            assert sorted(e & 0xFFFF for e in entries) == sorted(want.values()) and len(set(entries)) == len(entries)


def test_many_rows_of_one_key(spark):
    """Rows without an id are many: tails stay a row a piece, and each row meets the next one."""
    data = [(None, f"text {k % 7} " * 5) for k in range(300)] + [(5, "last text of all")]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert fp.in_order(d).where("tail = 1").count() <= 4 * 2
    order = sorted(t for i, t in data if i is None) + ["last text of all"]
    want = sorted(hashlib.sha256(fp.edited(t, order[(k + 1) % len(order)]).encode()).hexdigest() for k, t in enumerate(order))
    assert sorted(r["edited_sha256"] for r in fp.compare_with_next(d).collect()) == want


def test_equal_rows_are_cut_apart(spark):
    """Rows of one id with different texts, and equal rows, are cut each for itself."""
    passage = " ".join(f"p{k}" for k in range(60))
    data = [(1, passage), (3, f"a {passage} b"), (3, f"{passage} c"), (3, f"{passage} c"), (2, "short")]
    got = sorted((r["doc_id"], r["n_removed"], r["text"]) for r in substring.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == [(1, 0, passage), (2, 0, "short"), (3, 60, "a b"), (3, 60, "c"), (3, 60, "c")]


def test_pipeline(spark, folder, data):
    """run() is its stages in order, each on all rows of the one before."""
    out = spark.createDataFrame(data, DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
    want = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
    got = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want and 20 < len(want) < len(data)
    assert not {2000, 2001} & set(want) and len({2004, 2005, data[3][0]} & set(want)) <= 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_filters_beyond_their_size(spark, monkeypatch):
    """Where a Bloom filter would be too full to tell, a semi-join finds the rows: same links."""
    from lexmill.llm import ngram_join as nj

    base_text = " ".join(f"w{k}" for k in range(80))
    d = spark.createDataFrame([(k, base_text + f" x{k}") for k in range(6)] + [(9, "alone here")], "doc_id long, text string")
    want = sorted(map(tuple, nj.join_similar(d).collect()))
    monkeypatch.setattr(common.Bloom, "BITS", 1 << 4)
    assert sorted(map(tuple, nj.join_similar(d).collect())) == want and want[0] == (0, 0, 5)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_sql(spark, data, folder, name):
    """Queries against their SQL over the same folder."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{folder.removeprefix('file://')}/{t}.parquet/*.parquet'")
    out = entry.queries()[name](spark, folder)
    columns = sorted(out.columns)
    got = [tuple(r) for r in out.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()))
