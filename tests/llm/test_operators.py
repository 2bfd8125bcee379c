"""Operators on Spark against brute force over small fixtures with awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lexmill.llm import common, fingerprints as fp, flac, langid, linedup, mixing, ngram_join as nj, pii, queries, spm, substring, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"  # a clashing extra column


def corpus(seed=7, n=160):
    """Documents with copies, near copies, shared passages and lines, and odd rows."""
    rng = random.Random(seed)
    vocabulary = {"en": ["the", "of", "and", "thing", "house", "water", "over", "under", "light"], "fr": ["le", "de", "et", "maison", "été", "lumière", "sous", "chose"]}
    more = {k: v + ["".join(rng.choice("abcdefgilmnorstu") for _ in range(6)) for _ in range(300)] for k, v in vocabulary.items()}
    passage = [rng.choice(more["en"]) for _ in range(70)]
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        words = [rng.choice(more[lang]) for _ in range(rng.randint(20, 260))]
        if i % 9 == 4:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        if i % 8 == 5 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "changed"
        text = " ".join(words)
        if i % 4 == 0:
            text += "\nShared footer of all sites.\n"
        if i % 20 == 7:
            text += " write to ann.lee@mail.example or 10.0.0.1"
        rows.append((i * 3, text, None if i % 31 == 0 else lang, f"s{i % 11}", len(text), 0.5))
    rows += [(9001, None, "en", None, 0, None), (9002, "", "en", "s1", 0, None), (9003, " \n\t ", None, "s2", 0, None), (9004, "12 34 !?", "en", "s3", 0, None), (9005, "word " * 30_000, "en", "s1", 0, None), (9006, rows[0][1], "fr", "s5", 0, None), (9006, rows[0][1], "fr", "s5", 0, None), (None, "null id here now", "en", "s1", 0, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(docs, rows):
    words = [(i if i is not None else substring.FIRST, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    want = []
    for i, w in words:
        cut = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                cut[k : k + 50] = True
        kept = [x for x, c in zip(w, cut, strict=True) if not c]
        want.append((None if i == substring.FIRST else i, len(w), int(cut.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = [tuple(r) for r in substring.remove_repeats(docs, digest=True).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(w[2] for w in want) > 500


def test_ngram_join(docs, rows):
    sets = collections.defaultdict(set)
    for i, t, *_ in rows:
        w = (t or "").split()
        if w:
            sets[i] |= {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets, key=lambda i: (i is not None, i))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                if x != y:
                    root[y] = x
    got = nj.join_similar(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["class_id"] == (find(r["doc_id"]) if r["doc_id"] in sets else r["doc_id"])
    assert len({r["class_id"] for r in got}) < len(rows) - 10
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["class_id"] for r in got})


def test_links_are_counted(spark, monkeypatch):
    """n_links equals brute force on a group of near copies with exact copies, in several blocks too."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    data = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        data += [(i, " ".join(words))] * (3 if i % 10 == 0 else 1)
    data += [(7, "another text under a repeated id " * 3), (None, data[5][1]), (99, "alone here"), (98, "")]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.split()) else set() for _, t in data]
    want = collections.Counter((i, sum(x != y and bool(s) and len(s & o) >= 0.8 * len(s | o) for y, o in enumerate(sets))) for x, ((i, _), s) in enumerate(zip(data, sets, strict=True)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    assert collections.Counter((r["doc_id"], r["n_links"]) for r in nj.join_similar(d).collect()) == want
    assert len({n for _, n in want}) > 3
    monkeypatch.setattr(nj, "BLOCK", 7)
    assert collections.Counter((r["doc_id"], r["n_links"]) for r in nj.join_similar(d).collect()) == want


def near_copies(n, changes, seed=5, words=300):
    """n texts that differ from a base text of their own in so many words at most."""
    rng, out = random.Random(seed), []
    for i in range(n):
        base = [f"b{i}w{k}" for k in range(words)]
        copy = list(base)
        for _ in range(changes):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        out += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    return out


def nodes_of(spark, data):
    signed = nj.signatures(nj._rows(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text"))
    return signed.select("id", "keys")


def test_prefix_is_shortened_until_the_recall(spark):
    """Prefixes shorten until enough pairs close to the threshold show the recall; few or no pairs are
    no evidence, and they shorten until the recall expected of pairs at the threshold."""
    assert nj.measured({}, nj.LEVELS) == nj.expected_recall(nj.LEVELS) < nj.RECALL < nj.expected_recall(5)
    assert nj.measured({130: 999.0}, 7) < nj.RECALL <= nj.measured({136: 5000.0}, 7)
    assert nj.measured({130: 2000.0}, 8) < nj.measured({130: 2000.0}, 8, depth=6) < nj.measured({130: 2000.0}, 8, depth=5)
    _, told = nj.candidates(nodes_of(spark, near_copies(40, 1)))
    assert [d for d, _ in told] == [8, 5]
    _, told = nj.candidates(nodes_of(spark, near_copies(1100, 5)))
    assert told[0][0] == nj.LEVELS and nj.LEVELS > told[-1][0] >= 5 and len(told) <= 3
    assert told[-1][1] >= nj.RECALL > told[-2][1]


def test_a_single_pair_without_a_common_key(spark):
    """One pair near the threshold, chosen because it shares no whole key, is found all the same."""
    import pyarrow as pa

    rng = random.Random(11)
    for i in range(4000):
        base = [f"p{i}w{k}" for k in range(100)]
        copy = base[:96] + [f"q{rng.randrange(10**9)}" for _ in range(11)]
        texts = [" ".join(base), " ".join(copy)]
        keys = nj.tree_keys(*nj.shingles(pa.array(texts)))
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
        near = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        same = (keys.view(np.uint8)[0] == keys.view(np.uint8)[1]).sum()
        if 0.8 <= near < 0.9 and not (keys[0] == keys[1]).any() and same >= nj.least_equal(0.8):
            break
    else:
        raise AssertionError("no such pair")
    d = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, "another text " * 20)], "doc_id long, text string")
    assert sorted(map(tuple, nj.join_similar(d).collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_keep_one_agrees_with_the_join(spark, monkeypatch):
    """Classes told without counting all links are those of the join, in many blocks too: chains of near
    copies, whose ends are far apart, and a group that is all alike."""
    rng, data = random.Random(6), []
    for c in range(6):
        words = [f"c{c}w{k}" for k in range(150)]
        for i in range(30):
            data.append((len(data), " ".join(words)))
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(150)] = f"x{rng.randrange(10**9)}"
    base = [f"g{k}" for k in range(200)]
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(200)] = f"y{i}"
        data.append((len(data), " ".join(copy)))
    d = spark.createDataFrame([(*r, "p", 1) for r in data], "doc_id long, text string, __p string, __q int")
    for block in (nj.BLOCK, 7):
        monkeypatch.setattr(nj, "BLOCK", block)
        classes = {r["class_id"] for r in nj.join_similar(d).collect()}
        kept = nj.keep_one(d).collect()
        assert {r["doc_id"] for r in kept} == classes and len(kept) == len(classes) and {(r["__p"], r["__q"]) for r in kept} == {("p", 1)}


def test_recall_is_measured(spark):
    """Thousands of planted pairs right above the threshold: hardly a link is lost."""
    data = near_copies(1500, 6)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in data)}
    linked = {i for i in range(0, len(data), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in nj.join_similar(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    caught = {i for i in range(0, len(data), 2) if got[i + 1][0] == i}
    assert len(linked) > 1000 and caught <= linked and len(caught) >= 0.995 * len(linked)
    assert all(got[i] == (i, 1) for i in caught) and all(got[i] == (i, 0) for i in range(0, len(data), 2) if i not in caught)


def test_large_groups_pass_on_rows_not_pairs(spark, monkeypatch):
    """Near copies of one text, most pairs of which are below the threshold: rows stay in proportion,
    and classes and links are those of brute force."""
    monkeypatch.setattr(nj, "BLOCK", 50)
    rng, base, data = random.Random(8), [f"w{k}" for k in range(120)], []
    for i in range(240):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
        data.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in data)]
    near = [[j for j in range(240) if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(240)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in nj.join_similar(d).collect()}
    assert [got[i]["n_links"] for i in range(240)] == [len(x) for x in near] and 1000 < sum(map(len, near)) < 240 * 200
    for i, x in enumerate(near):
        assert {got[j]["class_id"] for j in x} <= {got[i]["class_id"]}
    nodes = nodes_of(spark, data).withColumn("class", F.col("id"))
    assert nj.across(nodes, 6).where("u is not null").count() < 240 * 6 * nj.TREES


def test_components_of_few_links_take_one_job(spark, monkeypatch):
    """Few links are joined without rounds of jobs, whose plans fill the driver; in rounds all the same classes."""
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1100, 1400)] + [(k + 1, k) for k in range(-90, -40)]
    links += [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(600)] + [(7, 7), (1000, 1100), (9001, 9001), (None, 5)]
    rng.shuffle(links)
    held = {}
    for u, v in (x for x in links if None not in x and x[0] != x[1]):
        both = held.get(u, {u}) | held.get(v, {v})
        held.update(dict.fromkeys(both, both))
    want = {x: min(of) for x, of in held.items()}
    frame = nj.stash(spark.createDataFrame(links, "u long, v long").repartition(5), "test")
    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsCount()
    got = nj.components(frame, n=len(links)).collect()
    assert runs.executionsCount() - before == 1 and len(got) == len(want) and {r["id"]: r["class"] for r in got} == want
    assert nj.components(frame.where("u is null")).collect() == []
    for few in (0, len(links) - 1):
        monkeypatch.setattr(nj, "FEW", few)
        got = nj.components(frame).collect()
        assert len(got) == len(want) and {r["id"]: r["class"] for r in got} == want


def test_keep_one_agrees_in_rounds(spark, monkeypatch):
    """Classes are the same whether few or many links are joined at once."""
    d = spark.createDataFrame(near_copies(30, 3) + [(100 + i, " ".join(["same"] * 40 + [f"y{i}"])) for i in range(9)], "doc_id long, text string")
    want, kept = sorted(map(tuple, nj.join_similar(d).collect())), sorted(map(tuple, nj.keep_one(d).collect()))
    monkeypatch.setattr(nj, "FEW", 0)
    assert sorted(map(tuple, nj.join_similar(d).collect())) == want and sorted(map(tuple, nj.keep_one(d).collect())) == kept and len(kept) < len(want)


def test_keep_one_loses_no_text(spark):
    """Rows without an id, or that repeat one, are documents of their own."""
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"}
    data = [(None, text["a"]), (None, text["b"]), (None, text["c"]), (4, text["c"] + " more"), (5, text["d"]), (5, text["e"]), (6, text["e"]), (7, text["f"]), (7, text["f"]), (8, None), (8, "")]
    kept = nj.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = [(None, text["a"]), (None, text["b"]), (4, text["c"] + " more"), (5, text["d"]), (5, text["e"]), (7, text["f"]), (8, None), (8, "")]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_fingerprints(docs, rows):
    order = sorted(((i if i is not None else fp.NONE, t or "") for i, t, *_ in rows), key=lambda x: x)
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        e = fp.edited(t, after)
        a, b, c = fp.fingerprints([t.encode(), e.encode(), after.encode()])
        want.append((None if i == fp.NONE else i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.show(a), fp.show(b), fp.likeness(a, b), fp.likeness(a, c)))
    got = [tuple(r) for r in fp.compare_with_next(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_flac_media(docs, rows, tmp_path):
    got = {(r["doc_id"], r["n_bytes"], r["payload_sha256"]) for r in flac.digests(flac.store(docs)).collect()}
    assert got == {(i, len((t or "").encode()), hashlib.sha256(flac.pad((t or "").encode())).hexdigest()) for i, t, *_ in rows}
    blocks = flac.pcm_blocks(flac.store(docs.where("doc_id = 9005"))).orderBy("first_sample").collect()
    written = flac.write_pcm_blocks(flac.store(docs.where("doc_id in (9005, 0)")), f"file://{tmp_path}/blocks")
    whole = flac.pad(b"word " * 30_000)
    for first, count in ((0, 10), (70_001, 2000), (len(whole) - 5, 50), (len(whole) + 9, 5)):
        assert flac.payload(flac.samples_at(written, "doc_id", 9005, first, count)) == whole[first : first + count]
    assert flac.payload(b"".join(r["pcm"] for r in blocks)) == flac.pad(b"word " * 30_000) and blocks[1]["first_sample"] == flac.SEEK_EVERY * flac.BLOCK


def test_warc(spark):
    data = [(1, "http://a", "<p>x</p>"), (5, None, "<p>x</p>"), (3, "http://b", None), (2, "http://c", ""), (9, "u", "é" * 10_000), (9, "u", "é" * 10_000), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, payload int")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(pages)).collect()), key=repr)
    assert got == sorted([(1, 8, "response", None), (5, 8, "revisit", 1), (3, 0, "revisit", 2), (2, 0, "response", None), (9, 20_000, "response", None), (9, 20_000, "response", None), (None, 8, "response", None)], key=repr)
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_targets(spark):
    """Every URL comes back as it was: none, empty, with line ends or blanks, encoded already."""
    urls = [None, "", "http://a/%0D?x=1", "u\r\nWARC-Type: x", " blank ", "é\n%41", "a\tb", "%"]
    pages = spark.createDataFrame([(i, u, "same" if i % 2 else f"p{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["url"], r["record_type"]) for r in warc.op1(spark, pages).collect()}
    assert got == {i: (u, "revisit" if i % 2 and i > 1 else "response") for i, u in enumerate(urls)}


def test_warc_keeps_payloads_of_a_repeated_page(spark):
    """Of a page_id with two payloads, only the one that an earlier page has is a revisit."""
    pages = spark.createDataFrame([(1, "a", "<p>x</p>"), (4, "b", "<p>x</p>"), (4, "b", "<p>own</p>"), (2, "c", "<p>y</p>"), (4, "d", "<p>y</p>")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, bytes(r["payload"] or b"")) for r in warc.read(warc.write(pages)).collect())
    assert got == [(1, "response", 0, b"<p>x</p>"), (2, "response", 0, b"<p>y</p>"), (4, "response", 0, b"<p>own</p>"), (4, "revisit", 1, b""), (4, "revisit", 2, b"")]


def test_language(docs, rows):
    model = langid.fit(docs)
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.predict(docs, model).collect()}
    assert all((i, "und") in got and got[i, "und"] == 0 for i in (9001, 9002, 9003, 9004))
    right = [(i, lang) in got for i, _, lang, *_ in rows if lang and i is not None and i < 9000]
    assert np.mean(right) > 0.9 and all(0 <= s <= 1 for s in got.values())
    kept = langid.filter_languages(docs)
    assert kept.columns == docs.columns and 9001 not in {r["doc_id"] for r in kept.collect()}


def test_language_of_repeated_texts_is_learnt(spark):
    """A language whose rows repeat one text is learnt, however small its share and the sample."""
    data = [(i, "le chat est noir", "fr") for i in range(600)] + [(9000 + i, f"the cat number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} is here", "en") for i in range(300)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), docs_per_lang=20)
    assert model.langs == ["en", "fr"]
    assert model.predict(["le chat", "the cat is"])[0] == ["fr", "en"]


def test_clashing_names(spark):
    """Columns that bear an operator's helper names pass through all stages unchanged."""
    text = " ".join(f"word{i}" for i in range(30))
    names = "__p __q __mix __cell __w __lm_cut __lm_row __row __cut __kept __key __sha __terms __text __pred __score __weight __probability".split()
    rows = [(i, f"the {text} number n{i}\nshared line of all", "en", f"s{i}", 7, *[f"{n}{i}" for n in names]) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    want = {r[0]: r[5:] for r in rows}
    for stage in (langid.filter_languages, linedup.remove_boilerplate, nj.keep_one, lambda x: mixing.sample(x, rate=1.0), pii.sanitise):
        out = stage(d)
        got = out.select("doc_id", *names).collect()
        assert out.columns == d.columns and got and all(tuple(r)[1:] == want[r["doc_id"]] for r in got)


def test_lines(docs, rows):
    key = lambda s: s.strip(" \t\r\f\v")
    sites = collections.defaultdict(set)
    for _, t, _, s, *_ in rows:
        for line in (t or "").split("\n"):
            sites[key(line)].add(s or "")
    want = []
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not key(x) or len(sites[key(x)]) < linedup.MIN_SITES]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = linedup.remove_boilerplate(docs, counts=True).collect()
    assert sorted(((r["doc_id"], r["text"] or "", r["n_lines"] if r["text"] is not None else 0, max(0, r["n_removed"])) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(w[3] for w in want) > 20 and [r["text"] for r in got if r["doc_id"] == 9001] == [None]


def test_mixing(docs, rows):
    targets = {"lang": {"en": 0.5, "fr": 0.4}}
    got = mixing.mix(docs, targets=targets, rate=0.3).select("doc_id", "__mix.*").collect()
    assert len(got) == len(rows)
    cells = collections.Counter()
    for r in got:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    share = {d: collections.Counter() for d in range(3)}
    for c, n in cells.items():
        for d in range(3):
            share[d][c[d]] += n
    want = {d: {v: n**mixing.TEMPER for v, n in share[d].items()} for d in (0, 2)}
    want = {d: {v: x / sum(t.values()) for v, x in t.items()} for d, t in want.items()} | {1: {"en": 0.5, "fr": 0.4, "": 0.1}}
    w = {c: float(n) for c, n in cells.items()}
    for _ in range(mixing.ROUNDS):
        for d in range(3):
            total = collections.Counter()
            for c, x in w.items():
                total[c[d]] += x
            w = {c: x * want[d].get(c[d], 0) / total[c[d]] if total[c[d]] else 0.0 for c, x in w.items()}
    for r in got:
        c = (r["source"], r["lang"], r["topic"])
        assert r["weight"] is None or abs(r["weight"] * cells[c] - w[c]) < 5e-3
        assert 0 <= r["probability"] <= 1 and (r["probability"] < 1 or r["sampled"])
    expected = sum(n * {(r["source"], r["lang"], r["topic"]): r["probability"] for r in got}[c] for c, n in cells.items())
    assert abs(expected / sum(cells.values()) - 0.3) < 1e-6
    assert mixing.sample(docs).columns == docs.columns
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (mixing.mix(docs), mixing.describe(docs))]
    assert not any(re.search("Python|Arrow|Pandas|CartesianProduct|Window", p) for p in plans)


def test_mixing_by_a_topic_column(docs):
    got = mixing.mix(docs.withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "even")), topic="kind").select("__mix.topic").distinct().collect()
    assert {r["topic"] for r in got} == {"even", ""}


def test_mixing_says_what_it_misses(spark):
    """A source of one language only can't have other shares than it."""
    data = [(i, f"word {i}", f"s{i % 2}", "en" if i % 2 else "fr") for i in range(20)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    with pytest.raises(ValueError, match="off by"):
        mixing.mix(d, targets={"source": {"s0": 0.9, "s1": 0.1}, "lang": {"en": 0.9, "fr": 0.1}})
    assert mixing.mix(d, targets={"source": {"s0": 0.9, "s1": 0.1}, "lang": {"en": 0.1, "fr": 0.9}}).count() == 20


def test_pii(docs, rows):
    got = collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["base_sha256"]) for r in pii.detect(docs).collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        s = pii.base_spans(t or "")
        want[i, sum(k == "email" for k, *_ in s), sum(k == "ip" for k, *_ in s), hashlib.sha256(pii.joined(s).encode()).hexdigest()] += 1
    assert got == want
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[9001] is None and not any("@mail.example" in (t or "") for t in clean.values()) and len(clean) == len({r[0] for r in rows})


def test_disclosure(spark):
    """Scores of pairs equal those counted by hand."""
    data = [(i, f"zorblat agent wrote {'a@b.cd' if i < 4 else 'nothing'} common") for i in range(4)] + [(i, "common words agent here") for i in range(4, 40)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    base = pii.detect_base(d)
    got = sorted(r["disclosure"] for r in pii.disclosures(d, base, least=-9.0).collect())
    want = sorted(pii.disclosure(4, n, 4, 40) for n in (4, 4, 40, 40))
    assert np.allclose(got, want)
    assert pii.detect(d).where("n_term > 0").count() == 4


def test_disclosure_reaches_whole_documents(spark):
    """A term far from the entity, or in a document without it, is scored and replaced."""
    far = " ".join(f"filler{chr(97 + i)}" for i in range(20))
    data = [(i, f"Zorblat {far} write to a@b.cd") for i in range(20)] + [(20, f"zorblat {far} alone"), (21, None)] + [(i, f"{far} here") for i in range(22, 90)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    assert pii.disclosure(20, 21, 20, 90) >= pii.REMOVE > pii.GENERALISE > pii.disclosure(20, 89, 20, 90)
    got = {r["doc_id"]: r["spans"] for r in pii.detect(d).collect()}
    assert len(got) == 90 and all("term:0:7" in got[i] for i in range(21)) and "term:0:7" not in got[30]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(d).collect()}
    assert clean[0].startswith("[…] ") and clean[20].startswith("[…] ") and clean[21] is None and clean[30] == data[30][1]


def test_tokens(docs, rows):
    got = spm.round_trip(docs).collect()
    assert len(got) == len(rows) and all(r["round_trip"] and r["parity"] for r in got)
    coded = spm.encode(docs)
    back = spm.decode(coded).where("doc_id = 9005").first()
    assert back["decoded"] == "word " * 30_000 and back["n_tokens"] == len(back["token_ids"])


def test_tokens_are_all_checked(spark, docs, rows):
    """The registered query and the pipeline's stage leave no text without a verdict."""
    got = spm.op8(spark, docs).collect()
    assert len(got) == len(rows) and all(r["parity"] is True for r in got)
    last = corpus_pipeline.tokens(spark, docs, "")
    got = last.collect()
    assert "text" not in last.columns and len(got) == len(rows)
    assert all(r["round_trip"] is True and r["parity"] is True and r["n_tokens"] == len(r["token_ids"]) for r in got)


@pytest.mark.parametrize("run", [
    lambda d: substring.remove_repeats(d), lambda d: nj.join_similar(d), lambda d: flac.digests(flac.store(d)),
    lambda d: langid.op9(d.sparkSession, d), lambda d: linedup.op7(d.sparkSession, d), lambda d: mixing.mix(d), lambda d: pii.detect(d), lambda d: spm.round_trip(d), lambda d: fp.compare_with_next(d),
])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0


def test_bloom(spark):
    held = common.Bloom.build(spark.range(0, 5000).withColumn("id", F.col("id") * 7), "id")
    keys = np.arange(5000) * 7
    assert common.Bloom.might_hold(held, keys).all() and common.Bloom.might_hold(held, keys + 1).mean() < 0.01


def test_registered(docs):
    assert [n for n in sorted(queries.queries()) if n.startswith("op")] and len(queries.queries()) == 13
    assert set(queries.oracle_sql()) <= set(queries.queries()) and "pipeline" in entry.queries()


def test_pipeline_stages(spark, docs):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, out, "")
        assert after.columns == docs.columns, name
        assert after.count() <= out.count()
        out = after.cache()
    last = corpus_pipeline.STAGES[-1][1](spark, out, "")
    assert {"doc_id", "token_ids", "n_tokens"} <= set(last.columns) and last.count() == out.count()
