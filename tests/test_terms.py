"""Term matching against a plain scan of patterns, by both ways."""

import random
import re

import pytest

from lexmill.operators import glossary as G

TERMS = ["the", "of the", "la-de", "a.b", "term (x)", "++", "c++", "été", "one two three four five six seven eight", "(y)", "x", "semi - colon", "_u_"]
ENTRIES = "ord int, en string, fr string, fr_alt array<string>, abbreviation string, note string"


def texts():
    rng = random.Random(9)
    bits = ["the", "of", "The", "la", "de", "-", "a", ".", "b", "term", "(X)", "(x)y", "++", "c++", "x++y", "ÉTÉ", "étés", " ", "\n", "one two three", "four five six seven eight", "(y)", "z(y)z", "semi - colon", "_u_", "9", "x"]
    return [(i, "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 25)))) for i in range(400)] + [(900, None), (901, ""), (None, "the x"), (902, "x " * 60_000 + "the")]


def scanned(lenient):
    out = set()
    for k, t in texts():
        normal = " ".join((t or "").lower().split())
        for en in TERMS:
            for form in {en, en.replace(" ", "-") if " " in en else en.replace("-", " ")}:
                side = lambda c: r"\b" if not lenient or re.match(r"\w", c) else ""
                if re.search(side(form[0]) + re.escape(form) + side(form[-1]), normal):
                    out.add((k, en, en.upper()))
    return out


@pytest.mark.parametrize("lenient", [False, True])
@pytest.mark.parametrize("most_bytes", [G.TERM_BYTES, 0])
def test_against_a_scan(spark, lenient, most_bytes):
    ix = G.index(spark.createDataFrame([(i, en, en.upper(), None, None, None) for i, en in enumerate(TERMS)], ENTRIES))
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    got = G.find_terms(df, ix, lenient=lenient, most_bytes=most_bytes).collect()
    assert {tuple(r) for r in got} == scanned(lenient) and len(got) == len(scanned(lenient))


def test_first_entry_and_nothing(spark):
    entries = [(0, "Self report", "a", None, "sr", None), (1, "self report", "b", None, None, None), (2, "Self report", "c", None, "SRQ", None)]
    ix = G.index(spark.createDataFrame(entries, ENTRIES))
    df = spark.createDataFrame([(1, "an SR and SRQ"), (2, "nothing")], "doc_id long, text string")
    for most in (G.TERM_BYTES, 0):
        assert [tuple(r) for r in G.find_terms(df, ix, most_bytes=most).collect()] == [(1, "Self report", "a")]
        assert G.find_terms(df.where("false"), ix, most_bytes=most).count() == G.find_terms(df, ix.where("false"), most_bytes=most).count() == 0
    held = G.find_terms(df, ix)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in held.split("MapInArrow")[0] and "Cartesian" not in G.find_terms(df, ix, most_bytes=0)._jdf.queryExecution().executedPlan().toString()


def test_automaton_of_many_terms(spark):
    """Thousands of terms, each text read once."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    ix = G.index(spark.createDataFrame([(i, w, None, None, None, None) for i, w in enumerate(dict.fromkeys(words))], ENTRIES))
    data = [(i, " ".join(rng.choice(words) + rng.choice(["", "zz"]) for _ in range(300))) for i in range(30)]
    got = {(r["doc_id"], r["en"]) for r in G.find_terms(spark.createDataFrame(data, "doc_id long, text string"), ix).collect()}
    assert got == {(i, w) for i, t in data for w in set(t.split()) & set(words)}


def test_first_pattern(spark):
    """The pattern of least priority contained in a text, by one automaton."""
    from lexmill.sources import readers

    patterns = spark.createDataFrame([(3, "b", None, "result"), (1, "a", None, "method"), (2, "c", None, "ethod"), (9, "z", None, "re")], "priority int, section string, lang string, pattern string")
    df = spark.createDataFrame([(1, "Results by METHOD"), (2, "results"), (3, "nothing"), (4, None), (None, "are"), (5, "ethod"), (5, "Results")], "k long, t string")
    assert {(r["k"], r["section"]) for r in readers.first_pattern(df, patterns, "k", "t").collect()} == {(1, "a"), (2, "b"), (None, "z"), (5, "c")}
    assert readers.first_pattern(df, patterns.where("false"), "k", "t").count() == 0 == readers.first_pattern(df.where("false"), patterns, "k", "t").count()
    with pytest.raises(ValueError):
        readers.first_pattern(df, patterns, "k", "t", most_bytes=3)
