"""Glossary index, term matching in texts, and verification of target terms."""

from __future__ import annotations

from collections.abc import Iterator
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import text as X


def index(entries: DataFrame) -> DataFrame:
    """(term_key, en, fr, fr_alt, note, ord) of entries(ord, en, fr, fr_alt, abbreviation, note):
    a key per normalised term, its hyphen variant and its abbreviation; later entries win."""
    term = X.normalize(F.col("en"))
    keys = F.array_distinct(F.array_compact(F.array(term, X.hyphen_variant(term), X.normalize(F.col("abbreviation")))))
    keyed = entries.select(F.explode(keys).alias("term_key"), F.struct("ord", "en", "fr", "fr_alt", "note").alias("e"))
    return keyed.where("term_key <> ''").groupBy("term_key").agg(F.max_by("e", "e.ord").alias("e")).select("term_key", "e.*")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\](){}*+?^$|/-])", r"\\$1")


def pattern(term: Column, lenient: bool = False) -> Column:
    """Word-bounded pattern. A term that ends in ')' matches only before a word character, as \\b
    asks; lenient drops the bound on a side without a word character."""
    if not lenient:
        return F.concat(F.lit(r"(?U)\b"), escape(term), F.lit(r"\b"))
    side = lambda at: F.when(at.rlike(r"(?U)^\w$"), r"\b").otherwise("")
    return F.concat(F.lit("(?U)"), side(F.left(term, F.lit(1))), escape(term), side(F.right(term, F.lit(1))))


#: Bytes of term keys that tasks hold as one automaton; a larger glossary meets texts by joins.
TERM_BYTES = 8 << 20


def find_terms(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", lenient: bool = False, most_bytes: int = TERM_BYTES) -> DataFrame:
    """(key, en, fr): terms found in each text, one row per text and en; of entries with one en the first
    found gives fr. A term matches on word bounds (letters, numbers and '_' are of words), as pattern().

    A glossary of at most `most_bytes` is held by every task as one automaton, which reads each text
    once whatever the number of terms, and nothing is shuffled. A larger one meets the texts by
    equality of word runs, and the exact pattern decides. Null texts are empty; a null key counts as
    a key; several rows of one key are one text's in the second way and texts of their own in the first."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term_key")), F.lit(0))).first()[0]
    normal = texts.select(F.col(key), X.normalize(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return _by_automaton(normal, terms, key, lenient) if size <= most_bytes else _by_runs(normal, terms, key, lenient)


def _of_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def bounded(text: str, start: int, end: int, lenient: bool = False) -> bool:
    """Whether text[start:end] has a word bound on both sides; lenient asks for none on a side whose
    character is not of a word."""
    first, last = _of_word(text[start]), _of_word(text[end - 1])
    before, after = start > 0 and _of_word(text[start - 1]), end < len(text) and _of_word(text[end])
    return (before != first or lenient and not first) and (after != last or lenient and not last)


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(known: str, keys: list[str]) -> ahocorasick.Automaton:
    """The automaton of keys, built once by each worker for a name."""
    if known not in _AUTOMATA:
        _AUTOMATA.clear()
        built = ahocorasick.Automaton()
        for i, k in enumerate(keys):
            built.add_word(k, (i, len(k)))
        built.make_automaton()
        _AUTOMATA[known] = built
    return _AUTOMATA[known]


def _by_automaton(normal: DataFrame, terms: DataFrame, key: str, lenient: bool) -> DataFrame:
    listed = terms.where("term_key <> ''").select("term_key", "en", "fr", "ord").collect()  # bounded by find_terms
    shape = normal.select(key).schema.add("en", "string").add("fr", "string")
    if not listed:
        return normal.sparkSession.createDataFrame([], shape)
    listed.sort(key=lambda r: (r["ord"], r["term_key"]))
    shared = normal.sparkSession.sparkContext.broadcast([(r["term_key"], r["en"], r["fr"]) for r in listed])
    known = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        automaton = _automaton(known, [e[0] for e in entries])
        for batch in batches:
            rows, found = [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                hits = {i for end, (i, size) in automaton.iter(t) if bounded(t, end + 1 - size, end + 1, lenient)}
                own: dict[str, str] = {}
                for i in sorted(hits):
                    own.setdefault(entries[i][1], entries[i][2])
                rows += [row] * len(own)
                found += own.items()
            en, fr = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(en, pa.string()), pa.array(fr, pa.string())], [key, "en", "fr"])

    return normal.mapInArrow(run, shape)


def contained(texts: DataFrame, patterns: list[tuple[int, str, str]], key: str) -> DataFrame:
    """(key, priority, section) of the first of patterns(priority, pattern, section) that each text of
    texts(key, t) contains anywhere; no row for texts with none. An empty pattern is in every text."""
    shape = texts.select(key).schema.add("priority", "long").add("section", "string")
    ordered = sorted(patterns, key=lambda p: p[0])
    always = next((i for i, p in enumerate(ordered) if not p[1]), None)
    if not ordered:
        return texts.sparkSession.createDataFrame([], shape)
    shared, known = texts.sparkSession.sparkContext.broadcast(ordered), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        first: dict[str, int] = {}
        for i, p in enumerate(entries):
            first.setdefault(p[1], i)
        words = [w for w in first if w]
        automaton = _automaton(known, words) if words else None
        for batch in batches:
            rows, hits = [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                found = [first[words[i]] for _, (i, _) in automaton.iter(t)] if automaton else []
                if always is not None:
                    found.append(always)
                if found:
                    rows.append(row)
                    hits.append(entries[min(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([h[0] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.string())], shape.names)

    return texts.mapInArrow(run, shape)


#: Tokens of the longest runs that texts and terms meet by.
RUN = 6


def _by_runs(normal: DataFrame, terms: DataFrame, key: str, lenient: bool) -> DataFrame:
    """Terms meet texts by their first RUN tokens, and the exact pattern decides. A term without a token
    is one whole run of what lies between two words, as it has to begin and end at word bounds; lenient
    asks for no bounds there, and such terms, a matter of marks and signs, go by the automaton."""
    split = lambda c, p: F.filter(F.split(c, p), lambda w: w != "")
    tokens = lambda c: split(c, r"[^\p{L}\p{N}_]+")
    listed = terms.where("term_key <> ''").select("term_key", "en", "fr", "ord", F.slice(tokens(F.col("term_key")), 1, RUN).alias("w"))
    bare = listed.where(F.size("w") == 0)
    by_run = listed.where(F.size("w") > 0).withColumn("run", F.array_join("w", " "))
    sizes = sorted(r[0] for r in by_run.select(F.size("w")).distinct().collect())  # at most RUN values

    def of_size(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    runs = lambda w: F.flatten(F.array(*[of_size(w, n) for n in sizes]))
    # Bound as a variable, the tokens are made once per text and not once per run.
    own = F.flatten(F.transform(F.array(tokens(F.col("t"))), runs)) if sizes else F.array().cast("array<string>")
    if not lenient:
        by_run = by_run.union(bare.withColumn("run", F.concat(F.lit("\0"), "term_key")))
        own = F.concat(own, F.transform(split(F.col("t"), r"[\p{L}\p{N}_]+"), lambda w: F.concat(F.lit("\0"), w)))
    # Runs meet terms without their text, which joins again per document that has candidates.
    looked = normal.select(key, F.explode(F.array_distinct(own)).alias("run")).join(by_run, "run")
    likely = looked.groupBy(F.col(key).alias("of")).agg(F.collect_set(F.struct("term_key", "en", "fr", "ord")).alias("c"))
    each = normal.join(likely, F.col(key).eqNullSafe(F.col("of"))).select(key, "t", F.explode("c").alias("c")).select(key, "t", "c.*")
    found = each.where(F.regexp_like("t", pattern(F.col("term_key"), lenient))).groupBy(key, "en").agg(F.min_by("fr", "ord").alias("fr"))
    return found.unionByName(_by_automaton(normal, bare, key, lenient)) if lenient else found


def terms_by_text(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", lenient: bool = False) -> DataFrame:
    """(key, terms): the terms found in each text that has any, as an array of structs (en, fr, fr_alt)
    in order of en; a row a text."""
    hits = find_terms(texts, terms, key, text, lenient)
    # Of entries with one en the first one's alternatives, as the join must not repeat a term.
    known = terms.groupBy("en").agg(F.min_by("fr_alt", "ord").alias("fr_alt"))
    each = hits.join(known, "en")
    return each.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("en", "fr", "fr_alt"))).alias("terms"))


def with_terms(pairs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """pairs with a column terms of found(key, terms), empty where none were found."""
    none = F.array().cast(found.schema["terms"].dataType)
    return pairs.drop("terms").join(found, key, "left").withColumn("terms", F.coalesce("terms", none))


def missing_terms(found: DataFrame, targets: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, missing): "en -> fr" of found terms of which neither fr nor an alternative is a part of
    the normalised target text. Empty variants are ignored."""
    variants = F.filter(F.transform(F.concat(F.array("fr"), F.coalesce("fr_alt", F.array().cast("array<string>"))), X.normalize), lambda v: v != "")
    known = entries.select("en", variants.alias("variants")).dropDuplicates(["en"])
    joined = found.join(known, "en").join(targets.select(key, X.normalize(F.coalesce(F.col(text), F.lit(""))).alias("t")), key)
    lost = joined.where(~F.exists("variants", lambda v: F.contains(F.col("t"), v)))
    return lost.select(key, F.concat_ws(" -> ", "en", "fr").alias("missing"))


def entry(terms: DataFrame, term: str) -> DataFrame:
    return terms.where(F.col("term_key") == X.normalize(F.lit(term)))


def all_terms(terms: DataFrame) -> DataFrame:
    return terms.groupBy("en").agg(F.min_by("fr", "ord").alias("fr"))


def stamp(df: DataFrame, version: str) -> DataFrame:
    """df with the glossary version it was made with."""
    return df.withColumn("glossary_version", F.lit(version))
