"""Source and target text comparisons, as Columns over precomputed features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import text as X, vocabulary as V
from lexmill.operators.lemmas import Lemmas
from lexmill.session import free

SENTENCE_BOUNDS, WORD_BOUNDS, RECALL_FLOOR, LEAST_TERMS = (0.85, 1.15), (0.9, 1.5), 0.7, 3
#: Ranges by target language where one is known to differ.
WORD_BOUNDS_BY_LANG = {"fr": (0.9, 1.5), "es": (0.95, 1.6), "de": (0.9, 1.5)}


def ratio(target: Column, source: Column) -> Column:
    return target / F.greatest(source, F.lit(1))


def outside(r: Column, bounds: tuple[float, float], flag: str) -> Column:
    """The flag where an unrounded ratio leaves the inclusive bounds."""
    return F.when((r < bounds[0]) | (r > bounds[1]), flag)


def sentence_flag(source: Column, target: Column) -> Column:
    return outside(ratio(target, source), SENTENCE_BOUNDS, "SENTMIS")


def word_flag(source: Column, target: Column, lang: str = "fr") -> Column:
    return outside(ratio(target, source), WORD_BOUNDS_BY_LANG.get(lang, WORD_BOUNDS), "WORDMIS")


def numbers_missing(source: Column, target: Column) -> Column:
    return F.array_sort(F.array_except(source, target))


def content_words(c: Column, lang: str = "fr", lemmas: Lemmas | None = None) -> Column:
    """Lemmas of content words by a learned model; without one, letter runs over two characters that
    are no stop words, with plural and gender endings cut."""
    if lemmas is not None:
        return lemmas.content(c, lang)
    tokens = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+"), lambda w: (F.length(w) > 2) & ~w.isin(*V.STOPWORDS[lang]))
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "(es|s|e)$", "")).otherwise(w))))


def recall(expected: Column, actual: Column, entries: Column) -> Column:
    """Share of expected words present; 1 where there are too few terms to judge."""
    judged = (entries >= LEAST_TERMS) & (F.size(expected) >= LEAST_TERMS)
    return F.when(judged, F.size(F.array_intersect(expected, actual)) / F.size(expected)).otherwise(F.lit(1.0))


def severity(code: Column) -> Column:
    return F.when(code.isin(*V.FLAGS["blocking"]), "blocking").when(code.isin(*V.FLAGS["warning"]), "warning").otherwise("unknown")


def features(pairs: DataFrame, source: str = "source_text", target: str = "target_text") -> DataFrame:
    """pairs with counts and number sets of both texts, each computed once."""
    out = pairs
    for side, c in (("s", source), ("t", target)):
        out = out.withColumns({f"{side}_words": X.count_words(F.col(c)), f"{side}_sentences": X.count_sentences(F.col(c)), f"{side}_numbers": X.numbers(F.col(c))})
    return out


def verify_terms(target: Column, terms: Column) -> Column:
    """Of found terms, an array of structs (en, fr, fr_alt), those of which neither fr nor an alternative is
    a part of the normalised target text, as "en -> fr"; empty variants are ignored, and a term with
    none but empty ones is missing."""
    low = X.normalize(F.coalesce(target, F.lit("")))
    variants = lambda t: F.filter(F.transform(F.concat(F.array(t.fr), F.coalesce(t.fr_alt, F.array().cast("array<string>"))), X.normalize), lambda v: F.coalesce(v != "", F.lit(False)))
    # Bound as a variable, the normalised text is made once and not once per term.
    lost = F.transform(F.array(low), lambda n: F.filter(terms, lambda t: ~F.exists(variants(t), lambda v: F.contains(n, v))))
    return F.transform(F.flatten(lost), lambda t: F.concat_ws(" -> ", t.en, F.coalesce(t.fr, F.lit(""))))


def check_pairs(pairs: DataFrame, source: str = "source_text", target: str = "target_text", terms: str | None = None, lang: str = "fr", lemmas: Lemmas | None = None) -> DataFrame:
    """pairs with ratios, missing and added numbers, flags by severity, and whether they pass. terms
    names an array column of the terms found in the source, if there is one: strings, the expected
    target terms, or structs (en, fr, fr_alt), of which an alternative does as well. lemmas is the
    model that content words are compared by."""
    f = features(pairs, source, target)
    none = F.array().cast("array<string>")
    expected = actual = missing_terms = none
    entries = F.lit(0)
    if terms:
        structs = pairs.schema[terms].dataType.elementType.typeName() == "struct"
        wanted = F.transform(F.col(terms), lambda t: t.fr) if structs else F.col(terms)
        entries = F.size(terms)
        expected, actual = content_words(F.array_join(wanted, " "), lang, lemmas), content_words(F.col(target), lang, lemmas)
        missing_terms = verify_terms(F.col(target), F.col(terms)) if structs else F.filter(F.col(terms), lambda t: ~F.contains(X.normalize(F.col(target)), X.normalize(t)))
    own_expected, own_actual = free(f, "expected", "actual")
    f = f.withColumns({own_expected: expected, own_actual: actual, "missing_terms": missing_terms})
    f = f.withColumns({
        "sentence_ratio": ratio(F.col("t_sentences"), F.col("s_sentences")), "word_ratio": ratio(F.col("t_words"), F.col("s_words")),
        "term_recall": recall(F.col(own_expected), F.col(own_actual), entries), "missing_words": F.array_except(own_expected, own_actual),
        "missing_numbers": numbers_missing(F.col("s_numbers"), F.col("t_numbers")), "added_numbers": numbers_missing(F.col("t_numbers"), F.col("s_numbers")),
    })
    blocking = F.array_compact(F.array(outside(F.col("sentence_ratio"), SENTENCE_BOUNDS, "SENTMIS"), word_flag(F.col("s_words"), F.col("t_words"), lang)))
    warning = F.array_compact(F.array(F.when(F.col("term_recall") < RECALL_FLOOR, "WORDDRIFT"), F.when(F.size("missing_numbers") > 0, "STATMIS"), F.when(F.size("missing_terms") > 0, "TERMMIS")))
    return f.withColumns({"blocking_flags": blocking, "warning_flags": warning}).withColumn("passes", F.size("blocking_flags") == 0).drop(own_expected, own_actual)
