"""Content words by a lemma model that is learned from a corpus, without a lexicon.

The words of each language are counted by documents. A suffix is a rule if often enough what is
left of a word without it is a word as well: its frequencies are those of the words that end in it
and of their stems that occur. A word's lemma is what is left of it without the rules it ends in, as
long as a stem remains, so inflected forms of words that were never seen meet as well. Words found in a large
share of a language's documents are function words, which have no lemma here.

Learning is counting and one join of words with stems; what comes out is small: a rule has to
account for a share of the words of its language, a function word for a share of the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: Letters of the longest suffix and of the least stem; documents that a word has to be in to be learnt from.
LONGEST, LEAST_STEM, SEEN = 4, 3, 2
#: Share of a language's words that a rule's stems are, and of a suffix's words that have their stem.
SHARE, CONFIDENCE = 0.002, 0.25
#: Share of documents from which on a word is a function word; letters that a content word exceeds.
FUNCTION, SHORT = 0.25, 2


def words(c: Column) -> Column:
    """Distinct runs of letters, in lower case, of more than SHORT letters; none for null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > SHORT))


def word_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n): number of documents of a language that hold a word. Null languages are left out."""
    each = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(words(F.col(text))).alias("word"))
    return each.groupBy("lang", "word").agg(F.count("*").alias("n"))


def suffix_rules(counts: DataFrame, share: float = SHARE, confidence: float = CONFIDENCE) -> DataFrame:
    """(lang, suffix, n_words, n_stems) of the suffixes that are rules: at most LONGEST / share a language."""
    known = counts.where(F.col("n") >= SEEN).select("lang", "word")
    cut = known.select("lang", "word", F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("k")).where(F.length("word") - F.col("k") >= LEAST_STEM)
    cut = cut.select("lang", F.left("word", F.length("word") - F.col("k")).alias("stem"), F.right("word", F.col("k")).alias("suffix"))
    stems = known.select("lang", F.col("word").alias("stem"), F.lit(1).alias("there"))
    ends = cut.join(stems, ["lang", "stem"], "left").groupBy("lang", "suffix").agg(F.count("*").alias("n_words"), F.count("there").alias("n_stems"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))
    held = ends.join(sizes, "lang").where((F.col("n_stems") >= share * F.col("size")) & (F.col("n_stems") >= confidence * F.col("n_words")))
    return held.select("lang", "suffix", "n_words", "n_stems")


def function_words(counts: DataFrame, docs: DataFrame, lang: str = "lang", share: float = FUNCTION) -> DataFrame:
    """(lang, word, n) of words in at least `share` of their language's documents: no more of them than
    words in an average document over the share."""
    sizes = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("size"))
    return counts.join(sizes, "lang").where(F.col("n") >= share * F.col("size")).select("lang", "word", "n")


@dataclass
class Lemmas:
    """Rules and function words by language; a language without rules keeps its words as they are."""

    suffixes: dict[str, list[str]] = field(default_factory=dict)
    functions: dict[str, list[str]] = field(default_factory=dict)

    def pattern(self, lang: str) -> str | None:
        """What a reversed word loses: suffixes on end, the longest first, while a stem remains. A form
        that looks as if it had a suffix itself loses it like its inflected forms do, and they still
        meet. Nothing that was matched is tried again, so the time is in proportion to the word."""
        own = sorted(self.suffixes.get(lang, []), key=lambda s: (-len(s), s))
        return rf"^(?>(?:{'|'.join(s[::-1] for s in own)})(?=\p{{L}}{{{LEAST_STEM}}}))*+" if own else None

    def lemma(self, word: Column, lang: str) -> Column:
        pattern = self.pattern(lang)
        return F.reverse(F.regexp_replace(F.reverse(word), pattern, "")) if pattern else word

    def content(self, text: Column, lang: str) -> Column:
        """Sorted distinct lemmas of the content words of a text."""
        own = F.filter(words(text), lambda w: ~w.isin(*self.functions[lang])) if self.functions.get(lang) else words(text)
        return F.array_sort(F.array_distinct(F.transform(own, lambda w: self.lemma(w, lang))))

    def content_by(self, text: Column, lang: Column) -> Column:
        """The same for texts of many languages; those that aren't known keep their words."""
        chain = F.when(F.lit(False), words(text))
        for known in sorted({*self.suffixes, *self.functions}):
            chain = chain.when(lang == known, self.content(text, known))
        return chain.otherwise(F.array_sort(words(text)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE, confidence: float = CONFIDENCE, function: float = FUNCTION, most_langs: int = 200) -> Lemmas:
    """The model of a corpus; more than `most_langs` languages are refused, as the model holds lists for each."""
    counts = word_documents(docs, text, lang)
    if docs.select(lang).where(F.col(lang).isNotNull()).distinct().limit(most_langs + 1).count() > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    model = Lemmas()
    for r in suffix_rules(counts, share, confidence).orderBy("lang", "suffix").collect():
        model.suffixes.setdefault(r["lang"], []).append(r["suffix"])
    for r in function_words(counts, docs, lang, function).orderBy("lang", "word").collect():
        model.functions.setdefault(r["lang"], []).append(r["word"])
    return model
