"""Language identification by word-first backoff.

A word the model knows scores by its per-language log frequency. An unseen word falls back to
the longest character n-grams of it that are known, from five characters down to one.

Defined cases: a null text or a text without a letter is ``und`` with score 0; rows whose
language label is null are never learned from; with no labelled row at all every text is
``und``; ties go to the alphabetically first language; repeated rows are predicted alike; very
long texts count whole; an empty table gives no rows; other columns pass through, and those of the
names that are added are replaced.

What is learnt is bounded by one parameter: about `DOCS_PER_LANG` distinct labelled texts of a
language (all of them where there are no more, else by a hash of the text; copies of a text that is
taken all count). All words and n-grams of these are kept. Every language with a label is learnt: a model of
more than `MOST_LANGS` languages is refused, not cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import Words, codes_of, letters, pieces, rolling, span_hashes
from lexmill.session import free

UNKNOWN = "und"
DOCS_PER_LANG, MOST_LANGS = 4000, 1000
LEAST = 0.5  # score from which on the pipeline keeps a document
MARK = 0x2581  # begins and ends a word in n-grams


class Table:
    """Log frequencies of strings by language, found by hash. Only pairs that were counted are held:
    a string's score in a language is that of an uncounted one, plus what its count adds."""

    SMOOTH = 0.5

    def __init__(self, hashes: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int) -> None:
        self.hashes, at = np.unique(hashes, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.hashes)))]).astype(np.int64)
        self.langs, self.adds = langs[order].astype(np.int32), np.log((counts[order] + self.SMOOTH) / self.SMOOTH)
        totals = np.bincount(langs, counts, n_langs)
        self.base = np.log(self.SMOOTH / (totals + self.SMOOTH * max(1, len(self.hashes))))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 for unknown ones."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def sums(self, rows: np.ndarray, of: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
        """Sum of the scores of rows by language for each of n groups, `of` being the group of a row."""
        weights = np.ones(len(rows)) if weights is None else weights
        sizes = self.starts[rows + 1] - self.starts[rows]
        each = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(each)) + np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes)
        cells = of[each] * len(self.base) + self.langs[at]
        added = np.bincount(cells, self.adds[at] * weights[each], n * len(self.base)).reshape(n, len(self.base))
        return added + np.outer(np.bincount(of, weights, n), self.base)


def grams_of(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `size`-grams of words with a mark before and after, and the word of each."""
    firsts = np.concatenate([[0], np.cumsum(lengths + 2)])
    padded = np.full(firsts[-1], MARK, np.uint32)
    inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    padded[inner + np.repeat(firsts[:-1] + 1, lengths)] = codes[inner + np.repeat(starts, lengths)]
    a, b, of = rolling(firsts, size)
    return span_hashes(padded, a, b), np.repeat(np.arange(len(lengths)), np.diff(of))


class Model:
    """Tables of words (size 0) and of their n-grams by size; langs are sorted."""

    LONGEST = 5

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """counts: by size, hashes, languages (places in langs) and how often the one occurs in the other."""
        self.langs = langs
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        self.words, *grams = (Table(*counts.get(size, none), len(langs)) for size in range(self.LONGEST + 1))
        self.grams = dict(enumerate(grams, 1))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of word scores by text and language, and the number of words of each text."""
        codes, bounds = codes_of([t.lower() for t in texts])
        found = Words(codes, bounds, ~letters())
        n = len(texts)
        rows = self.words.find(found.hashes())
        known, unseen = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        out = self.words.sums(rows[known], found.doc[known], n)
        starts, lengths, doc = found.starts[unseen], (found.ends - found.starts)[unseen], found.doc[unseen]
        for size in range(self.LONGEST, 0, -1):
            if not len(doc):
                break
            hashes, word = grams_of(codes, starts, lengths, size)
            row = self.grams[size].find(hashes)
            word, row = word[row >= 0], row[row >= 0]
            hits = np.bincount(word, minlength=len(doc))
            out += self.grams[size].sums(row, doc[word], n, 1 / hits[word])
            rest = hits == 0
            starts, lengths, doc = starts[rest], lengths[rest], doc[rest]
        return out, found.counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the share of the best under a softmax in which, as
        words of a text are not independent, evidence grows with the root of their number."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        totals, n = self.totals(texts)
        best = totals.argmax(axis=1)
        z = (totals - totals.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
        score = np.where(n > 0, 1.0 / np.exp(z).sum(axis=1), 0.0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], score


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG, most_langs: int = MOST_LANGS) -> Model:
    """Learn from about `docs_per_lang` distinct labelled texts of each language, chosen by a hash of
    the text, all of them where there are no more. Words and n-grams are counted on executors, and what
    comes to the driver is their hashes and counts, as many as that sample holds."""
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(text).alias("h"))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not sizes:
        return Model([], {})
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, docs_per_lang / max(1, n)))])[F.col("l")]
    place = F.create_map(*[F.lit(x) for i, l in enumerate(langs) for x in (l, i)])[F.col("l")]
    sampled = labelled.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).groupBy("l", "h").agg(F.min("t").alias("t"), F.count("*").alias("copies"))
    tokens = sampled.select(place.alias("lang"), "copies", F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    words = tokens.groupBy("lang", "w").agg(F.sum("copies").alias("n"))
    found = words.mapInArrow(gram_counts, "size int, hash long, lang int, n long").groupBy("size", "hash", "lang").agg(F.sum("n").alias("n")).toArrow()
    size, hashes, of, n = (found.column(c).to_numpy() for c in ("size", "hash", "lang", "n"))
    return Model(langs, {k: (hashes[own].view(np.uint64), of[own].astype(np.int64), n[own].astype(np.float64)) for k in range(Model.LONGEST + 1) if (own := size == k).any()})


def gram_counts(batches):
    """(size, hash, lang, n) of (lang, w, n): words, as size 0, and their n-grams, summed in each batch."""
    for batch in batches:
        lang, times = batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy()
        codes, bounds = codes_of(batch.column(1).to_pylist())
        starts, lengths = bounds[:-1], np.diff(bounds) - 1
        for size in range(Model.LONGEST + 1):
            hashes, word = grams_of(codes, starts, lengths, size) if size else (span_hashes(codes, starts, starts + lengths), np.arange(len(lengths)))
            order = np.lexsort((hashes, lang[word]))
            hashes, word = hashes[order], word[order]
            of = lang[word]
            heads = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]) if len(hashes) else np.zeros(0, np.int64)
            if len(heads):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), size, np.int32)), pa.array(hashes[heads].view(np.int64)), pa.array(of[heads].astype(np.int32)), pa.array(np.add.reduceat(times[word], heads))], ["size", "hash", "lang", "n"])


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs' `keep` columns (all by default) with a predicted language and a score in [0, 1]."""
    keep = docs.columns if keep is None else keep
    taken = [c for c in keep if c not in (pred, score)]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of a sample bounded by fit()'s parameters
    (given_text,) = free(docs, "text")
    given = docs.select(*taken, F.col(text).alias(given_text))
    names = [*taken, pred, score]

    def run(batches):
        for batch in pieces(batches, given_text):
            langs, scores = shared.value.predict([x or "" for x in batch.columns[-1].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], names)

    schema = docs.select(*taken).schema.add(pred, "string").add(score, "double")
    return given.mapInArrow(run, schema)


def is_held_out(doc_id) -> F.col:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    held = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return predict(held, model, keep=["doc_id", "held_out"])


def filter_languages(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Pipeline stage: drop documents without an identifiable language (`und` or a score under
    `least`); the columns of docs are returned unchanged."""
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    pred, score = free(docs, "pred", "score")
    scored = predict(docs, model, pred=pred, score=score)
    kept = scored.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least))
    return kept.select(*docs.columns)
