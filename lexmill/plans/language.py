"""Registered queries of learned language models (lemmas, sentence ends) and of checks that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.operators import boundaries as S, classify as C, glossary as G, lemmas as L, quality as Q, relational as R
from lexmill.plans.layout import sentences_sql
from lexmill.plans.texts import BLANKS, NEXT, docs, numbers_sql, words_sql
from lexmill.session import stash, table

# The lemma model: words of documents, suffix rules, function words, and a pattern for each language.
WORD_SQL = r"list_distinct(list_filter(string_split_regex(lower({c}), '[^\p{L}]+'), lambda x: length(x) > 2))"


def word_list(c: str) -> str:
    return WORD_SQL.replace("{c}", c)


MODEL = rf"""wd AS MATERIALIZED (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({word_list("text")}) AS word FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL) GROUP BY 1, 2),
kn AS MATERIALIZED (SELECT lang, word FROM wd WHERE n >= {L.SEEN}),
cut AS (SELECT lang, left(word, length(word) - k) AS stem, right(word, k) AS suffix FROM kn, (SELECT unnest(range(1, {L.LONGEST + 1})) AS k) WHERE length(word) - k >= {L.LEAST_STEM}),
en AS (SELECT c.lang, suffix, count(*) AS n_words, count(s.word) AS n_stems FROM cut c LEFT JOIN kn s ON s.lang = c.lang AND s.word = c.stem GROUP BY 1, 2),
sz AS (SELECT lang, count(*) AS size FROM kn GROUP BY 1),
rl AS MATERIALIZED (SELECT lang, suffix, n_words, n_stems FROM en JOIN sz USING (lang) WHERE n_stems >= {L.SHARE}::DOUBLE * size AND n_stems >= {L.CONFIDENCE}::DOUBLE * n_words),
fw AS MATERIALIZED (SELECT lang, word, n FROM wd JOIN (SELECT lang, count(*) AS size FROM documents WHERE lang IS NOT NULL GROUP BY 1) USING (lang) WHERE n >= {L.FUNCTION}::DOUBLE * size),
pt AS MATERIALIZED (SELECT lang, '^(?:' || string_agg(reverse(suffix), '|' ORDER BY length(suffix) DESC, suffix) || ')*(.{{{L.LEAST_STEM},}})$' AS pattern FROM rl GROUP BY 1)"""


def lemma_rules(spark, sf):
    """Suffix rules of each language, with the words and stems they rest on."""
    return L.suffix_rules(L.word_documents(docs(spark, sf)))


def function_words(spark, sf):
    d = docs(spark, sf)
    return L.function_words(L.word_documents(d), d)


def content_lemmas(spark, sf):
    """The lemmas of each document's content words, by the model of all documents."""
    d = docs(spark, sf)
    found = L.learn(d).content_by(F.col("text"), F.col("lang"))
    return d.select("doc_id", found.alias("l")).select("doc_id", F.size("l").cast("long").alias("n_lemmas"), F.md5(F.array_join("l", " ")).alias("digest"))


# Patterns that aren't constant are compiled for every row: lemmas are told once for each word.
CONTENT = rf"""WITH {MODEL},
lw AS MATERIALIZED (SELECT lang, word, CASE WHEN pattern IS NULL THEN word ELSE reverse(regexp_replace(reverse(word), pattern, '\1')) END AS lemma FROM wd LEFT JOIN pt USING (lang)),
t AS (SELECT doc_id, d.lang, unnest({word_list("text")}) AS word FROM documents d),
l AS (SELECT DISTINCT doc_id, lemma FROM t JOIN lw USING (lang, word) WHERE NOT EXISTS (SELECT 1 FROM fw WHERE fw.lang = t.lang AND fw.word = t.word)),
g AS (SELECT doc_id, count(*) AS n, md5(string_agg(lemma, ' ' ORDER BY lemma)) AS digest FROM l GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lemmas, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN g USING (doc_id)"""

# Real pairs: each document and the next one of its source, with a glossary of words of the benchmark.
LEAST_LETTERS = 5


def word_glossary(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark as a glossary: a word stands for itself or, as an alternative, its last letter less."""
    words = F.explode(L.words(F.col("text")))
    en = table(spark, sf, "benchmark").select("item_id", words.alias("en")).where(F.length("en") >= LEAST_LETTERS).groupBy("en").agg(F.min("item_id").cast("int").alias("ord"))
    alt = F.array(F.left("en", F.length("en") - 1), F.lit(" "))
    return en.select("ord", "en", F.col("en").alias("fr"), alt.alias("fr_alt"), F.lit(None).cast("string").alias("abbreviation"), F.lit(None).cast("string").alias("note"))


def next_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source_text, target_text) of adjacent documents of a source that have both texts."""
    d = docs(spark, sf)
    after = R.with_next(d.select("doc_id", "source"), "source", "doc_id", ["doc_id"]).where("next is not null").select("doc_id", F.col("next.doc_id").alias("target"))
    pairs = after.join(d.select("doc_id", F.col("text").alias("source_text")), "doc_id").join(d.select(F.col("doc_id").alias("target"), F.col("text").alias("target_text")), "target")
    return pairs.where("target_text is not null").drop("target")


def compared_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All checks of each pair: glossary terms found in its source, lemmas by the model of all documents."""
    terms = G.terms_by_text(docs(spark, sf), G.index(word_glossary(spark, sf)))
    pairs = G.with_terms(next_pairs(spark, sf), terms, "doc_id")
    return Q.check_pairs(pairs, terms="terms", lemmas=L.learn(docs(spark, sf)))


def word_drift(spark, sf):
    """Recall of the expected content words in the next document, with WORDDRIFT and TERMMIS raised."""
    c = compared_pairs(spark, sf)
    return c.select("doc_id", F.round("term_recall", 6).alias("recall"), F.size("terms").cast("long").alias("n_terms"), F.size("missing_terms").cast("long").alias("n_missing"), F.md5(F.array_join(F.array_sort("missing_words"), " ")).alias("missing_words"), F.array_contains("warning_flags", "WORDDRIFT").alias("drifts"))


PAIRED = rf"""{MODEL}, p AS MATERIALIZED (SELECT * FROM ({NEXT}) WHERE t IS NOT NULL),
g AS (SELECT DISTINCT en FROM (SELECT unnest({word_list("text")}) AS en FROM benchmark) WHERE length(en) >= {LEAST_LETTERS}),
b AS (SELECT doc_id, trim(regexp_replace(lower(s), {BLANKS}, ' ', 'g')) AS ns, trim(regexp_replace(lower(t), {BLANKS}, ' ', 'g')) AS nt, t FROM p),
h AS MATERIALIZED (SELECT DISTINCT doc_id, en FROM (SELECT doc_id, unnest(string_split_regex(ns, '[^\p{{L}}\p{{N}}_]+')) AS en FROM b) JOIN g USING (en)),
m AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT contains(nt, left(en, length(en) - 1))) AS lost FROM h JOIN b USING (doc_id) GROUP BY 1),
sw AS MATERIALIZED (SELECT doc_id, unnest({word_list("t")}) AS word FROM b),
lw AS MATERIALIZED (SELECT w.word, coalesce(reverse(regexp_replace(reverse(w.word), pattern, '\1')), w.word) AS lemma FROM (SELECT en AS word FROM g UNION SELECT word FROM sw) w LEFT JOIN (SELECT pattern FROM pt WHERE lang = 'fr') ON true),
ff AS MATERIALIZED (SELECT word FROM fw WHERE lang = 'fr'),
ex AS MATERIALIZED (SELECT DISTINCT doc_id, lemma FROM h JOIN lw ON lw.word = h.en WHERE en NOT IN (SELECT word FROM ff)),
ac AS MATERIALIZED (SELECT DISTINCT doc_id, lemma FROM sw JOIN lw USING (word) WHERE word NOT IN (SELECT word FROM ff)),
r AS (SELECT doc_id, count(*) AS n_expected, count(ac.lemma) AS n_there, md5(coalesce(string_agg(ex.lemma, ' ' ORDER BY ex.lemma) FILTER (ac.lemma IS NULL), '')) AS missing FROM ex LEFT JOIN ac USING (doc_id, lemma) GROUP BY 1),
q AS MATERIALIZED (SELECT doc_id, coalesce(m.n, 0) AS n_terms, coalesce(m.lost, 0) AS n_missing, CASE WHEN coalesce(m.n, 0) >= 3 AND coalesce(n_expected, 0) >= 3 THEN n_there::DOUBLE / n_expected ELSE 1.0 END AS recall, coalesce(missing, md5('')) AS missing FROM p LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id))"""
DRIFT = f"WITH {PAIRED} SELECT doc_id, round(recall, 6) AS recall, n_terms::BIGINT AS n_terms, n_missing::BIGINT AS n_missing, missing AS missing_words, recall < {Q.RECALL_FLOOR} AS drifts FROM q"


def save_decisions(spark, sf):
    """Gate decisions of saving each document's next one as its translation, by all checks of the texts;
    notes say what was flagged."""
    c = compared_pairs(spark, sf)
    none = F.array().cast("array<struct<code:string,detail:string>>")
    rows = c.select(F.col("doc_id").alias("article_id"), F.lit(None).cast("string").alias("token_error"), none.alias("flags"), *[F.lit(True).alias(x) for x in ("exists", "open_access", "has_source", "has_full_text")], "blocking_flags", "warning_flags")
    return C.gate(rows).select("article_id", "decision", "notes")


SAVED = f"""WITH {PAIRED},
f AS (SELECT doc_id, {words_sql('t')}::DOUBLE / greatest({words_sql('s')}, 1) AS wr, {sentences_sql('t')}::DOUBLE / greatest({sentences_sql('s')}, 1) AS sr,
  len(list_filter({numbers_sql('s')}, lambda x: NOT list_contains({numbers_sql('t')}, x))) AS lost FROM p),
w AS (SELECT doc_id, concat_ws(', ', CASE WHEN recall < {Q.RECALL_FLOOR} THEN 'WORDDRIFT' END, CASE WHEN lost > 0 THEN 'STATMIS' END, CASE WHEN n_missing > 0 THEN 'TERMMIS' END) AS w,
  sr < 0.85 OR sr > 1.15 OR wr < 0.9 OR wr > 1.5 AS blocked FROM f JOIN q USING (doc_id))
SELECT doc_id AS article_id, CASE WHEN blocked THEN 'QUALITY_CHECK_FAILED' ELSE 'accepted' END AS decision, CASE WHEN w = '' THEN '' ELSE '[QUALITY] Auto-detected: ' || w END AS notes FROM w"""

# The sentence model: tokens of documents, and the scores of types.


def ln_sql(n: str, p: str) -> str:
    return f"(CASE WHEN ({n}) <= 0 OR ({p}) <= 0 THEN 0.0::DOUBLE ELSE ({n}) * ln({p}) END)"


def together_sql(first: str, second: str, both: str, total: str) -> str:
    p, p1, p2, rest = f"{second}::DOUBLE / {total}", f"{both}::DOUBLE / {first}", f"({second} - {both})::DOUBLE / ({total} - {first})", f"{total} - {first} - {second} + {both}"
    sides = [" + ".join([ln_sql(both, a), ln_sql(f"{first} - {both}", f"1 - {a}"), ln_sql(f"{second} - {both}", b), ln_sql(rest, f"1 - {b}")]) for a, b in ((f"({p})", f"({p})"), (f"({p1})", f"({p2})"))]
    return f"(-2 * (({sides[0]}) - ({sides[1]})))"


BARE = rf"""regexp_replace(regexp_replace({{t}}, '["''”’»)\]]+$', ''), '^["''“‘«(\[]+', '')"""


def tokens_sql(shared: bool) -> str:
    """The model as SQL: with `shared`, only types that account for a share of the stops of their language."""
    share = lambda n, of: f" AND {n} >= {S.SHARE}::DOUBLE * {of}" if shared else ""
    return rf"""tk AS (SELECT doc_id, lang, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, lang, list_filter(string_split_regex(coalesce(text, ''), {BLANKS}), lambda x: x <> '') AS ts FROM documents WHERE lang IS NOT NULL)),
tb AS (SELECT doc_id, lang, i, {BARE.format(t="t")} AS bare FROM tk),
ty AS (SELECT doc_id, lang, i, bare, regexp_matches(bare, '[^.!?…]\.$') AS stop, lower(regexp_replace(bare, '[.,;:!?…]+$', '')) AS low FROM tb),
tr AS MATERIALIZED (SELECT doc_id, lang, i, bare, stop, type, lead(type) OVER w AS next, lead(bare) OVER w AS next_bare FROM (SELECT *, CASE WHEN regexp_matches(low, '^[0-9][0-9.,/-]*$') THEN '#' ELSE low END AS type FROM ty) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
tc AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY lang)::BIGINT AS total, sum(stops) OVER (PARTITION BY lang)::BIGINT AS total_stops FROM (SELECT lang, type, count(*) AS n, count(*) FILTER (stop) AS stops FROM tr GROUP BY 1, 2)),
sc AS (SELECT *, -2 * (({ln_sql("stops", "total_stops::DOUBLE / total")} + {ln_sql("n - stops", "1 - total_stops::DOUBLE / total")}) - ({ln_sql("stops", f"{S.ALWAYS}::DOUBLE")} + {ln_sql("n - stops", f"{1 - S.ALWAYS}::DOUBLE")}))
  * exp(-length(replace(type, '.', ''))) * (length(type) - length(replace(type, '.', '')) + 1) * pow(length(replace(type, '.', ''))::DOUBLE, -(n - stops)::DOUBLE) AS score FROM tc
  WHERE stops > 1{share("stops", "total_stops")} AND regexp_matches(type, '\p{{L}}')),
ab AS MATERIALIZED (SELECT lang, type, n, stops, score FROM sc WHERE score >= {S.ABBREVIATION}::DOUBLE),
af AS (SELECT lang, next, count(*) AS after FROM tr WHERE stop AND length(type) > 1 AND type <> '#' AND NOT EXISTS (SELECT 1 FROM ab WHERE ab.lang = tr.lang AND ab.type = tr.type) GROUP BY 1, 2),
br AS (SELECT *, sum(after) OVER (PARTITION BY lang)::BIGINT AS breaks FROM af),
ss AS (SELECT b.lang, tc.type, b.after, breaks, n, total, {together_sql("breaks", "n", "after", "total")} AS score FROM br b JOIN tc ON tc.lang = b.lang AND tc.type = b.next),
st AS MATERIALIZED (SELECT lang, type, after, score FROM ss WHERE after * total > breaks * n{share("after", "breaks")} AND score >= {S.STARTER}::DOUBLE AND regexp_matches(type, '^\p{{L}}')),
pr AS (SELECT lang, type, next, count(*) AS "both" FROM tr WHERE stop AND next IS NOT NULL AND (length(type) = 1 OR EXISTS (SELECT 1 FROM ab WHERE ab.lang = tr.lang AND ab.type = tr.type)) GROUP BY 1, 2, 3),
cs AS (SELECT pr.lang, pr.type, pr.next, pr."both", a.n, z.n AS n_next, a.total, a.total_stops, {together_sql("a.n", "z.n", 'pr."both"', "a.total")} AS score FROM pr JOIN tc a ON a.lang = pr.lang AND a.type = pr.type JOIN tc z ON z.lang = pr.lang AND z.type = pr.next),
co AS MATERIALIZED (SELECT lang, type, next, "both", score FROM cs WHERE "both" > 1{share('"both"', "total_stops")} AND "both" * total > n * n_next AND score >= {S.COLLOCATION}::DOUBLE)"""


TOKENS, WHOLE = tokens_sql(True), tokens_sql(False)


def abbreviations(spark, sf):
    """Types that nearly always carry a stop, with their scores."""
    counts = S.type_counts(S.type_rows(docs(spark, sf)))
    return S.abbreviations(counts).select("lang", "type", "n", "stops", F.round("score", 4).alias("score"))


def sentence_starters(spark, sf):
    """Types that begin sentences, and pairs that go on across a stop (next is null for starters)."""
    rows = stash(S.type_rows(docs(spark, sf)), "types")
    counts = stash(S.type_counts(rows), "counts")
    short = S.abbreviations(counts)
    begin = S.starters(rows, counts, short).select("lang", "type", F.lit(None).cast("string").alias("next"), F.col("after").alias("n"), F.round("score", 3).alias("score"))
    return begin.union(S.collocations(rows, counts, short).select("lang", "type", "next", "both", F.round("score", 3).alias("score")))


def learned_sentence_counts(spark, sf):
    """Sentences of each document by the whole model learned from all documents."""
    return S.sentence_counts(docs(spark, sf))


COUNTED = rf"""WITH {WHOLE},
e AS (SELECT tr.*, ab.type IS NOT NULL OR regexp_matches(tr.type, '^\p{{L}}$') AS short, st.type IS NOT NULL AS starter, co.type IS NOT NULL AS pair
  FROM tr LEFT JOIN ab ON ab.lang = tr.lang AND ab.type = tr.type LEFT JOIN st ON st.lang = tr.lang AND st.type = tr.next LEFT JOIN co ON co.lang = tr.lang AND co.type = tr.type AND co.next = tr.next),
k AS (SELECT doc_id, next IS NULL OR CASE WHEN stop THEN CASE WHEN short THEN regexp_matches(next_bare, '^\p{{Lu}}') AND starter AND NOT pair WHEN type = '#' THEN NOT pair AND NOT regexp_matches(next_bare, '^\p{{Ll}}') ELSE true END ELSE regexp_matches(bare, '[.!?…]$') END AS done FROM e)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences FROM documents LEFT JOIN (SELECT doc_id, count(*) FILTER (done) AS n FROM k GROUP BY 1) USING (doc_id)"""

QUERIES = {
    "lemma_rules": (lemma_rules, f"WITH {MODEL} SELECT lang, suffix, n_words, n_stems FROM rl"),
    "function_words": (function_words, f"WITH {MODEL} SELECT lang, word, n FROM fw"),
    "content_lemmas": (content_lemmas, CONTENT),
    "word_drift": (word_drift, DRIFT),
    "save_decisions": (save_decisions, SAVED),
    "abbreviations": (abbreviations, f"WITH {TOKENS} SELECT lang, type, n, stops, round(score, 4) AS score FROM ab"),
    "sentence_starters": (sentence_starters, f"WITH {TOKENS} SELECT lang, type, NULL::VARCHAR AS next, after AS n, round(score, 3) AS score FROM st UNION ALL SELECT lang, type, next, \"both\", round(score, 3) FROM co"),
    "learned_sentence_counts": (learned_sentence_counts, COUNTED),
}
