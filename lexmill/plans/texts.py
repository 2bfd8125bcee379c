"""Registered queries over texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions import html as H, text as X, vocabulary as V
from lexmill.operators import blocks as B, classify as C, extraction as E, glossary as G, quality as Q, relational as R
from lexmill.session import table

# Parts of SQL.
BLANKS = r"'[ \t\n\r\f\v]+'"
WORDS = f"len(list_filter(string_split_regex(coalesce({{c}}, ''), {BLANKS}), lambda x: x <> ''))::BIGINT"
NUMBER = r"'(?:^|[^\p{L}\p{N}_])(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?:%|mg|kg|cm|mm|ml|l|g)?)'"
NUMBERS = "list_sort(list_distinct(regexp_extract_all(coalesce({c}, ''), " + NUMBER + ", 1)))"
NEXT = "SELECT doc_id, source, text AS s, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS t FROM documents"
LINES = """SELECT doc_id, pos, line FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"""


def words_sql(c: str) -> str:
    return WORDS.replace("{c}", c)


def numbers_sql(c: str) -> str:
    return NUMBERS.replace("{c}", c)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent documents of a source, by features: texts themselves don't meet."""
    f = docs(spark, sf).select("doc_id", "source", X.count_words(F.col("text")).alias("words"), X.numbers(F.col("text")).alias("numbers"))
    return R.with_next(f, "source", "doc_id", ["words", "numbers"]).where("next is not null")


def pair_quality_flags(spark, sf):
    p = pairs(spark, sf)
    lost = Q.numbers_missing(F.col("numbers"), F.col("next.numbers"))
    flags = F.array_compact(F.array(Q.word_flag(F.col("words"), F.col("next.words")), F.when(F.size(lost) > 0, "STATMIS")))
    return p.select("source", F.coalesce(X.blank_to_null(F.array_join(flags, "|")), F.lit("ok")).alias("flags")).groupBy("source", "flags").agg(F.count("*").alias("n"))


PAIR_QUALITY_FLAGS = f"""
WITH p AS ({NEXT}), f AS (SELECT source, {words_sql('t')}::DOUBLE / greatest({words_sql('s')}, 1) AS r,
  len(list_filter({numbers_sql('s')}, lambda x: NOT list_contains({numbers_sql('t')}, x))) AS lost FROM p WHERE t IS NOT NULL)
SELECT source, CASE WHEN (r < 0.9 OR r > 1.5) AND lost > 0 THEN 'WORDMIS|STATMIS' WHEN r < 0.9 OR r > 1.5 THEN 'WORDMIS'
  WHEN lost > 0 THEN 'STATMIS' ELSE 'ok' END AS flags, count(*) AS n FROM f GROUP BY 1, 2"""


def pair_number_preservation(spark, sf):
    p = pairs(spark, sf)
    a, b = F.col("numbers"), F.col("next.numbers")
    lost, added = Q.numbers_missing(a, b), Q.numbers_missing(b, a)
    return p.select("doc_id", F.array_join(lost, "|").alias("missing"), F.array_join(added, "|").alias("added"), F.when(F.size(lost) > 0, "STATMIS").alias("flag")).where("missing <> '' or added <> ''")


PAIR_NUMBERS = f"""
WITH p AS ({NEXT}), n AS (SELECT doc_id, {numbers_sql('s')} AS a, {numbers_sql('t')} AS b FROM p WHERE t IS NOT NULL),
d AS (SELECT doc_id, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), '|') AS missing,
  array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), '|') AS added FROM n)
SELECT doc_id, missing, added, CASE WHEN missing <> '' THEN 'STATMIS' END AS flag FROM d WHERE missing <> '' OR added <> ''"""


def turn_pair_word_ratio(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", X.count_words(F.col("text")).alias("words"))
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("t_words"))
    p = c.where("role = 'user'").join(answers, ["conv_id", "turn"])
    r = Q.ratio(F.col("t_words"), F.col("words"))
    return p.select("conv_id", "turn", F.round(r, 6).alias("ratio"), Q.word_flag(F.col("words"), F.col("t_words")).alias("flag"))


TURN_RATIO = f"""
WITH u AS (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, {words_sql('text')} AS w FROM conversations WHERE role = 'assistant'),
r AS (SELECT u.conv_id, u.turn, a.w::DOUBLE / greatest(u.w, 1) AS r FROM u JOIN a USING (conv_id, turn))
SELECT conv_id, turn, round(r, 6) AS ratio, CASE WHEN r < 0.9 OR r > 1.5 THEN 'WORDMIS' END AS flag FROM r"""


def doc_word_counts(spark, sf):
    return docs(spark, sf).select("doc_id", X.count_words(F.col("text")).alias("n_words"))


def doc_number_sets(spark, sf):
    n = X.numbers(F.col("text"))
    return docs(spark, sf).select("doc_id", F.array_join(n, "|").alias("numbers"), F.size(n).cast("long").alias("n")).where("n > 0")


def doc_extraction_problems(delimiter: str):
    return lambda spark, sf: docs(spark, sf).select("doc_id", F.array_join(E.extraction_problems(F.col("text"), delimiter), "|").alias("problems"))


def problems_sql(delimiter: str) -> str:
    return f"""
WITH w AS (SELECT doc_id, text, {words_sql('text')} AS n,
  list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches(trim(s), '^([#\\-*|>]|$)')) AS ls,
  len(list_filter(string_split(text, {delimiter}), lambda p: trim(p) <> '')) AS ps,
  list_transform(range(1, greatest(length(text) - 99, 2), 100), lambda i: trim(regexp_replace(substr(text, i, 100), {BLANKS}, ' ', 'g'))) AS bs FROM documents),
m AS (SELECT *, list_sum(list_transform(ls, lambda s: length(s)))::DOUBLE / nullif(len(ls), 0) AS mean FROM w)
SELECT doc_id, CASE WHEN n < 100 THEN 'UNUSABLE|TOOSHORT' ELSE array_to_string(list_filter([
  CASE WHEN mean < 40 THEN 'COLUMNJUMBLE' END, CASE WHEN ps < 3 AND n > 500 THEN 'NOPARAGRAPHS' END,
  CASE WHEN length(text) > 100 AND len(list_distinct(bs)) < len(bs) THEN 'REPEATEDTEXT' END,
  CASE WHEN n > 2000 AND NOT regexp_matches(lower(text), 'references|bibliography|works cited|références|bibliographie') THEN 'NOREFSSECTION' END],
  lambda x: x IS NOT NULL), '|') END AS problems FROM m"""


def doc_repeated_blocks(spark, sf):
    return docs(spark, sf).where(E.repeated_blocks(F.col("text"))).select("doc_id")


REPEATED = f"""
WITH b AS (SELECT doc_id, text, list_transform(range(1, greatest(length(text) - 99, 2), 100), lambda i: trim(regexp_replace(substr(text, i, 100), {BLANKS}, ' ', 'g'))) AS bs FROM documents)
SELECT doc_id FROM b WHERE length(text) > 100 AND len(list_distinct(bs)) < len(bs)"""


def doc_chunks(spark, sf):
    c = E.chunks(docs(spark, sf), delimiter="\n", split=False)
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "n_paragraphs", X.count_words(F.col("chunk")).alias("n_words"), F.md5("chunk").alias("digest"))


CHUNKS = f"""
WITH l AS ({LINES}), p AS (SELECT doc_id, trim(line) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM l WHERE trim(line) <> ''),
c AS (SELECT doc_id, i // 4 + 1 AS chunk_no, string_agg(p, chr(10) ORDER BY i) AS chunk, count(*) AS n_paragraphs FROM p GROUP BY 1, 2)
SELECT doc_id, chunk_no::BIGINT AS chunk_no, n_paragraphs, {words_sql('chunk')} AS n_words, md5(chunk) AS digest FROM c"""


def doc_chunks_split(spark, sf):
    return E.chunks(docs(spark, sf), delimiter="\n").select("doc_id", "chunk_no", "n_paragraphs", X.count_words(F.col("chunk")).alias("n_words"))


def doc_lines(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def doc_incomplete_lines(spark, sf):
    return doc_lines(spark, sf).where(X.is_incomplete(F.col("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"))


def doc_orphan_lines(spark, sf):
    return doc_lines(spark, sf).where(X.starts_lower(F.col("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"))


ORPHANS = rf"""SELECT doc_id, pos FROM ({LINES}) WHERE regexp_matches(trim(line, ' '), '^[''"‘’“”]*\p{{Ll}}')"""


def doc_line_issues(spark, sf):
    lines = doc_lines(spark, sf).select("doc_id", "pos", F.lit("p").alias("tag"), F.trim("line").alias("text"))
    each = B.review(lines).select("doc_id", "pos", F.explode("issues").alias("issue"))
    return each.groupBy("doc_id", "issue").agg(F.count("*").alias("n"))


LINE_ISSUES = rf"""
WITH l AS (SELECT doc_id, trim(line) AS t FROM ({LINES})),
i AS (SELECT doc_id, unnest([CASE WHEN regexp_matches(t, '^\p{{Ll}}') AND length(t) > 20 THEN 'ORPHAN' END,
  CASE WHEN length(t) > 50 AND right(t, 1) NOT IN ('.', '!', '?', ':', ';', ')') THEN 'INCOMPLETE' END,
  CASE WHEN regexp_matches(t, '(?i)^(Figure|Fig\.?|Table|Tableau)\s*\d') THEN 'CAPTION' END,
  CASE WHEN regexp_matches(t, '^\d+$') OR (length(t) < 10 AND regexp_matches(t, '(?i)^Page\s*\d+')) THEN 'PAGE_ARTIFACT' END,
  CASE WHEN length(t) < 25 AND NOT t LIKE '%:' THEN 'SHORT_FRAGMENT' END,
  CASE WHEN regexp_matches(t, '^\d+\.\s*[A-Z]') AND contains(lower(t), 'et al') THEN 'REFERENCE_LEAK' END]) AS issue FROM l WHERE t <> '')
SELECT doc_id, issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY 1, 2"""


def doc_slug(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.slugify(F.col("text"))).alias("slug"), F.md5(X.file_slug(F.col("text"))).alias("file_slug"))


SLUG = """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-')) AS slug,
  md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')) AS file_slug FROM documents"""


def doc_truncated_preview(spark, sf):
    return docs(spark, sf).select("doc_id", X.truncate(F.col("text"), 200).alias("preview"))


def doc_key_findings(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(X.key_findings(F.col("text")), "|").alias("findings"))


FINDINGS = """
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: trim(s, ' ')), lambda s: s <> '') AS p FROM documents)
SELECT doc_id, CASE WHEN len(p) >= 3 THEN p[1] || '|' || p[2] WHEN len(p) = 2 THEN p[1] ELSE '' END AS findings FROM p"""


def doc_summary(spark, sf):
    return docs(spark, sf).select("doc_id", X.summary(F.col("text"), 150, "\n").alias("summary"))


#: Paragraphs with ten words and more, no marker at their start and not all upper case, as long as those before have less than 225 words.
SUMMARY = rf"""
WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS ps FROM documents WHERE length(trim(text, ' ')) >= 100),
g AS (SELECT *, list_filter(ps, lambda x: {words_sql('x')} >= 10 AND NOT ({' OR '.join(f"contains(left(lower(x), 50), '{m}')" for m in V.SUMMARY_MARKERS)}) AND NOT (regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) AS good FROM p),
w AS (SELECT *, list_transform(good, lambda x: {words_sql('x')}) AS ws FROM g),
k AS (SELECT *, CASE WHEN len(good) > 0 THEN list_filter(good, lambda x, i: coalesce(list_sum(ws[1:i - 1]), 0) < 225) ELSE ps[1:3] END AS kept FROM w),
c AS (SELECT doc_id, array_to_string(kept, ' ') AS c, list_filter(string_split_regex(array_to_string(kept, ' '), {BLANKS}), lambda x: x <> '') AS cw FROM k),
t AS (SELECT doc_id, c, len(cw) AS n, array_to_string(cw[1:150], ' ') AS cut FROM c), s AS (SELECT *, length(cut) - strpos(reverse(cut), '.') + 1 AS stop FROM t)
SELECT d.doc_id, CASE WHEN n > 150 THEN CASE WHEN contains(cut, '.') AND stop - 1 > 0.6 * length(cut) THEN left(cut, stop) ELSE cut END ELSE c END AS summary FROM documents d LEFT JOIN s USING (doc_id)"""


def doc_sentence_counts(spark, sf):
    return docs(spark, sf).select("doc_id", X.count_sentences(F.col("text")).alias("n_sentences"))


SENTENCES = rf"""
WITH a AS (SELECT doc_id, regexp_replace(trim(coalesce(text, ''), ' '), '(^|[^\p{{L}}\p{{N}}])({'|'.join(V.ABBREVIATIONS)})\.', '\1\2' || chr(2), 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '(^|[^\p{{L}}\p{{N}}])(\p{{Lu}})\.(\s+\p{{Ll}})', '\1\2' || chr(2) || '\3', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '([.!?…]+["''”’»)\]]*)(?:\s+|$)', '\1' || chr(1), 'g') AS t FROM b)
SELECT doc_id, len(list_filter(string_split(t, chr(1)), lambda s: trim(s, ' ') <> '')) AS n_sentences FROM c"""


def doc_facts(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", X.year_of(t).alias("year"), X.email_of(t).alias("email"), X.doi_of(t).alias("doi"), X.is_cruft(t).alias("cruft")).where("year is not null or email is not null or doi is not null or cruft")


FACTS = rf"""
WITH f AS (SELECT doc_id, nullif(regexp_extract(text, '(?:^|[^\p{{L}}\p{{N}}_])((?:19|20)\d{{2}})(?:$|[^\p{{L}}\p{{N}}_])', 1), '') AS year,
  nullif(regexp_extract(text, '[\w.-]+@[\w.-]+\.\w+', 0), '') AS email,
  nullif(rtrim(regexp_extract(text, '10\.\d{{4,}}/[^\s,<>"]+', 0), '.,;:)"'''), '') AS doi,
  regexp_matches(trim(lower(text)), '{'|'.join(f'(?:{p})' for p in V.CRUFT)}') OR (length(text) < 30 AND text LIKE '%:' AND NOT regexp_matches(text, '^\d')) AS cruft FROM documents)
SELECT * FROM f WHERE year IS NOT NULL OR email IS NOT NULL OR doi IS NOT NULL OR cruft"""

TERMS = (("the", "le"), ("and", "et"), ("for", "pour"), ("that", "que"), ("with", "avec"), ("is and", "est et"), ("of the", "du"), ("la-de", "la-de"), ("was the", "était le"))


def terms(spark: SparkSession) -> DataFrame:
    rows = [(i, en, fr, None, None, None) for i, (en, fr) in enumerate(TERMS)]
    return spark.createDataFrame(rows, "ord int, en string, fr string, fr_alt array<string>, abbreviation string, note string")


def term_hits(spark, sf):
    return G.find_terms(docs(spark, sf), G.index(terms(spark)))


def term_hits_by_runs(spark, sf):
    """The same for a glossary too large for one automaton."""
    return G.find_terms(docs(spark, sf), G.index(terms(spark)), most_bytes=0)


def learned_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A glossary drawn from the data: words and pairs of words of the benchmark's texts."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    own = table(spark, sf, "benchmark").select("item_id", words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 1)), lambda i: F.array_join(F.slice("w", i, 2), " "))
    en = own.select("item_id", F.explode(F.array_distinct(F.concat("w", pairs))).alias("en")).where("length(en) >= 8")
    return en.groupBy("en").agg(F.min("item_id").cast("int").alias("ord")).select("ord", "en", F.reverse("en").alias("fr"), F.lit(None).cast("array<string>").alias("fr_alt"), F.lit(None).cast("string").alias("abbreviation"), F.lit(None).cast("string").alias("note"))


def learned_term_hits(spark, sf):
    """How many words and pairs of words of the benchmark each document has, by an automaton of all."""
    found = G.find_terms(docs(spark, sf), G.index(learned_terms(spark, sf)))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum(F.length("en")).alias("characters"))


LEARNED_HITS = rf"""
WITH w AS (SELECT list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS en FROM w),
t AS (SELECT doc_id, {{NORMAL}} AS n FROM documents),
k AS (SELECT doc_id, string_split_regex(n, '[^\p{{L}}\p{{N}}_]+') AS w, n FROM t),
one AS (SELECT DISTINCT doc_id, unnest(w) AS en FROM k),
p AS (SELECT doc_id, regexp_extract_all(n, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS s FROM t),
b AS (SELECT DISTINCT doc_id, unnest(list_transform(list_filter(range(1, len(s) - 1), lambda i: s[i + 1] IN (' ', '-')), lambda i: s[i] || ' ' || s[i + 2])) AS en FROM p),
h AS (SELECT doc_id, en FROM one JOIN g USING (en) WHERE length(en) >= 8 UNION SELECT doc_id, en FROM b JOIN g USING (en) WHERE length(en) >= 8)
SELECT doc_id, count(*) AS n_terms, sum(length(en))::BIGINT AS characters FROM h GROUP BY 1"""


def term_missing(spark, sf):
    """Terms of each document that the next document of its source lacks in the target language."""
    d = docs(spark, sf)
    found = G.find_terms(d, G.index(terms(spark)))
    after = R.with_next(d.select("doc_id", "source"), "source", "doc_id", ["doc_id"]).where("next is not null").select("doc_id", F.col("next.doc_id").alias("target"))
    targets = after.join(d.select(F.col("doc_id").alias("target"), "text"), "target").select("doc_id", "text")
    return G.missing_terms(found.join(after.select("doc_id"), "doc_id"), targets, terms(spark))


_KEYS = [(k, en, fr) for en, fr in TERMS for k in dict.fromkeys([en, en.replace(" ", "-") if " " in en else en.replace("-", " ")])]
TERM_VALUES = ", ".join(f"('{k}', '{en}', '{fr}')" for k, en, fr in _KEYS)
NORMAL = f"trim(regexp_replace(lower({{c}}), {BLANKS}, ' ', 'g'))"
TERM_HITS = f"""
WITH g(k, en, fr) AS (VALUES {TERM_VALUES}), t AS (SELECT doc_id, {NORMAL.format(c='text')} AS n FROM documents)
SELECT DISTINCT doc_id, en, fr FROM t, g WHERE regexp_matches(n, '(^|[^\\p{{L}}\\p{{N}}_])' || k || '($|[^\\p{{L}}\\p{{N}}_])')"""
TERM_MISSING = f"""
WITH h AS ({TERM_HITS}), p AS ({NEXT}), t AS (SELECT doc_id, {NORMAL.format(c='t')} AS n FROM p WHERE t IS NOT NULL)
SELECT doc_id, en || ' -> ' || fr AS missing FROM h JOIN t USING (doc_id) WHERE NOT contains(n, fr)"""


def doc_languages_accepted(spark, sf):
    """Preferred languages of made-up headers, one per source."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    header = F.when(n % 3 == 0, "de, en;q=0.7, fr;q=0.3").when(n % 3 == 1, "fr-CA,fr;q=0.8,en;q=0.9").otherwise("es")
    return docs(spark, sf).select("source", header.alias("header")).distinct().select("source", X.accepted_language(F.col("header")).alias("lang"))


ACCEPTED = """SELECT DISTINCT source, CASE regexp_extract(source, '(\\d+)$', 1)::INT % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'fr' END AS lang FROM documents"""


def doc_body_fixes(spark, sf):
    """Line fixes: lines that go on join the line before, lines of one word go."""
    lines = doc_lines(spark, sf).select("doc_id", "pos", F.lit("p").alias("tag"), F.trim("line").alias("text")).where("text <> ''")
    fixes = lines.select("doc_id", "pos", F.when(X.starts_lower(F.col("text")), "join_previous").when(X.count_words(F.col("text")) == 1, "delete").alias("action"), F.lit(None).cast("string").alias("text")).where("action is not null")
    return B.apply_fixes(lines, fixes).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


BODY_FIXES = rf"""
WITH l AS (SELECT doc_id, pos, trim(line) AS t FROM ({LINES}) WHERE trim(line) <> ''),
a AS (SELECT *, CASE WHEN regexp_matches(t, '^[''"‘’“”]*\p{{Ll}}') THEN 'join' WHEN {words_sql('t')} = 1 THEN 'delete' END AS act,
  row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM l),
i AS (SELECT *, count(*) FILTER (NOT (act IS NOT DISTINCT FROM 'join' AND rn > 1)) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM a),
j AS (SELECT doc_id, island, string_agg(t, ' ' ORDER BY pos) AS t FROM i WHERE act IS DISTINCT FROM 'delete' GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_lines, sum(length(t))::BIGINT AS n_chars FROM j GROUP BY 1"""


def doc_payloads(spark, sf):
    t = F.col("text")
    content = F.encode(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("%PDF"), t)).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("<html>Please subscribe"), t)).otherwise(t), "UTF-8")
    status = F.when(F.col("doc_id") % 11 == 0, 404).when(F.col("doc_id") % 11 == 1, 403).otherwise(200)
    return docs(spark, sf).select("doc_id", E.classify_payload(content, F.lit("text/html"), status).alias("outcome"))


PAYLOADS = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'NOT_FOUND' WHEN doc_id % 11 = 1 THEN 'PAYWALL' WHEN doc_id % 7 = 0 THEN 'ok' WHEN doc_id % 7 = 1 THEN 'PAYWALL' ELSE 'NOT_PDF' END AS outcome FROM documents"""


def validate_rows(spark, sf):
    """Classifications made from documents: right and wrong ones of each kind."""
    d = docs(spark, sf)
    i = F.col("doc_id")
    pickm = F.element_at(F.array(*map(F.lit, [*V.METHODS, "empiric"])), (i % 5 + 1).cast("int"))
    voice = F.element_at(F.array(*map(F.lit, [*V.VOICES, "nobody"])), (i % 5 + 1).cast("int"))
    second = F.when(i % 3 == 0, F.array(F.lit("support"), F.lit("support"))).when(i % 3 == 1, F.array(F.lit("education"))).otherwise(F.array().cast("array<string>"))
    rows = d.select(i.alias("article_id"), pickm.alias("method"), voice.alias("voice"), F.when(i % 4 == 0, "").otherwise("education").alias("primary_category"), second.alias("secondary_categories"), F.transform(F.sequence(F.lit(1), (i % 17 + 1).cast("int")), lambda k: F.concat(F.lit("k"), k.cast("string"))).alias("keywords"))
    return C.validate(rows).select("article_id", "valid", F.size("errors").cast("long").alias("n_errors"))


VALIDATE = """
WITH r AS (SELECT doc_id AS i FROM documents), e AS (SELECT i, (i % 5 = 4)::INT + (i % 5 = 4)::INT + (i % 4 = 0)::INT
  + (i % 3 = 0)::INT + (i % 3 = 1 AND i % 4 <> 0)::INT + (i % 17 + 1 < 5 OR i % 17 + 1 > 15)::INT AS n FROM r)
SELECT i AS article_id, n = 0 AS valid, n::BIGINT AS n_errors FROM e"""

QUERIES = {
    "pair_quality_flags": (pair_quality_flags, PAIR_QUALITY_FLAGS),
    "pair_number_preservation": (pair_number_preservation, PAIR_NUMBERS),
    "turn_pair_word_ratio": (turn_pair_word_ratio, TURN_RATIO),
    "doc_word_counts": (doc_word_counts, f"SELECT doc_id, {words_sql('text')} AS n_words FROM documents"),
    "doc_number_sets": (doc_number_sets, f"SELECT doc_id, array_to_string(n, '|') AS numbers, len(n) AS n FROM (SELECT doc_id, {numbers_sql('text')} AS n FROM documents) WHERE len(n) > 0"),
    "doc_sentence_counts": (doc_sentence_counts, SENTENCES),
    "doc_extraction_problems": (doc_extraction_problems("\n\n"), problems_sql("chr(10) || chr(10)")),
    "doc_extraction_problems_by_line": (doc_extraction_problems("\n"), problems_sql("chr(10)")),
    "doc_repeated_blocks": (doc_repeated_blocks, REPEATED),
    "doc_chunks": (doc_chunks, CHUNKS),
    "doc_chunks_split": (doc_chunks_split, None),
    "doc_incomplete_lines": (doc_incomplete_lines, f"SELECT doc_id, pos FROM ({LINES}) WHERE trim(line, ' ') <> '' AND right(trim(line, ' '), 1) NOT IN ('.', '!', '?', ':', ';')"),
    "doc_orphan_lines": (doc_orphan_lines, ORPHANS),
    "doc_line_issues": (doc_line_issues, LINE_ISSUES),
    "doc_body_fixes": (doc_body_fixes, BODY_FIXES),
    "doc_slug": (doc_slug, SLUG),
    "doc_truncated_preview": (doc_truncated_preview, "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents"),
    "doc_key_findings": (doc_key_findings, FINDINGS),
    "doc_summary": (doc_summary, SUMMARY),
    "doc_facts": (doc_facts, FACTS),
    "doc_payloads": (doc_payloads, PAYLOADS),
    "languages_accepted": (doc_languages_accepted, ACCEPTED),
    "term_hits": (term_hits, TERM_HITS),
    "term_hits_by_runs": (term_hits_by_runs, TERM_HITS),
    "learned_term_hits": (learned_term_hits, LEARNED_HITS.replace("{NORMAL}", NORMAL.format(c="text"))),
    "term_missing": (term_missing, TERM_MISSING),
    "validate_rows": (validate_rows, VALIDATE),
}
