"""Problems of extracted text, titles, payload classes, and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import text as X, vocabulary as V

SHORT, GARBAGE_SHARE, NARROW, BLOCK = 100, 0.05, 40, 100
BLOCKING = ("UNUSABLE", "TOOSHORT", "GARBLED")
GARBAGE = "[^�█░▒▓\\x00]"


def repeated_blocks(c: Column, size: int = BLOCK) -> Column:
    """Some `size`-character block, of those at multiples of size before the last, occurs twice."""
    n = F.length(c)
    # Cut by a pattern, in one pass: substring() would count characters from the start for each.
    starts = F.floor((F.greatest(F.lit(1), n - size) - 1) / size).cast("int") + 1
    cut = F.slice(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), 1, starts)
    repeats = X.let(F.transform(cut, lambda b: F.trim(F.regexp_replace(b, X.BLANK, " "))), lambda b: F.size(F.array_distinct(b)) < F.size(b))
    return F.when(n > size, repeats).otherwise(False)


def mean_line(c: Column) -> Column:
    """Mean length of lines that are not blank and no markup; null if there are none."""
    lines = F.filter(F.split(c, "\n"), lambda s: ~F.trim(s).rlike(r"^([#\-*|>]|$)"))
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, s: a + F.length(s)) / F.when(F.size(lines) > 0, F.size(lines))


def extraction_problems(c: Column, delimiter: str = "\n\n") -> Column:
    """Problem codes: too short or garbled texts are unusable and not looked at any further."""
    c = F.coalesce(c, F.lit(""))
    return X.let(X.count_words(c), lambda n: _problems(c, n, delimiter))


def _problems(c: Column, n_words: Column, delimiter: str) -> Column:
    garbage = F.length(F.regexp_replace(c, GARBAGE, ""))
    paragraphs = F.filter(F.split(c, delimiter), lambda p: F.trim(p) != "")
    warnings = F.array_compact(F.array(
        F.when(mean_line(c) < NARROW, "COLUMNJUMBLE"),
        F.when((F.size(paragraphs) < 3) & (n_words > 500), "NOPARAGRAPHS"),
        F.when(repeated_blocks(c), "REPEATEDTEXT"),
        F.when((n_words > 2000) & ~X.contains_any(F.lower(c), V.REFERENCE_MARKERS), "NOREFSSECTION"),
    ))
    short = F.array(F.lit("UNUSABLE"), F.lit("TOOSHORT"))
    garbled = F.array(F.lit("UNUSABLE"), F.lit("GARBLED"))
    return F.when(n_words < SHORT, short).when(garbage > F.length(c) * GARBAGE_SHARE, garbled).otherwise(warnings)


def usable(problems: Column) -> Column:
    return ~F.array_contains(problems, "UNUSABLE")


def warnings_only(problems: Column) -> Column:
    return F.array_except(problems, F.array(*map(F.lit, BLOCKING)))


def title_of(c: Column) -> Column:
    """First of ten lines that is neither short, metadata, nor all upper case."""
    lines = F.slice(F.filter(F.transform(F.split(c, "\n"), lambda s: F.trim(s)), lambda s: s != ""), 1, 10)
    good = F.filter(lines, lambda s: (F.length(s) > 10) & (F.length(s) < 200) & ~X.contains_any(F.lower(s), V.METADATA_MARKERS) & ~X.is_upper(s))
    return F.get(good, F.lit(0))


def classify_payload(content: Column, content_type: Column, status: Column) -> Column:
    """What a fetched payload is: ok, or an error code."""
    head = F.decode(F.substring(content, 1, 1000), "ISO-8859-1")
    body = F.lower(F.decode(content, "ISO-8859-1"))
    pdf = F.startswith(head, F.lit("%PDF")) | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))
    return (
        F.when(status == 404, "NOT_FOUND").when(status.isin(401, 403), "PAYWALL").when(status >= 400, "FETCH_FAILED")
        .when(pdf, "ok")
        .when(F.contains(F.lower(head), F.lit("<html")) & X.contains_any(body, V.PAYWALL_PHRASES), "PAYWALL")
        .otherwise("NOT_PDF")
    )


def cache_extension(url: Column, content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 1000), "ISO-8859-1")
    return F.when(F.lower(url).rlike(r"\.pdf($|\?)") | F.startswith(head, F.lit("%PDF")), ".pdf").when(F.contains(F.lower(head), F.lit("<html")), ".html").otherwise(".txt")


def split_long(paragraph: Column, most: int = 400) -> Column:
    """Sentences gathered to at most `most` words a part (a longer sentence is a part)."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("open"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        n = X.count_words(s)
        flush = (acc.n > 0) & (acc.n + n > most)
        return F.struct(
            F.when(flush, F.concat(acc.parts, F.array(acc.open))).otherwise(acc.parts).alias("parts"),
            F.when(flush | (acc.n == 0), s).otherwise(F.concat_ws(" ", acc.open, s)).alias("open"),
            F.when(flush, n).otherwise(acc.n + n).alias("n"),
        )

    return F.aggregate(X.sentences(paragraph), start, step, lambda acc: F.when(acc.n > 0, F.concat(acc.parts, F.array(acc.open))).otherwise(acc.parts))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = 4, delimiter: str = "\n\n", longest: int = 500, most: int = 400, split: bool = True) -> DataFrame:
    """(key, chunk_no from 1, chunk, n_paragraphs): runs of `target` paragraphs, those of more than
    `longest` words being split at sentences first. Without split, they stay whole."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), delimiter), lambda s: F.trim(s)), lambda p: p != "")
    if split:
        paragraphs = F.flatten(F.transform(paragraphs, lambda p: F.when(X.count_words(p) > longest, split_long(p, most)).otherwise(F.array(p))))
    numbered = docs.select(key, paragraphs.alias("p")).where(F.size("p") > 0)
    starts = F.sequence(F.lit(1), F.size("p"), F.lit(target))
    runs = numbered.select(key, F.posexplode(F.transform(starts, lambda i: F.slice("p", i, F.lit(target)))).alias("at", "run"))
    return runs.select(key, (F.col("at") + 1).alias("chunk_no"), F.array_join("run", delimiter).alias("chunk"), F.size("run").cast("long").alias("n_paragraphs"))


def deliver_chunk(chunked: DataFrame, doc, number: int) -> DataFrame:
    """One chunk by number from 1 (smaller ones mean the first); no row once all are delivered."""
    return chunked.where((F.col("doc_id") == doc) & (F.col("chunk_no") == max(1, number)))


def deliver(docs: DataFrame, chunked: DataFrame, doc, number: int, key: str = "doc_id") -> DataFrame:
    """The answer for a chunk by number from 1 (smaller ones mean the first): one row (key, error,
    chunk_no, chunk, total_chunks, complete, extraction_method, extraction_problems, next_step). Beyond
    the last one it is complete, without a chunk but with how the text was extracted; a document that
    isn't there, or whose problems make its text unusable, is an error. docs has the columns
    extraction_method and extraction_problems where they are known."""
    there = lambda c, kind: F.col(c) if c in docs.columns else F.lit(None).cast(kind)
    method, problems = there("extraction_method", "string"), F.coalesce(there("extraction_problems", "array<string>"), F.array().cast("array<string>"))
    own = docs.where(F.col(key) == doc).select(F.col(key), method.alias("extraction_method"), problems.alias("extraction_problems"))
    told = chunked.where(F.col(key) == doc).agg(F.count("*").alias("total_chunks"), F.max(F.when(F.col("chunk_no") == max(1, number), F.col("chunk"))).alias("chunk"))
    asked = docs.sparkSession.range(1).select(F.lit(doc).cast(docs.schema[key].dataType).alias(key))
    row = asked.join(own, key, "left").join(told, F.lit(True))  # one row each
    known, blocked = F.col("extraction_problems").isNotNull(), ~usable(F.col("extraction_problems"))
    error = F.when(~known, "ARTICLE_NOT_FOUND").when(blocked, "EXTRACTION_FAILED")
    done = error.isNull() & F.col("chunk").isNull()
    step = F.when(error == "ARTICLE_NOT_FOUND", "get_next_article").when(error.isNotNull(), "skip_article").when(done, "validate_classification").otherwise("get_chunk")
    return row.select(key, error.alias("error"), F.when(error.isNull() & ~done, max(1, number)).cast("long").alias("chunk_no"), F.when(error.isNull(), F.col("chunk")).alias("chunk"), "total_chunks", done.alias("complete"), "extraction_method", "extraction_problems", step.alias("next_step"))
