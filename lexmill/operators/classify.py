"""Classification checks and heuristics as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import text as X, vocabulary as V


def _unknown(value: Column, options, what: str) -> Column:
    return F.when(~F.coalesce(value.isin(*options), F.lit(False)), F.concat(F.lit(f"Invalid {what}: '"), F.coalesce(value, F.lit("None")), F.lit("'"), X.suggestion(F.coalesce(value, F.lit("None")), options)))


def classification_errors(method: Column, voice: Column, primary: Column, secondary: Column, keywords: Column, categories=V.CATEGORIES) -> Column:
    """All errors of a classification, in order; none means valid."""
    second = F.coalesce(secondary, F.array().cast("array<string>"))
    n = F.coalesce(F.size(keywords), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    text = lambda c: c.cast("string")
    head = F.array(
        _unknown(method, V.METHODS, "method"),
        _unknown(voice, V.VOICES, "voice"),
        F.when(F.coalesce(primary, F.lit("")) == "", F.lit("primary_category is required.")).otherwise(_unknown(primary, categories, "primary_category")),
        F.when(F.size(second) > 2, F.concat(F.lit("Too many secondary_categories: "), text(F.size(second)), F.lit(" provided, max 2 allowed."))),
    )
    each = F.transform(second, lambda c: _unknown(c, categories, "secondary_category"))
    tail = F.array(
        F.when(F.array_contains(second, primary), F.concat(F.lit("Duplicate category: '"), primary, F.lit("' appears in both primary and secondary."))),
        F.when(F.size(F.array_distinct(second)) < F.size(second), F.lit("Duplicate categories in secondary_categories.")),
        F.when(n == 0, F.lit("keywords is required (5-15 items).")).when(n < 5, F.concat(F.lit("Too few keywords: "), text(n), F.lit(" provided, minimum 5 required."))).when(n > 15, F.concat(F.lit("Too many keywords: "), text(n), F.lit(" provided, maximum 15 allowed."))),
    )
    return F.array_compact(F.concat(head, each, tail))


def validate(rows: DataFrame, categories=V.CATEGORIES) -> DataFrame:
    """rows with errors, valid, and a token for valid ones."""
    errors = classification_errors(*[F.col(c) for c in ("method", "voice", "primary_category", "secondary_categories", "keywords")], categories=categories)
    out = rows.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    payload = F.to_json(F.struct("method", "voice", "primary_category", "secondary_categories", "keywords"))
    return out.withColumn("token", F.when(F.col("valid"), F.sha2(F.concat_ws("|", F.col("article_id").cast("string"), payload), 256)))


def flag_errors(flags: Column) -> Column:
    """Errors of an array of struct(code, detail)."""
    return F.array_compact(F.transform(flags, lambda f: F.when(f.code.isNull() | f.detail.isNull(), F.lit("flag needs code and detail")).when(~f.code.isin(*V.FLAG_CODES), F.concat(F.lit("unknown flag code: "), f.code))))


def is_checked() -> Column:
    """Whether quality checks apply: a full text of an open article with a source to compare."""
    return F.col("has_full_text") & F.col("open_access") & F.col("has_source")


def gate(rows: DataFrame) -> DataFrame:
    """rows(token_error, flags, exists, open_access, has_source, has_full_text, blocking_flags,
    warning_flags) with `decision` and `notes`: the token comes first, then flags, the article, and
    quality checks where there is a full text with a source to compare."""
    checked = is_checked()
    decision = (
        F.when(F.col("token_error").isNotNull(), F.col("token_error"))
        .when(F.size(flag_errors(F.col("flags"))) > 0, "INVALID_FLAGS")
        .when(~F.col("exists"), "ARTICLE_NOT_FOUND")
        .when(checked & (F.size("blocking_flags") > 0), "QUALITY_CHECK_FAILED")
        .otherwise("accepted")
    )
    own = F.transform(F.filter("flags", lambda f: F.coalesce(f.detail, F.lit("")) != ""), lambda f: F.concat(F.lit("["), f.code, F.lit("] "), f.detail))
    auto = F.when(checked & (F.size("warning_flags") > 0), F.array(F.concat(F.lit("[QUALITY] Auto-detected: "), F.array_join("warning_flags", ", "))))
    return rows.withColumn("decision", decision).withColumn("notes", F.array_join(F.concat(own, F.coalesce(auto, F.array().cast("array<string>"))), "; "))


def token_error(found: Column, matches: Column, used: Column, created: Column, now: Column, minutes: int = 30) -> Column:
    """Why a token is not valid, by precedence, or null."""
    return F.when(~found, "INVALID_TOKEN: not found").when(~matches, "INVALID_TOKEN: other article").when(used, "INVALID_TOKEN: used").when(created < now - F.expr(f"INTERVAL {minutes} MINUTES"), "INVALID_TOKEN: expired")


def review_errors(title: Column, authors: Column, year: Column, method: Column, voice: Column, abstract: Column, abstract_confirmed: Column) -> Column:
    """Errors of an article review."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.array_compact(F.array(
        F.when(empty(title), "title is required"), F.when(empty(authors), "authors is required"),
        F.when(~F.coalesce(year.rlike(r"^\d{4}$"), F.lit(False)), "year must have 4 digits"),
        _unknown(method, V.METHODS, "method"), _unknown(voice, V.VOICES, "voice"),
        F.when(empty(abstract) & ~F.coalesce(abstract_confirmed, F.lit(False)), "abstract is missing and not confirmed as absent"),
    ))


def method_of(article_type: Column, mapping=V.TYPE_METHODS) -> Column:
    """Method of an article type: the first pattern contained wins."""
    low = F.lower(article_type)
    chain = F.when(F.lit(False), F.lit(""))
    for method, patterns in mapping.items():
        chain = chain.when(X.contains_any(low, patterns), method)
    return chain


def peer_review_signals(citation: Column, doi: Column, references: Column, journals=V.JOURNAL_WORDS) -> Column:
    """Signals in favour of peer review; two or more mean yes, unless a registry says otherwise."""
    cited, refs = F.coalesce(citation, F.lit("")), F.coalesce(references, F.array().cast("array<string>"))
    ten = F.slice(refs, 1, 10)
    has_doi = F.coalesce(X.blank_to_null(doi), X.doi_of(cited, "citation")).isNotNull()
    return F.array_compact(F.array(
        F.when(has_doi, "doi found"), F.when(cited.rlike(V.JOURNAL_CITATION), "journal format in citation"),
        F.when(has_doi | F.contains(F.lower(cited), F.lit("doi")), "doi present"), F.when(F.size(refs) >= 10, "ten references"),
        F.when(F.size(F.filter(ten, lambda r: r.rlike(V.JOURNAL_REFERENCE))) >= 5, "references in journal format"),
        F.when(F.size(F.filter(ten, lambda r: X.contains_any(r, journals))) >= 5, "references name journals"),
    ))


def peer_reviewed(signals: Column, registry: Column | None = None) -> Column:
    """registry: a registry's answer where one is known (joined by the caller), which decides."""
    own = F.size(signals) >= 2
    return F.coalesce(registry, own) if registry is not None else own


def voice_of(abstract: Column, acknowledgements: Column, body: Column, terms=V.VOICE_TERMS, organizations: tuple[str, ...] = ()) -> Column:
    """The first voice with a term in the abstract, or in the acknowledgements (academic and
    organization) or the first 2000 characters of the body (practitioner and individual). organizations
    are names, in lower case, that a corpus adds to the terms of its voice."""
    terms = {**terms, "organization": (*organizations, *terms["organization"])}
    a, k = F.lower(F.coalesce(abstract, F.lit(""))), F.lower(F.coalesce(acknowledgements, F.lit("")))
    b = F.left(F.lower(F.coalesce(body, F.lit(""))), F.lit(2000))
    chain = F.when(F.lit(False), F.lit(""))
    for voice in V.VOICES:
        chain = chain.when(X.contains_any(a, terms[voice]) | X.contains_any(k if voice in ("academic", "organization") else b, terms[voice]), voice)
    return chain


def apply_suggestion(override: Column, current: Column, suggested: Column) -> Column:
    """Overrides always win; suggestions only fill what is null or empty."""
    return F.coalesce(override, X.blank_to_null(current), suggested)


def field_statuses(docs: DataFrame, key: str, fields=("title", "authors", "year", "citation", "abstract")) -> DataFrame:
    """(key, field, status): ok, missing or empty."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), X.field_status(F.col(f)).alias("status")) for f in fields])
    return docs.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def taxonomy(spark) -> dict[str, DataFrame]:
    """Dimensions: methods, voices, categories and flags(code, group, severity)."""
    one = lambda name, values: spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"ord int, {name} string")
    flags = [(code, group, group if group in ("blocking", "warning") else "unknown") for group, codes in V.FLAGS.items() for code in codes]
    return {"methods": one("method", V.METHODS), "voices": one("voice", V.VOICES), "categories": one("category", V.CATEGORIES), "flags": spark.createDataFrame(flags, "code string, flag_group string, severity string")}


def label(df: DataFrame, dim: DataFrame, code: str, text: str, fallback: str) -> DataFrame:
    """df with the dimension's label of `code`, the code itself where there is none."""
    return df.join(dim, code, "left").withColumn(text, F.coalesce(F.col(text), F.col(fallback)))


def label_rows(dim: DataFrame) -> DataFrame:
    """(code, label, definition, ord) of a dimension; codes without a label are their own."""
    return dim.select("code", F.coalesce("label", "code").alias("label"), "definition", "ord")
