"""Scalar text functions as native Columns. Nulls stay null unless a docstring says otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from lexmill.functions import vocabulary as V

BLANK = r"(?U)\s+"
NUMBER = r"\b\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?:%|mg|kg|cm|mm|ml|l|g)?"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def contains_any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles]) if needles else F.lit(False)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column) -> Column:
    """Blank-separated words, none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), BLANK), lambda x: x != "")


def count_words(c: Column) -> Column:
    """Number of words, from lengths: no word is made."""
    single = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANK, " "))
    return let(single, lambda s: F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)).cast("long")


def slugify(c: Column) -> Column:
    """Lower case, blanks and underscores to '-', other characters dropped (accents too)."""
    dashed = F.regexp_replace(F.lower(c), r"(?U)[\s_]+", "-")
    return F.btrim(F.regexp_replace(F.regexp_replace(dashed, r"[^a-z0-9-]", ""), r"-+", "-"), F.lit("-"))


def file_slug(c: Column) -> Column:
    """Variant for file names: every run of other characters becomes '-'."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))


def article_id(title: Column, authors: Column, year: Column) -> Column:
    """lastname-year-title: the last word of the first author that is no initial, 50 of the title."""
    author = F.element_at(F.split(F.coalesce(authors, F.lit("")), "[,&]"), 1)
    names = F.filter(words(author), lambda w: F.length(F.replace(w, F.lit("."), F.lit(""))) > 1)
    last = F.when(F.size(names) > 0, blank_to_null(slugify(F.element_at(names, -1))))
    name = F.when(F.coalesce(title, F.lit("")) == "", "untitled").otherwise(F.left(slugify(title), F.lit(50)))
    return F.concat_ws("-", last, blank_to_null(year), name)


# Words that count for nothing in an id.
SKIPPED_TITLE_WORDS = ("the", "a", "an", "of", "in", "on", "for", "and", "to", "with")


def ingest_id(title: Column, author: Column) -> Column:
    """surname-year-five words of the title; suffixes for collisions are numbered by the caller."""
    first = F.trim(F.element_at(F.split(F.coalesce(author, F.lit("")), "[,;]"), 1))
    surname = F.when(F.trim(F.coalesce(author, F.lit(""))) != "", blank_to_null(slugify(F.element_at(F.split(first, BLANK), -1))))
    significant = F.filter(F.split(slugify(F.coalesce(title, F.lit(""))), "-"), lambda w: (w != "") & ~w.isin(*SKIPPED_TITLE_WORDS))
    parts = F.concat_ws("-", surname, year_of(title), blank_to_null(F.array_join(F.slice(significant, 1, 5), "-")))
    return F.coalesce(blank_to_null(parts), F.lit("untitled-article"))


def normalize(c: Column) -> Column:
    """Lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), BLANK, " "))


def hyphen_variant(c: Column) -> Column:
    """Blanks to hyphens if there are any, else hyphens to blanks, else null."""
    return F.when(F.contains(c, F.lit(" ")), F.replace(c, F.lit(" "), F.lit("-"))).when(F.contains(c, F.lit("-")), F.replace(c, F.lit("-"), F.lit(" ")))


def numbers(c: Column) -> Column:
    """Distinct numbers as written, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0))))


def doi_of(c: Column, variant: str = "blocks") -> Column:
    """First DOI. Variants differ in what ends one: blocks (default), html, page, citation, link."""
    pattern, trailing = {
        "blocks": (r'10\.\d{4,}/[^\s,<>"]+', ".,;:)\"'"),
        "html": (r"10\.\d{4,}/[^\s,<>]+", ".,;:)\"'"),
        "page": (r"10\.\d{4,}/[^\s]+", "."),
        "citation": (r"10\.\d{4,}/[^\s]+", ".,;:"),
        "link": (r"doi\.org/(10\.\d+/[^\s]+)", ""),
    }[variant]
    found = first_match(c, pattern, 1 if variant == "link" else 0)
    return F.rtrim(found, F.lit(trailing)) if trailing else found


def year_of(c: Column) -> Column:
    return first_match(c, r"\b(19|20)\d{2}\b")


def email_of(c: Column) -> Column:
    return first_match(c, r"(?<![\w.-])[\w.-]+@[\w.-]+\.\w+")  # a run that fails is tried once


def heading_level(html: Column) -> Column:
    return F.lower(first_match(html, r"(?i)^<(h[1-6])", 1))


def starts_lower(c: Column) -> Column:
    """A sentence goes on: the first letter after any quotes is lower case."""
    return F.trim(F.coalesce(c, F.lit(""))).rlike("^['\"‘’“”]*\\p{Ll}")


def is_incomplete(c: Column) -> Column:
    """Not empty, and no sentence end as last character."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    return (bare != "") & ~F.right(bare, F.lit(1)).isin(*".!?:;")


def section_of(c: Column) -> Column:
    """Section of a heading: the first pattern contained wins; numbered headings are body."""
    bare = F.trim(F.lower(c))
    chain = F.when(F.lit(False), F.lit(""))
    for section, patterns in V.SECTIONS.items():
        chain = chain.when(contains_any(bare, patterns), section)
    return chain.when(contains_any(bare, V.BODY_SECTIONS), "body").when(c.rlike(r"^\d+\.?\s+\w"), "body")


def is_type_label(c: Column) -> Column:
    return F.trim(F.upper(c)).isin(*V.TYPE_LABELS)


def is_cruft(c: Column) -> Column:
    """Metadata that does not belong into a body."""
    bare = F.trim(F.lower(c))
    label = (F.length(c) < 30) & F.endswith(c, F.lit(":")) & ~c.rlike(r"^\d")
    opening = "|".join(p[1:] for p in V.CRUFT if p.startswith("^"))
    return reduce(lambda a, b: a | b, [_after_literal(bare, p) for p in V.CRUFT if not p.startswith("^")], bare.rlike(f"^(?:{opening})") | label)


def _after_literal(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs; it is only looked for where the literal text it begins with does."""
    literal = re.match(r"[^\\\[\](){}.*+?|^$]+", pattern)[0]
    found = F.contains(c, F.lit(literal))
    return found if literal == pattern else found & c.rlike(pattern)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def suggestion(value: Column, options) -> Column:
    """The first option that starts with value or the reverse, else that contains it or the
    reverse, else the list of options."""
    low = F.lower(value)
    listed = F.array(*map(F.lit, options))
    starts = F.filter(listed, lambda o: F.startswith(F.lower(o), low) | F.startswith(low, F.lower(o)))
    inside = F.filter(listed, lambda o: F.contains(F.lower(o), low) | F.contains(low, F.lower(o)))
    found = F.coalesce(F.get(starts, F.lit(0)), F.get(inside, F.lit(0)))
    return F.coalesce(F.concat(F.lit(" — did you mean '"), found, F.lit("'?")), F.lit(f". Valid options: {', '.join(options)}"))


def formulas(c: Column) -> Column:
    """Statistical notation in reading order."""
    return F.regexp_extract_all(c, F.lit("|".join(f"(?:{p})" for p in V.FORMULAS)), F.lit(0))


def keywords_of(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?i)^keywords:\s*", ""), r"(?iu)^mots[\s-]?clés\s*:\s*", "")


def sentences(c: Column) -> Column:
    """Sentences by rule: a run of . ! ? with closing quotes, then a blank or the end, unless the
    full stop belongs to an abbreviation or an initial."""
    guarded = guard(F.trim(F.coalesce(c, F.lit(""))))
    marked = F.regexp_replace(guarded, r"([.!?…]+[\"'”’»)\]]*)(?:\s+|$)", "$1\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda s: F.trim(F.replace(s, F.lit("\u0002"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def guard(c: Column) -> Column:
    """Full stops of abbreviations and of initials before a name are hidden as U+0002."""
    short = "|".join(V.ABBREVIATIONS)
    hidden = F.regexp_replace(c, rf"(^|[^\p{{L}}\p{{N}}])({short})\.", "$1$2\u0002")
    return F.regexp_replace(hidden, r"(^|[^\p{L}\p{N}])(\p{Lu})\.(\s+\p{Ll})", "$1$2\u0002$3")


def count_sentences(c: Column) -> Column:
    return F.size(sentences(c)).cast("long")


def key_findings(c: Column) -> Column:
    """First of two or more sentences, and the second of three or more."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    n = F.size(parts)
    return F.when(n >= 3, F.slice(parts, 1, 2)).when(n == 2, F.slice(parts, 1, 1)).otherwise(F.array().cast("array<string>"))


def is_upper(c: Column) -> Column:
    """Has cased letters, all upper case."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def summary(text: Column, most: int = 150, delimiter: str = "\n\n") -> Column:
    """About `most` words of the first substantive paragraphs; null for texts under 100 characters."""
    paragraphs = F.filter(F.transform(F.split(text, delimiter), lambda s: F.trim(s)), lambda p: p != "")
    good = F.filter(paragraphs, lambda p: (F.size(words(p)) >= 10) & ~contains_any(F.left(F.lower(p), F.lit(50)), V.SUMMARY_MARKERS) & ~is_upper(p))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))
    more = lambda acc, p: F.when(acc.n >= 1.5 * most, acc).otherwise(F.struct((acc.n + F.size(words(p))).alias("n"), F.concat(acc.kept, F.array(p)).alias("kept")))
    kept = F.aggregate(good, start, more, lambda acc: acc.kept)
    chosen = F.array_join(F.when(F.size(good) > 0, kept).otherwise(F.slice(paragraphs, 1, 3)), " ")
    cut = F.array_join(F.slice(words(chosen), 1, most), " ")
    stop = F.length(cut) - F.locate(".", F.reverse(cut)) + 1
    whole = F.when((F.locate(".", cut) > 0) & (stop - 1 > 0.6 * F.length(cut)), F.left(cut, stop)).otherwise(cut)
    return F.when(F.length(F.trim(text)) >= 100, F.when(F.size(words(chosen)) > most, whole).otherwise(chosen))


def accepted_language(header: Column, supported=("fr", "en"), default: str = "fr") -> Column:
    """The supported language of highest weight in an Accept-Language header."""
    entries = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda e: F.trim(e))
    weighted = F.transform(entries, lambda e, i: F.struct(-F.coalesce(F.try_to_number(blank_to_null(F.regexp_extract(e, r";\s*q=([0-9.]+)", 1)), F.lit("9.999")).cast("double"), F.lit(1.0)).alias("w"), i.alias("i"), F.lower(F.regexp_extract(e, r"^([A-Za-z]+)", 1)).alias("lang")))
    usable = F.filter(F.array_sort(weighted), lambda e: e.lang.isin(*supported))
    return F.coalesce(F.get(usable, F.lit(0)).lang, F.lit(default))


def tolerant_flags(c: Column) -> Column:
    """JSON text to an array of strings; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def field_status(c: Column) -> Column:
    return F.when(c.isNull(), "missing").when(F.trim(c) == "", "empty").otherwise("ok")
