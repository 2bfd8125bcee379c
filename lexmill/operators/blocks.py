"""Layout blocks to documents, and review of document bodies.

Blocks are rows (doc_id, pos, block_type, html, page, images). Joining split sentences looks ahead
and consumes blocks, and HTML is parsed in Python, so both run in one pass over documents in a row
(`prepare`); all else is native over window and aggregate."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window
from pyspark.sql.pandas.types import to_arrow_schema

from lexmill.functions import html as H, text as X, vocabulary as V
from lexmill.operators.numbering import running_sum
from lexmill.session import free

CHROME, FLOATS, PROSE, FIGURES = ("PageHeader", "PageFooter"), ("Figure", "Picture", "Caption", "Footnote", "Table"), ("Text", "Caption"), ("Figure", "Picture")
BLOCK = "struct<block_type:string,html:string,page:int,images:map<string,string>>"


def explode_documents(raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """Block rows of documents with `blocks`, or with `children` pages that hold them."""
    pages = F.filter("children", lambda p: p.block_type == "Page")
    flat = F.coalesce(F.col("blocks"), F.flatten(F.transform(pages, lambda p: p.children)), F.array().cast(f"array<{BLOCK}>"))
    return raw.select(key, F.posexplode(flat).alias("pos", "b")).select(key, "pos", "b.block_type", "b.html", "b.page", "b.images")


def goes_on(text: str) -> bool:
    bare = text.strip().lstrip("'\"‘’“”")
    return bare[:1].islower()


def unfinished(text: str) -> bool:
    bare = text.strip()
    return bool(bare) and bare[-1] not in ".!?:;"


class Joiner:
    """Joins blocks of one document that a page, column or float has split."""

    def __init__(self, kinds: list[str], htmls: list[str], pages: list[int]) -> None:
        self.kinds, self.pages = kinds, pages
        self.texts = [H.element_text(h, True) if k in PROSE else H.element_text(h) if k == "SectionHeader" else "" for k, h in zip(kinds, htmls, strict=True)]
        self.used: set[int] = set()

    def ahead(self, at: int, crossed: bool):
        """(index, crossed) of prose that follows, past chrome, floats and metadata sections; ends at
        a real heading or an unknown block."""
        aside = False
        for j in range(at + 1, len(self.kinds)):
            kind = self.kinds[j]
            if kind == "SectionHeader":
                aside = any(m in self.texts[j].lower() for m in V.METADATA_SECTIONS)
                if not aside:
                    return
            elif kind == "Text":
                if j not in self.used and not aside:
                    yield j, crossed
            elif kind in CHROME:
                crossed, aside = True, False
            elif kind not in FLOATS:
                return

    def first(self, at: int) -> tuple[int, bool] | None:
        open_ = unfinished(self.texts[at])
        for j, crossed in self.ahead(at, False):
            if goes_on(self.texts[j]) or open_ and not crossed and self.pages[j] == self.pages[at]:
                return j, crossed
            if not crossed:
                return None
        return None

    def later(self, at: int, crossed: bool) -> tuple[int, bool] | None:
        found = next(self.ahead(at, crossed), None)
        return found if found and goes_on(self.texts[found[0]]) else None

    def run(self) -> list[tuple[int, str | None]]:
        """(index, joined text or None) of the blocks that stay."""
        out = []
        for i, kind in enumerate(self.kinds):
            if i in self.used:
                continue
            step = self.first(i) if kind in PROSE else None
            text = self.texts[i] if step else None
            while step:
                j, crossed = step
                self.used.add(j)
                text = f"{text} {self.texts[j]}"
                step = self.later(j, crossed) if unfinished(text) else None
            out.append((i, text))
        return out


#: What prepare() adds to the columns of blocks.
PREPARED = "joined boolean, text string, items array<string>, alt string, description string, shown string"


def barrier() -> Column:
    """Whether no joining passes a block, as far as its kind and HTML alone tell: a heading that is no
    metadata section, or a block of a kind that prose doesn't go on past."""
    kind, html = F.coalesce(F.col("block_type"), F.lit("")), F.lower(F.coalesce(F.col("html"), F.lit("")))
    # Only headings without inner tags and entities are told here: others may hide a metadata section.
    plain = html.rlike(r"^\s*<h[1-6][^<>]*>[^<>&]*</h[1-6]>\s*$") & ~X.contains_any(html, V.METADATA_SECTIONS)
    return F.when(kind == "SectionHeader", plain).otherwise(~kind.isin("Text", *CHROME, *FLOATS))


def segmented(blocks: DataFrame, key: str, name: str) -> DataFrame:
    """blocks with `name`, a number that rises at each barrier: what is between two barriers of a document
    is joined by itself. Numbers come from range partitions, so a document of any length spreads."""
    (at,) = free(blocks, "barrier")
    return running_sum(blocks.withColumn(at, F.coalesce(barrier(), F.lit(False)).cast("long")), at, [key, "pos"], name).drop(at)


def prepare(blocks: DataFrame, key: str = "doc_id", spread: bool = False) -> DataFrame:
    """blocks with continuations joined into the block they continue (`joined`), and what the HTML of
    each block says: text, items of a list, alt and description of a figure, and `shown`, the HTML
    with formula spans. Documents are dealt out by key and sorted, and a task holds one at a time; with
    spread, a task holds what is between two barriers, and long documents are many tasks'."""
    columns = blocks.columns
    schema = T.StructType([*blocks.schema.fields, *T.StructType.fromDDL(PREPARED).fields])
    at = {c: columns.index(c) for c in ("block_type", "html", "page", "pos", key)}

    def parse(rows: list[tuple]) -> list[tuple]:
        kinds, htmls = [r[at["block_type"]] or "" for r in rows], [r[at["html"]] or "" for r in rows]
        out = []
        for i, text in Joiner(kinds, htmls, [r[at["page"]] for r in rows]).run():
            row, html = list(rows[i]), rows[i][at["html"]]
            if text is not None:
                html = row[at["html"]] = f"<p>{text}</p>"
            figure = H.figure(html) if kinds[i] in FIGURES else {"alt": None, "description": None}
            items = H.items(html) if kinds[i] == "ListGroup" else None
            out.append((*row, text is not None, H.element_text(html), items, figure["alt"], figure["description"], H.math_to_span(html or "")))
        return out

    def run(batches):
        held: list[tuple] = []
        last: tuple = ()
        for batch in batches:
            out: list[tuple] = []
            for *row, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[at[key]], segment) != last:
                    out += parse(held)
                    held = []
                last = row[at[key]], segment
                held.append(tuple(row))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], arrow)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in parse(held)], arrow)

    arrow = to_arrow_schema(schema)
    (segment,) = free(blocks, "segment")
    by = [key, segment] if spread else [key]
    dealt = segmented(blocks, key, segment) if spread else blocks.withColumn(segment, F.lit(0))
    return dealt.select(*columns, segment).repartition(*by).sortWithinPartitions(*by, "pos").mapInArrow(run, schema)


def join_split_sentences(blocks: DataFrame, key: str = "doc_id", spread: bool = False) -> DataFrame:
    """blocks with continuations joined into the block they continue, and `joined`."""
    return prepare(blocks, key, spread).select(*blocks.columns, "joined")


def with_sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks with text, section (forward filled from h2 headings and inline keywords), title mark,
    caption of tables and figures, and number of figures."""
    order = Window.partitionBy(key).orderBy("pos")
    t = blocks if "text" in blocks.columns else blocks.withColumn("text", F.coalesce(H.text_column(F.col("html")), F.lit("")))
    t = t.withColumn("level", X.heading_level(F.col("html")))
    kind = F.col("block_type")
    first_h1 = (kind == "SectionHeader") & (F.col("level") == "h1") & (F.coalesce("page", F.lit(0)) == 0)
    t = t.withColumn("is_title", first_h1 & (F.count_if(first_h1).over(order) == 1))
    inline = (kind == "Text") & F.lower("text").rlike("^(keywords:|mots)")
    mark = F.when((kind == "SectionHeader") & (F.col("level") == "h2") & ~F.col("is_title"), X.section_of(F.col("text"))).when(inline, "keywords")
    section = F.coalesce(F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("preamble"))
    t = t.withColumn("section", F.when(F.col("is_title"), "preamble").when(~kind.isin(*CHROME), section))
    t = t.withColumn("figure_id", F.when(kind.isin(*FIGURES), F.concat(F.lit("fig_"), F.count_if(kind.isin(*FIGURES)).over(order).cast("string"))))
    near = Window.partitionBy(key, F.col("block_type").isin("Caption", "Table", *FIGURES)).orderBy("pos")
    last = F.lag(F.struct("block_type", "text")).over(near)
    return t.withColumn("__last", last).withColumn("caption", F.when(kind.isin("Table", *FIGURES) & (F.col("__last.block_type") == "Caption"), F.col("__last.text"))).drop("__last")


def _ordered(value: Column, when: Column, glue: str) -> Column:
    """Values of rows that meet `when`, by position, joined."""
    rows = F.array_sort(F.collect_list(F.when(when, F.struct("pos", value.alias("v")))))
    return X.blank_to_null(F.array_join(F.transform(rows, lambda r: r.v), glue))


def _first(value: Column, when: Column) -> Column:
    return F.min_by(F.when(when, value), F.when(when & value.isNotNull(), F.col("pos")))


def parse_documents(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One record per document (the patterns are fixed values): metadata, abstract, keywords, body HTML in fixed order of sections,
    references, tables, figures, footnotes, unclassified blocks, statistics, warnings, and the stage
    (cache: parsed, not yet reviewed)."""
    n_in = blocks.groupBy(key).agg(F.count("*").alias("input_blocks"))
    b = with_sections(prepare(blocks, key), key)
    kind, text, sec, page = F.col("block_type"), F.col("text"), F.col("section"), F.coalesce("page", F.lit(0))
    early = (kind == "Text") & (sec == "preamble") & (page == 0)
    stated = F.coalesce(X.first_match(text, r"(?i)©.*?(20\d{2})", 1), X.first_match(text, r"(?i)published[:\s]+.*?(20\d{2})", 1), X.first_match(text, r"\((20\d{2})\)", 1))
    cites = (kind == "PageHeader") & (text.rlike(r"\d{4}.*\d+[-–]\d+") | text.rlike(r"\(\d{4}\)"))
    b = b.withColumn("refs", F.when((kind == "ListGroup") & (sec == "references"), F.col("items")).when((kind == "Text") & (sec == "references") & text.rlike(r"^(\d+\.?\s|\[?\d+\]?\s)"), F.array(text)))
    b = b.withColumn("shown", F.when(F.col("figure_id").isNotNull(), F.concat(F.lit('<div class="figure-placeholder" data-figure-id="'), "figure_id", F.lit('"></div>'))).otherwise(F.col("shown")))
    prose = kind == "Text"
    inner = ~kind.isin(*CHROME, "Footnote")
    rank = F.when(F.lit(False), 0)
    for i, name in enumerate(V.BODY_ORDER):
        rank = rank.when(sec == name, i)
    listed = lambda when, *fields: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", F.struct(*fields).alias("v"))))), lambda r: r.v)
    heading = (kind == "SectionHeader") & (sec == "abstract")
    lang = F.when(F.contains(F.lower(text), F.lit("résumé")), "fr").when(F.contains(F.lower(text), F.lit("abstract")), "en")
    unclassified = inner & (sec == "preamble") & ~F.col("is_title")
    out = b.groupBy(key).agg(
        _first(text, F.col("is_title")).alias("title"),
        _first(text, early & text.rlike(r"[A-Z]\.\s*[A-Z][a-z]+.*,") & (F.length(text) < 300)).alias("authors"),
        _first(F.upper(F.trim(text)), X.is_type_label(text)).alias("article_type"),
        _first(X.doi_of(F.col("html")), kind == "PageFooter").alias("doi"),
        _first(text, cites).alias("citation"),
        _first(F.coalesce(F.when(cites, X.year_of(text)), stated), cites | early).alias("year"),
        _first(X.email_of(text), kind == "Footnote").alias("author_email"),
        _ordered(text, prose & (sec == "abstract"), " ").alias("abstract"),
        F.max_by(lang, F.when(heading & lang.isNotNull(), F.col("pos"))).alias("abstract_lang"),
        _first(X.keywords_of(text), (sec == "keywords") & F.lower(text).rlike("^keywords:")).alias("keywords"),
        _first(X.keywords_of(text), (sec == "keywords") & ~F.lower(text).rlike("^keywords:") & F.contains(F.lower(text), F.lit("mots"))).alias("keywords_fr"),
        X.blank_to_null(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inner & rank.isNotNull(), F.struct(rank.alias("r"), "pos", "shown")))), lambda r: r.shown), "\n")).alias("body_html"),
        _ordered(text, prose & (sec == "conflict_of_interest"), " ").alias("conflict_of_interest"),
        _ordered(text, prose & (sec == "acknowledgements"), " ").alias("acknowledgements"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("refs").isNotNull(), F.struct("pos", "refs")))), lambda r: r.refs)).alias("references"),
        listed(kind == "Table", "html", "page", "section", "caption").alias("tables"),
        listed(kind.isin(*FIGURES), F.col("figure_id").alias("id"), "page", "section", "caption", "alt", "description", F.map_keys("images").alias("images")).alias("figures"),
        listed(kind == "Footnote", "text", "html", "page").alias("footnotes"),
        listed(unclassified, "block_type", X.truncate(text, 200).alias("text"), "page").alias("unclassified"),
        F.array_sort(F.collect_list(F.when(inner, F.col("section")))).alias("__each"),
        F.count("*").alias("after_join"), F.count_if(kind.isin(*CHROME)).alias("skipped_chrome"), F.count_if(kind == "Footnote").alias("footnotes_extracted"),
    )
    found = F.map_from_entries(F.transform(F.array_distinct("__each"), lambda x: F.struct(x, F.size(F.filter("__each", lambda y: y == x)).cast("long"))))
    out = out.withColumn("sections_found", F.when(F.size("__each") > 0, found)).drop("__each")
    out = out.join(n_in, key).withColumn("classified", F.col("after_join") - F.col("skipped_chrome"))
    out = out.withColumns({"abstract_en": F.when(F.col("abstract_lang") == "en", F.col("abstract")), "abstract_fr": F.when(F.col("abstract_lang") == "fr", F.col("abstract"))}).drop("abstract_lang")
    missing = [F.when(F.col(c).isNull(), F.lit(f"[MISSING] No {c} found")) for c in ("title", "abstract", "doi")]
    warnings = F.array_compact(F.array(*missing, F.when(F.size("references") == 0, F.lit("[MISSING] No references extracted")), F.when(F.size("unclassified") > 0, F.concat(F.lit("[UNCLASSIFIED] "), F.size("unclassified").cast("string"), F.lit(" blocks in preamble not categorized")))))
    return out.withColumns({"warnings": warnings, "stage": F.lit("cache")})


def resolve_figures(parsed: DataFrame, folder: str = "images") -> DataFrame:
    """parsed with `resolved_html`: placeholders in body_html become the figure of their id, its
    first image under `folder`, caption and description, or a note where there is no image."""
    parts = F.split(F.coalesce("body_html", F.lit("")), '<div class="figure-placeholder" data-figure-id="')
    lit, none = F.lit, F.lit("")

    def shown(part: Column) -> Column:
        id = F.substring_index(part, '"></div>', 1)
        rest = F.substring(part, F.length(id) + 9, F.length(part))  # 8 characters close the placeholder
        figure = F.get(F.filter("figures", lambda f: (f.id == id) & (F.size(f.images) > 0)), lit(0))
        alt = F.coalesce(X.blank_to_null(figure.alt), X.blank_to_null(figure.caption), F.concat(lit("Figure "), id))
        under = [F.coalesce(F.concat(lit(a), X.blank_to_null(c), lit(b)), none) for a, c, b in (("<figcaption>", figure.caption, "</figcaption>"), ('<div class="figure-data">', figure.description, "</div>"))]
        found = F.concat(lit(f'<figure><img src="{folder}/'), F.get(figure.images, lit(0)), lit('" alt="'), alt, lit('"/>'), *under, lit("</figure>"))
        return F.concat(F.coalesce(found, F.concat(lit('<div class="figure-missing">[Figure '), id, lit(" - no image]</div>"))), rest)

    whole = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, lit(2), F.size(parts)), shown), ""))
    return parsed.withColumn("resolved_html", whole)


def extract_images(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, content): decoded images, named after their figure."""
    order = Window.partitionBy(key).orderBy("pos")
    own = blocks.where(F.col("block_type").isin(*FIGURES)).withColumn("n", F.row_number().over(order))
    each = own.select(key, "n", F.explode("images").alias("name", "data"))
    suffix = F.coalesce(X.first_match(F.col("name"), r"\.[A-Za-z0-9]+$"), F.lit(".jpg"))
    return each.select(key, F.concat(F.lit("fig_"), F.col("n").cast("string"), suffix).alias("name"), F.unbase64("data").alias("content"))


ISSUES = ("ORPHAN", "INCOMPLETE", "CAPTION", "PAGE_ARTIFACT", "SHORT_FRAGMENT", "REFERENCE_LEAK")


def fix_report(paragraphs: DataFrame, fixes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, action, outcome) of each fix: APPLIED, or SKIPPED where there is no such paragraph,
    nothing to join, or the action is unknown."""
    n = paragraphs.groupBy(key).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    known = paragraphs.select(key, "pos").withColumn("known", F.lit(True))
    j = fixes.join(known, [key, "pos"], "left").join(n, key, "left")
    able = F.when(F.col("action") == "join_previous", F.col("pos") > F.col("first")).when(F.col("action") == "join_next", F.col("pos") < F.col("last")).otherwise(F.col("action").isin("delete", "replace"))
    return j.select(key, "pos", "action", F.when(F.coalesce(F.col("known") & able, F.lit(False)), "APPLIED").otherwise("SKIPPED").alias("outcome"))


def issue_counts(reviewed: DataFrame, key: str = "doc_id", size: int = 10) -> DataFrame:
    """(key, page, n_paragraphs, n_flagged) of each page of `size` paragraphs."""
    order = Window.partitionBy(key).orderBy("pos")
    paged = reviewed.withColumn("page", F.floor((F.row_number().over(order) - 1) / size))
    return paged.groupBy(key, "page").agg(F.count("*").alias("n_paragraphs"), F.count_if(F.size("issues") > 0).alias("n_flagged"))


# The patterns and lengths of issues.
def body_issues(tag: Column, c: Column) -> Column:
    """Issue codes of one body element."""
    n, para = F.length(c), tag == "p"
    return F.array_compact(F.array(
        F.when(c.rlike(r"^\p{Ll}") & (n > 20), "ORPHAN"),
        F.when(para & (n > 50) & ~F.right(c, F.lit(1)).isin(*".!?:;)"), "INCOMPLETE"),
        F.when(c.rlike(r"(?i)^(Figure|Fig\.?|Table|Tableau)\s*\d"), "CAPTION"),
        F.when(c.rlike(r"^\d+$") | (n < 10) & c.rlike(r"(?i)^Page\s*\d+"), "PAGE_ARTIFACT"),
        F.when(para & (n < 25) & ~F.endswith(c, F.lit(":")), "SHORT_FRAGMENT"),
        F.when(c.rlike(r"^\d+\.\s*[A-Z]") & F.contains(F.lower(c), F.lit("et al")), "REFERENCE_LEAK"),
    ))


def review(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(doc_id, pos, tag, text) with issues and length; empty ones are left out."""
    return paragraphs.where("text <> ''").withColumn("issues", body_issues(F.col("tag"), F.col("text"))).withColumn("full_length", F.length("text"))


def unaddressed(reviewed: DataFrame, fixes: DataFrame, acknowledged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flagged paragraphs that neither a fix nor an acknowledgement covers."""
    done = fixes.select(key, "pos").union(acknowledged.select(key, "pos"))
    return reviewed.where(F.size("issues") > 0).join(done, [key, "pos"], "left_anti")


def apply_fixes(paragraphs: DataFrame, fixes: DataFrame, key: str = "doc_id") -> DataFrame:
    """paragraphs after delete, join_previous, join_next and replace by pos. Fixes out of range, or
    that join beyond an end, change nothing. Joins of a run of neighbours chain."""
    order = Window.partitionBy(key).orderBy("pos")
    p = paragraphs.join(fixes.select(key, "pos", "action", F.col("text").alias("new_text")), [key, "pos"], "left")
    p = p.withColumn("before", F.lag("action").over(order)).withColumn("first", F.row_number().over(order) == 1)
    glued = ((F.col("action") == "join_previous") | (F.col("before") == "join_next")) & ~F.col("first")
    p = p.withColumn("island", F.count_if(~F.coalesce(glued, F.lit(False))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.when(F.col("action") == "delete", None).when(F.col("action") == "replace", F.coalesce("new_text", F.lit(""))).otherwise(F.col("text"))
    kept = p.withColumn("text", body).where("text is not null")
    return kept.groupBy(key, "island").agg(F.min("pos").alias("pos"), F.min_by("tag", "pos").alias("tag"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r.text), " ").alias("text")).drop("island")


def reference_hints(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, hints): up to ten texts after a references heading, before the next closing section."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = blocks.withColumn("text", F.coalesce(H.text_column(F.col("html")), F.lit("")))
    head = F.col("text").rlike(r"(?iu)^(References|Références|Bibliography|Bibliographie)")
    t = t.withColumn("head", head).withColumn("inside", F.count_if("head").over(order) > 0)
    closes = F.col("inside") & F.col("text").rlike(r"(?i)^(Appendix|Annexe|Acknowledgements)")
    t = t.withColumn("closed", F.count_if(closes).over(order) > 0)
    rows = t.where(F.col("inside") & ~F.col("head") & ~F.col("closed") & (F.length("text") > 20))
    return rows.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.left("text", F.lit(200)).alias("t")))), lambda r: r.t), 1, 10).alias("hints"))


def unwrapped_formulas(paragraphs: DataFrame, spans: Column | None = None) -> DataFrame:
    """paragraphs with statistical notation outside `spans` (array of wrapped texts): the first
    five, and how many."""
    wrapped = spans if spans is not None else F.array().cast("array<string>")
    free = F.filter(X.formulas(F.col("text")), lambda m: ~F.exists(wrapped, lambda s: F.contains(s, m)))
    return paragraphs.withColumn("__f", free).where(F.size("__f") > 0).withColumn("unwrapped", F.slice("__f", 1, 5)).withColumn("total_unwrapped", F.size("__f").cast("long")).drop("__f")


def wrap_formula(html: Column, formula: Column) -> Column:
    """The first occurrence inside a formula span."""
    span = F.concat(F.lit('<span class="formula">'), formula, F.lit("</span>"))
    at = F.call_function("locate", formula, html)
    return F.when(at > 0, F.concat(F.substring(html, F.lit(1), at - 1), span, F.substring(html, at + F.length(formula), F.length(html)))).otherwise(html)


def append_references(references: Column, more: Column) -> Column:
    return F.concat(F.coalesce(references, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>")))


def confirm_fields(docs: DataFrame, overrides: DataFrame, key: str = "doc_id", fields=("title", "authors", "year", "citation", "abstract")) -> DataFrame:
    """docs with non-null overrides applied; `error` where all fields were called fine although some
    have issues and nothing corrects them."""
    o = overrides.select(key, "all_fields_ok", *[F.col(f).alias(f"__{f}") for f in fields])
    j = docs.join(o, key, "left")
    issues = [X.field_status(F.col(f)) != "ok" for f in fields]
    any_issue = issues[0]
    for i in issues[1:]:
        any_issue = any_issue | i
    none = F.coalesce(*[F.col(f"__{f}") for f in fields]).isNull()
    error = F.when(F.coalesce("all_fields_ok", F.lit(False)) & any_issue & none, "ISSUES_NOT_ADDRESSED")
    return j.withColumn("error", error).withColumns({f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}).drop("all_fields_ok", *[f"__{f}" for f in fields])


def warnings_for_review(parsed: DataFrame, reviewed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, warnings, total): parser warnings and orphan paragraphs, the first ten and the count."""
    orphans = reviewed.where(F.array_contains("issues", "ORPHAN")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.left("text", F.lit(80)).alias("t")))), lambda r: F.concat(F.lit("ORPHAN at "), r.pos.cast("string"), F.lit(": "), r.t)).alias("o"))
    j = parsed.select(key, "warnings").join(orphans, key, "left").withColumn("w", F.concat("warnings", F.coalesce("o", F.array().cast("array<string>"))))
    return j.select(key, F.slice("w", 1, 10).alias("warnings"), F.size("w").alias("total"))


def raw_review_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of the first two pages that are no figures, with text of over five characters."""
    t = blocks.where((F.coalesce("page", F.lit(0)) <= 1) & ~F.col("block_type").isin(*FIGURES)).withColumn("text", H.text_column(F.col("html")))
    return t.where(F.length("text") > 5).withColumn("text", F.left("text", F.lit(500)))


def body_start(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start): position of the first content heading."""
    heading = F.col("tag").isin("h1", "h2", "h3") & F.lower("text").rlike("|".join(f"(?:{p})" for p in V.BODY_STARTS))
    return elements.where(heading).groupBy(key).agg(F.min("pos").alias("start"))


def page_blocks(pages: DataFrame, key: str = "page_id", ended: bool = False) -> DataFrame:
    """Layout blocks of web pages: headings, paragraphs and lists as the parser expects them."""
    kinds = F.when(F.col("tag").rlike("^h[1-6]$"), "SectionHeader").when(F.col("tag").isin("ul", "ol"), "ListGroup").when(F.col("tag") == "table", "Table").otherwise("Text")
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<"), "tag", F.lit(">"), text, F.lit("</"), "tag", F.lit(">"))
    return H.element_rows(pages, key, ended=ended).select(F.col(key).alias("doc_id"), "pos", kinds.alias("block_type"), html.alias("html"), F.lit(0).alias("page"), F.create_map().cast("map<string,string>").alias("images"))
