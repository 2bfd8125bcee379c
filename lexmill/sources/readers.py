"""Readers of article files and listings, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.functions import html as H, text as X
from lexmill.operators import blocks as B, extraction as E, glossary as G
from lexmill.operators.numbering import numbered

RAW_BLOCKS = f"doc_id string, blocks array<{B.BLOCK}>, children array<struct<block_type:string,children:array<{B.BLOCK}>>>"
RESPONSE = f"doc_id string, json struct<children:array<struct<block_type:string,children:array<{B.BLOCK}>>>>, chunks struct<blocks:array<{B.BLOCK}>>, blocks array<{B.BLOCK}>"


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """A read with bound parameters."""
    return spark.sql(sql, args=params)


def open_tables(spark: SparkSession, folder: str, names) -> None:
    """Read-only views of a folder of Parquet tables."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def read_yaml(path: str) -> dict:
    """A small YAML file on the driver; a missing one raises."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def taxonomy_rows(spark: SparkSession, data: dict) -> dict[str, DataFrame]:
    """(code, label, definition, ord) of each section of a nested taxonomy."""
    out = {}
    for section, entries in data.items():
        if isinstance(entries, dict):
            described = {k: v if isinstance(v, dict) else {"label": v if v is not None else k} for k, v in entries.items()}
            rows = [(k, str(v.get("label", k)), v.get("definition"), i) for i, (k, v) in enumerate(described.items())]
            out[section] = spark.createDataFrame(rows, "code string, label string, definition string, ord int")
    return out


def glossary_entries(spark: SparkSession, data: dict) -> DataFrame:
    """Entries of a glossary's list sections; other sections and entries are skipped."""
    rows = []
    for category, entries in data.items():
        for e in entries if isinstance(entries, list) else []:
            if isinstance(e, dict) and e.get("en"):
                alt = e.get("fr_alt") or []
                rows.append((len(rows), e["en"], e.get("fr"), [alt] if isinstance(alt, str) else list(alt), e.get("abbreviation"), e.get("note"), category))
    return spark.createDataFrame(rows, "ord int, en string, fr string, fr_alt array<string>, abbreviation string, note string, category string")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    return G.index(glossary_entries(spark, read_yaml(path)))


def pattern_rows(spark: SparkSession, data: dict) -> DataFrame:
    """(priority, section, lang, pattern) of multilingual pattern lists, in file order."""
    rows = [(i, section, lang, p) for i, (section, lang, p) in enumerate((s, l, p) for s, langs in data.items() for l, ps in (langs or {}).items() for p in ps)]
    return spark.createDataFrame(rows, "priority int, section string, lang string, pattern string")


def type_methods(data: dict) -> dict[str, tuple[str, ...]]:
    """Patterns of article types by method, lower case, in file order: the mapping that
    classify.method_of takes. Entries are lists, or lists by language."""
    out = {}
    for method, patterns in data.items():
        listed = [p for ps in patterns.values() for p in ps] if isinstance(patterns, dict) else list(patterns or [])
        out[method] = tuple(str(p).lower() for p in listed)
    return out


def first_pattern(texts: DataFrame, patterns: DataFrame, key: str, text: str, most_bytes: int = G.TERM_BYTES) -> DataFrame:
    """(key, section) of the first pattern, by priority, contained in each text. Patterns of up to
    most_bytes are one automaton that tasks hold; more are refused, as they come from small files."""
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"patterns of {size} bytes: at most {most_bytes}")
    found = G.contained(texts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t")), [(r["priority"], r["pattern"], r["section"]) for r in patterns.select("priority", "pattern", "section").collect()], key)
    return found.groupBy(key).agg(F.min_by("section", "priority").alias("section"))


def resource_tables(resources: DataFrame) -> dict[str, DataFrame]:
    """articles, translations, keywords and links of resource records(id, title_en, title_fr, year,
    keywords, summary_en, summary_fr, url, category, translation_status)."""
    status = F.coalesce(F.create_map(F.lit("completed"), F.lit("translated"), F.lit("not_started"), F.lit("pending"))[F.col("translation_status")], F.col("translation_status"))
    articles = resources.select("id", F.col("title_en").alias("source_title"), F.col("url").alias("source_url"), "year", F.col("summary_en").alias("summary_original"), status.alias("processing_status"))
    has = F.coalesce(X.blank_to_null(F.col("title_fr")), X.blank_to_null(F.col("summary_fr"))).isNotNull()
    translations = resources.where(has).select(F.col("id").alias("article_id"), F.lit("fr").alias("target_language"), F.col("title_fr").alias("translated_title"), F.col("summary_fr").alias("translated_summary"), status.alias("status"))
    each = resources.select(F.col("id").alias("article_id"), F.explode("keywords").alias("keyword")).distinct()
    keywords = each.select("keyword").distinct().select(F.xxhash64("keyword").alias("id"), "keyword")
    links = each.select("article_id", F.xxhash64("keyword").alias("keyword_id"))
    categories = resources.where("category is not null").select(F.col("id").alias("article_id"), F.col("category").alias("category_id"), F.lit(1).alias("is_primary"))
    return {"articles": articles, "translations": translations, "keywords": keywords, "article_keywords": links, "article_categories": categories}


def resource_lists(spark: SparkSession, path: str) -> DataFrame:
    """Records of resource-list pages."""
    return H.resource_rows(spark.read.text(path, wholetext=True))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Block rows of one JSON document a file, flat or by page."""
    raw = spark.read.schema(RAW_BLOCKS).json(path, multiLine=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return B.explode_documents(raw.withColumn("doc_id", F.coalesce("doc_id", name)))


def response_blocks(raw: DataFrame) -> DataFrame:
    """Block rows of extraction responses, with inlined images and n_pages."""
    pages = F.col("json.children")
    paged = F.flatten(F.transform(pages, lambda p, i: F.transform(p.children, lambda b: F.struct(b.block_type.alias("block_type"), b.html.alias("html"), i.cast("int").alias("page"), b.images.alias("images")))))
    flat = F.coalesce(paged, F.col("chunks.blocks"), F.col("blocks"), F.array().cast(f"array<{B.BLOCK}>"))
    out = raw.select("doc_id", flat.alias("b")).withColumn("n_pages", F.coalesce(F.array_max(F.transform("b", lambda x: x.page)) + 1, F.lit(0)))
    rows = out.select("doc_id", "n_pages", F.posexplode("b").alias("pos", "x")).select("doc_id", "pos", "x.*", "n_pages")
    return rows.withColumn("html", H.embed_images(F.col("html"), F.col("images")))


def extract_chain(candidates: DataFrame, key: str = "doc_id", sources=("txt", "html", "pdf_a", "pdf_b", "pdf_c")) -> DataFrame:
    """(key, text, method, problems): a text file is trusted; else the first candidate that is not
    unusable. Columns hold the text each extractor gave, or null."""
    text, method = None, None
    for s in (c for c in sources if c in candidates.columns):
        ok = F.col(s).isNotNull() if s == "txt" else F.col(s).isNotNull() & E.usable(E.extraction_problems(F.col(s)))
        text = F.when(ok, F.col(s)) if text is None else text.when(ok, F.col(s))
        method = F.when(ok, s) if method is None else method.when(ok, s)
    out = candidates.select(key, text.alias("text"), method.alias("method"))
    problems = F.when(F.col("text").isNull(), F.array(F.lit("PDFEXTRACT"))).otherwise(F.when(F.col("method") == "txt", F.array_except(E.extraction_problems(F.col("text")), F.array(F.lit("UNUSABLE")))).otherwise(E.extraction_problems(F.col("text"))))
    return out.withColumn("problems", problems)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, slug, extension, length, modified) of files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), X.file_slug(F.regexp_replace(name, r"\.[^.]+$", "")).alias("slug"), F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).alias("extension"), "length", F.date_format("modificationTime", "yyyy-MM-dd HH:mm").alias("modified"))


def entries(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """(name, slug, extension) of what a folder itself holds under such names: files that are not empty, and folders in which
    there are files, as of tables in part files."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    depth = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).depth()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.get(F.split(F.regexp_replace("path", "^[^/:]+:(//[^/]*)?", ""), "/"), depth + 1)
    below = found.select(name.alias("name")).where(F.endswith("name", F.lit(ending))).distinct()
    return below.select("name", X.file_slug(F.regexp_replace("name", r"\.[^.]+$", "")).alias("slug"), F.lower(F.regexp_extract("name", r"\.[^.]+$", 0)).alias("extension"))


def to_do(found: DataFrame, done: DataFrame, key: str = "slug", size: int = 5) -> DataFrame:
    """found that is not in done, with batch numbers of `size` in order of key; rows that tie keep the
    order of the input. Rows are numbered by all tasks."""
    left = found.join(done.select(key), key, "left_anti")
    return numbered(left, [key], name="batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def log_tail(lines: DataFrame, order: str, n: int = 50) -> DataFrame:
    return lines.where(F.trim("value") != "").orderBy(F.col(order).desc()).limit(n)


def document_metadata(docs: DataFrame, key: str = "doc_id", title: str | None = None, text: str = "text") -> DataFrame:
    """(key, title, doi): a stated title, else one from the first page's text."""
    stated = X.blank_to_null(F.col(title)) if title else F.lit(None).cast("string")
    return docs.select(key, F.coalesce(stated, E.title_of(F.col(text))).alias("title"), X.doi_of(F.col(text), "page").alias("doi"))


