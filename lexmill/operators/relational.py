"""Listings, lookups, joins, counts and queues over article tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import text as X, vocabulary as V
from lexmill.operators.numbering import numbered
from lexmill.session import free


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def exists(df: DataFrame, key: str, value) -> bool:
    return not by_key(df, key, value).limit(1).isEmpty()


def listing(df: DataFrame, *conditions: Column, order=(), limit: int | None = None) -> DataFrame:
    """Rows that meet all conditions, ordered, the first `limit`."""
    out = reduce(DataFrame.where, conditions, df)
    out = out.orderBy(*order) if order else out
    return out.limit(limit) if limit is not None else out


def flagged(articles: DataFrame, limit: int = 20) -> DataFrame:
    return listing(articles, F.col("processing_status") == "translated", F.size("processing_flags") > 0, order=(F.col("processed_at").desc_nulls_last(), F.col("id")), limit=limit)


def recently_completed(articles: DataFrame, limit: int = 10) -> DataFrame:
    return listing(articles, F.col("processing_status").isin("translated", "skipped"), order=(F.col("processed_at").desc_nulls_last(), F.col("id")), limit=limit)


def admin_conditions(status=None, has_flags=None, missing_url=None, category=None, method=None, voice=None) -> list[Column]:
    """Conjunction of the filters given; values are literals, never text of a query."""
    out = []
    for name, value in (("processing_status", status), ("category", category), ("method", method), ("voice", voice)):
        if value is not None:
            out.append(F.col(name) == F.lit(value))
    if has_flags is not None:
        out.append((F.size("processing_flags") > 0) if has_flags else (F.size("processing_flags") <= 0))
    if missing_url is not None:
        empty = F.coalesce(F.col("source_url"), F.lit("")) == ""
        out.append(empty if missing_url else ~empty)
    return out


def admin_listing(articles: DataFrame, **filters) -> DataFrame:
    return listing(articles, *admin_conditions(**filters), order=(F.col("processed_at").desc_nulls_last(), F.col("source_title")))


def admin_articles(articles: DataFrame, translations: DataFrame, links: DataFrame, lang: str = "fr", **filters) -> DataFrame:
    """The admin list: articles with their translation and primary category, filtered and ordered."""
    joined = with_translation(articles.drop("category"), translations, links, lang).withColumnRenamed("category_id", "category")
    return admin_listing(joined, **filters)


def admin_article(articles: DataFrame, translations: DataFrame, links: DataFrame, key, lang: str = "fr") -> DataFrame:
    """One article of that list."""
    return with_translation(by_key(articles, "id", key), translations, links, lang)


def ready_queue(documents: DataFrame) -> DataFrame:
    """(doc_id, title, n_warnings, n_references, n_figures) of parsed documents that are ready for review."""
    ready = documents.where("stage = 'ready'")
    return ready.select("doc_id", F.coalesce("title", "doc_id").alias("title"), F.size("warnings").alias("n_warnings"), F.size("references").alias("n_references"), F.size("figures").alias("n_figures"))


def queue_summary(ready: DataFrame) -> DataFrame:
    """Documents of the ready queue, and those with warnings."""
    return ready.agg(F.count("*").alias("total"), F.count_if(F.col("n_warnings") > 0).alias("with_warnings"))


def migration_counts(articles: DataFrame, translations: DataFrame, keywords: DataFrame, links: DataFrame, status: str = "processing_status") -> DataFrame:
    """One row: articles, those no longer pending, translations, keywords and links."""
    parts = [articles.agg(F.count("*").alias("articles"), F.count_if(F.col(status) != "pending").alias("processed"))]
    parts += [df.agg(F.count("*").alias(name)) for name, df in (("translations", translations), ("keywords", keywords), ("links", links))]
    return reduce(lambda a, b: a.join(b, F.lit(True)), parts)  # one row each


def preprocessing_queue(articles: DataFrame, flag: str = "PDFEXTRACT") -> DataFrame:
    return listing(articles, F.col("processing_status") == "skipped", F.array_contains("processing_flags", flag), order=("source_title",))


def search(df: DataFrame, query: str, columns) -> DataFrame:
    """Any column like %query%, without regard to case; % and _ in it are wildcards."""
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")).ilike(f"%{query}%") for c in columns]))


def find_by_words(files: DataFrame, query: str, name: str = "name") -> DataFrame:
    """(outcome, hits): an exact name without case, else names that hold all words of the query."""
    low = F.lower(F.col(name))
    stem = F.regexp_replace(F.regexp_replace(low, r"\.[a-z0-9]+$", ""), r"[-_]+", " ")
    words = [w for w in query.lower().replace("-", " ").replace("_", " ").split() if w]
    every = reduce(lambda a, b: a & b, [F.contains(stem, F.lit(w)) for w in words], F.lit(True))
    marked = files.select(F.col(name).alias("name"), (low == query.lower()).alias("exact"), every.alias("every"))
    counts = marked.agg(F.min(F.when(F.col("exact"), F.col("name"))).alias("e"), F.count_if("every").alias("n"))
    first = marked.where("every").orderBy("name").limit(5).agg(F.array_sort(F.collect_list("name")).alias("h"))  # five names at most
    found = counts.join(first, F.lit(True))  # one row each
    exact = F.col("e").isNotNull()
    return found.select(F.when(exact | (F.col("n") == 1), "FOUND").when(F.col("n") == 0, "NOT_FOUND").otherwise("AMBIGUOUS").alias("outcome"), F.when(exact, F.array("e")).otherwise(F.col("h")).alias("hits"))


def localized(lang: Column, translated: Column, source: Column, most: int = 200) -> Column:
    """Translated text for fr where there is one, else the source, cut for display."""
    return X.truncate(F.coalesce(F.when(lang == "fr", X.blank_to_null(translated)), source), most)


def pick(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows of the ids in the order given; unknown ids are left out."""
    wanted = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos int, {key} {dict(df.dtypes)[key]}")
    return df.join(F.broadcast(wanted), key).orderBy("pos").drop("pos")  # as long as the list given


def with_translation(articles: DataFrame, translations: DataFrame, links: DataFrame, lang: str = "fr") -> DataFrame:
    """Articles with their translation into lang and primary category, where there are any."""
    t = translations.where(F.col("target_language") == lang).select(F.col("article_id").alias("id"), "translated_title", "translated_summary", F.col("status").alias("translation_status"))
    c = links.where(F.col("is_primary") == 1).select(F.col("article_id").alias("id"), "category_id")
    return articles.join(t, "id", "left").join(c, "id", "left")


def keywords_of_articles(links: DataFrame, keywords: DataFrame) -> DataFrame:
    """(article_id, keywords): sorted keywords of each article."""
    return links.join(keywords.withColumnRenamed("id", "keyword_id"), "keyword_id").groupBy("article_id").agg(F.array_sort(F.collect_list("keyword")).alias("keywords"))


def by_category(articles: DataFrame, links: DataFrame, translations: DataFrame, category, lang: str = "fr") -> DataFrame:
    """Articles of a category, primary or not, newest first."""
    own = links.where(F.col("category_id") == category).select(F.col("article_id").alias("id")).distinct()
    t = translations.where(F.col("target_language") == lang).select(F.col("article_id").alias("id"), "translated_title")
    return articles.join(own, "id").join(t, "id", "left").orderBy(F.col("year").desc_nulls_last(), "id")


def translated(articles: DataFrame, translations: DataFrame, links: DataFrame, lang: str = "fr") -> DataFrame:
    done = translations.where((F.col("target_language") == lang) & F.col("status").isin("translated", "reviewed")).select(F.col("article_id").alias("id"), "translated_title")
    c = links.where(F.col("is_primary") == 1).select(F.col("article_id").alias("id"), "category_id")
    return articles.join(done, "id").join(c, "id", "left").orderBy(F.col("year").desc_nulls_last(), "id")


def status_counts(articles: DataFrame, status: str = "status", statuses=V.STATUSES) -> DataFrame:
    """A count for each known status, zeros included."""
    dim = articles.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    n = articles.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return dim.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def roll_up(counts: DataFrame, processed: int, interval: int) -> DataFrame:
    """Total of all counts and what is left of the session."""
    return counts.agg(F.sum("n").alias("total")).withColumn("remaining", F.greatest(F.lit(0), F.lit(interval - processed)))


def admin_stats(articles: DataFrame) -> DataFrame:
    """Totals by status and flagged ones, in one pass."""
    s = F.col("status")
    return articles.agg(F.count("*").alias("total"), *[F.count_if(s == x).alias(x) for x in ("pending", "in_progress", "translated", "skipped")], F.count_if((s == "translated") & (F.size("flags") > 0)).alias("flagged"))


def site_stats(articles: DataFrame, translations: DataFrame) -> DataFrame:
    """Articles, translation rows (not articles translated), and their difference."""
    a = articles.agg(F.count("*").alias("total"))
    t = translations.where(F.col("status").isin("translated", "reviewed")).agg(F.count("*").alias("translated"))
    return a.join(F.broadcast(t), F.lit(True)).withColumn("pending", F.col("total") - F.col("translated"))  # one row each


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * done / total)).otherwise(0).cast("long")


def next_in_queue(df: DataFrame, status: str, created: str, key: str, first: str = "in_progress", then: str = "pending") -> DataFrame:
    """The oldest row in progress, else the oldest pending one; ties by key."""
    s = F.col(status)
    return df.where(s.isin(first, then)).orderBy(F.when(s == first, 0).otherwise(1), created, key).limit(1)


def page(df: DataFrame, order: str, number: int, size: int = 10, partition: str | None = None) -> DataFrame:
    """Rows of page `number` from 0 (of each partition, if one is given), counted in order of `order`;
    gaps in it don't matter, rows that tie keep the order of the input. Rows are numbered by all tasks."""
    (at,) = free(df, "at")
    counted = numbered(df, [order], [partition] if partition else [], at)
    return counted.where((F.col(at) >= number * size) & (F.col(at) < (number + 1) * size)).drop(at)


def page_total(df: DataFrame, partition: str, size: int = 10) -> DataFrame:
    """(partition, total): number of pages."""
    return df.groupBy(partition).agg(F.ceil(F.count("*") / size).alias("total"))


def translations_for_review(articles: DataFrame, translations: DataFrame, lang: str = "fr", key: str = "id") -> DataFrame:
    """Articles beside their translation into one language, for those that have one."""
    own = translations.where(F.col("target_language") == lang)
    return articles.join(own.withColumnRenamed("article_id", key), key)


def running_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "running")


def recent_jobs(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """The latest jobs by creation, ties by id."""
    return jobs.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(limit)


def latest_events(events: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts", "event_id"), limit: int = 50) -> DataFrame:
    """The newest `limit` events of each job; a job with any number of events is numbered by all tasks."""
    (at,) = free(events, "at")
    return numbered(events, [F.col(c).desc() for c in order], [key], at).where(F.col(at) < limit).drop(at)


def split_by_presence(df: DataFrame, other: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in other, and rows whose key is not."""
    return df.join(other, key, "left_semi"), df.join(other, key, "left_anti")


def job_to_show(jobs: DataFrame) -> DataFrame:
    """The running job, else the latest."""
    return jobs.orderBy(F.when(F.col("status") == "running", 0).otherwise(1), F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(1)


def session_state_all(df: DataFrame) -> DataFrame:
    """Every session's row, with defaults for what is null."""
    return df.withColumns({"articles_processed_count": F.coalesce("articles_processed_count", F.lit(0)), "human_review_interval": F.coalesce("human_review_interval", F.lit(5))})


def session_state(df: DataFrame) -> DataFrame:
    return df.where("id = 1").select(F.coalesce("articles_processed_count", F.lit(0)).alias("articles_processed_count"), F.coalesce("human_review_interval", F.lit(5)).alias("human_review_interval"), "last_reset_at", "last_reset_date")


def unique_ids(df: DataFrame, id: str, order: str) -> DataFrame:
    """df with repeated ids told apart: the first by `order` stays, the others get -2, -3, ... An id
    with any number of rows is numbered by all tasks."""
    (at,) = free(df, "at")
    n = F.col(at) + 1
    return numbered(df, [order], [id], at).withColumn(id, F.when(n > 1, F.concat_ws("-", id, n.cast("string"))).otherwise(F.col(id))).drop(at)


def page_paths(articles: DataFrame, langs=("fr", "en")) -> DataFrame:
    """A path per article and language."""
    return articles.select("id", F.explode(F.array(*map(F.lit, langs))).alias("lang"))


def preferred(files: DataFrame, key: str = "id", extension: str = "extension") -> DataFrame:
    """One file of each key: text before PDF before HTML."""
    rank = F.when(F.col(extension) == ".txt", 0).when(F.col(extension) == ".pdf", 1).otherwise(2)
    return files.groupBy(key).agg(F.min_by(F.struct(*files.columns), rank).alias("f")).select("f.*")


def attach_captions(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tables and figures with the caption just before them among captions, tables and figures; a
    caption serves once."""
    from pyspark.sql import Window

    own = blocks.where(F.col("block_type").isin("Caption", "Table", "Figure", "Picture"))
    last = F.lag(F.struct("block_type", "text")).over(Window.partitionBy(key).orderBy("pos"))
    return own.withColumn("__last", last).withColumn("caption", F.when(F.col("__last.block_type") == "Caption", F.col("__last.text"))).where("block_type <> 'Caption'").drop("__last")


def with_next(df: DataFrame, group: str, order: str, columns: list[str], name: str = "next", width: int = 50_000) -> DataFrame:
    """df with a struct `name` of the next row's columns in its group, by an integer order.

    Groups of any size spread: windows span `width` values of order, and the first rows of spans,
    one in up to width, are passed on to the span before."""
    from pyspark.sql import Window

    spanned = df.withColumn("__span", F.floor(F.col(order) / width))
    row = F.struct(*columns)
    inner = spanned.withColumn("__next", F.lead(row).over(Window.partitionBy(group, "__span").orderBy(order)))
    firsts = spanned.groupBy(group, "__span").agg(F.min_by(row, order).alias("__first"))
    firsts = firsts.withColumn("__first", F.lead("__first").over(Window.partitionBy(group).orderBy("__span")))
    return inner.join(firsts, [group, "__span"]).withColumn(name, F.coalesce("__next", "__first")).drop("__next", "__first", "__span")
