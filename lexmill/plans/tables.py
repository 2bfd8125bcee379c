"""Registered queries over tables of articles, jobs and events, and their SQL.

Articles are documents with their labels: quality 1 is translated, quality 0 skipped, no label
pending; toxic ones carry a flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions import text as X, vocabulary as V
from lexmill.operators import numbering as N, relational as R
from lexmill.sources import store as S
from lexmill.session import table
from lexmill.streaming import jobs as J

ARTICLES = """articles AS (SELECT d.doc_id AS id, d.source AS category, d.lang, d.text, d.n_chars, l.quality, l.toxic,
  CASE WHEN quality = 1 THEN 'translated' WHEN quality = 0 THEN 'skipped' ELSE 'pending' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def articles(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    status = F.when(F.col("quality") == 1, "translated").when(F.col("quality") == 0, "skipped").otherwise("pending")
    flags = F.when(F.col("toxic") == 1, F.array(F.lit("QUALITY"))).otherwise(F.array().cast("array<string>"))
    j = d.join(l, "doc_id", "left")
    return j.select(F.col("doc_id").alias("id"), F.col("source").alias("category"), "lang", "text", "n_chars", "quality", "toxic", status.alias("status"), status.alias("processing_status"), flags.alias("flags"), flags.alias("processing_flags"), F.when(F.col("quality").isNotNull(), F.col("n_chars")).alias("processed_at"), F.left("text", F.lit(60)).alias("source_title"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("https://x/"), F.col("doc_id").cast("string"))).alias("source_url"))


def status_progress(spark, sf):
    return R.status_counts(articles(spark, sf))


STATUS = f"""WITH {ARTICLES}, s(status) AS (VALUES {', '.join(f"('{x}')" for x in V.STATUSES)})
SELECT s.status, count(a.id) AS n FROM s LEFT JOIN articles a ON a.status = s.status GROUP BY 1"""


def progress_roll_up(spark, sf):
    counts = R.status_counts(articles(spark, sf))
    return R.roll_up(counts, 3, 5).withColumn("remaining", F.col("remaining").cast("long"))


def progress_percent(spark, sf):
    a = articles(spark, sf).agg(F.count_if(F.col("status") == "translated").alias("done"), F.count("*").alias("total"))
    return a.select(R.percent(F.col("done"), F.col("total")).alias("percent"))


def admin_stats(spark, sf):
    return R.admin_stats(articles(spark, sf))


def flagged_recent(spark, sf):
    return R.flagged(articles(spark, sf)).select("id", "processed_at")


def recently_completed(spark, sf):
    return R.recently_completed(articles(spark, sf)).select("id", "status", "processed_at")


def admin_filter(spark, sf):
    return R.admin_listing(articles(spark, sf), status="translated", has_flags=False, missing_url=True).select("id", "category")


def search_documents(spark, sf):
    return R.search(articles(spark, sf), "the and", ["text", "category"]).select("id")


def with_label(how: str):
    return lambda spark, sf: table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", how)


def presence(which: int):
    return lambda spark, sf: R.split_by_presence(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")[which]


def queue_next(spark, sf):
    o = table(spark, sf, "orders")
    return R.next_in_queue(o, "o_orderstatus", "o_orderdate", "o_orderkey", "P", "O").select("o_orderkey", "o_orderstatus")


def translations(spark, sf) -> DataFrame:
    """Assistant turns as translations of the user's turns."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select(F.col("conv_id").alias("article_id"), F.when(F.col("turn") % 4 == 1, "fr").otherwise("en").alias("target_language"), F.col("text").alias("translated_title"), F.lit("").alias("translated_summary"), F.lit("translated").alias("status"), "turn").groupBy("article_id", "target_language").agg(*[F.min_by(x, "turn").alias(x) for x in ("translated_title", "translated_summary", "status")])


TRANSLATIONS = """translations AS (SELECT conv_id AS article_id, CASE WHEN turn % 4 = 1 THEN 'fr' ELSE 'en' END AS target_language,
  arg_min(text, turn) AS translated_title FROM conversations WHERE role = 'assistant' GROUP BY 1, 2)"""


def links(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("article_id"), F.col("source").alias("category_id"), (F.col("doc_id") % 2).cast("int").alias("is_primary"))


def article_with_translation(spark, sf):
    a = articles(spark, sf).select("id", "lang")
    j = R.with_translation(a, translations(spark, sf), links(spark, sf))
    return j.select("id", "category_id", F.md5("translated_title").alias("title"), R.localized(F.lit("fr"), F.col("translated_title"), F.col("lang")).alias("shown"))


WITH_TRANSLATION = f"""WITH {TRANSLATIONS} SELECT d.doc_id AS id, CASE WHEN d.doc_id % 2 = 1 THEN d.source END AS category_id, md5(t.translated_title) AS title,
  CASE WHEN length(coalesce(nullif(t.translated_title, ''), d.lang)) > 200 THEN left(coalesce(nullif(t.translated_title, ''), d.lang), 200) || '...' ELSE coalesce(nullif(t.translated_title, ''), d.lang) END AS shown
FROM documents d LEFT JOIN translations t ON t.article_id = d.doc_id AND t.target_language = 'fr'"""


def articles_by_category(spark, sf):
    a = articles(spark, sf).select("id", F.col("n_chars").cast("string").alias("year"))
    return R.by_category(a, links(spark, sf), translations(spark, sf), "src3").select("id", "year", F.md5("translated_title").alias("title"))


def translated_articles(spark, sf):
    a = articles(spark, sf).select("id", F.col("n_chars").cast("string").alias("year"))
    return R.translated(a, translations(spark, sf), links(spark, sf)).select("id", "year", "category_id")


def site_stats(spark, sf):
    return R.site_stats(articles(spark, sf), translations(spark, sf))


def page_paths(spark, sf):
    return R.page_paths(articles(spark, sf)).groupBy("lang").agg(F.count("*").alias("n"))


def line_page(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return R.page(lines, "pos", 1, partition="doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("digest"))


def documents_page(spark, sf):
    """The fourth page of a hundred documents, the longest first, numbered over the whole table."""
    d = table(spark, sf, "documents").select("doc_id", (-F.col("n_chars")).alias("shorter"))
    return N.numbered(d, ["shorter", "doc_id"], name="n", total="total").where("n between 300 and 399")


def documents_in_source(spark, sf):
    """Each document's number in its source, the longest first, and the source's documents."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return N.numbered(d, [F.col("n_chars").desc(), "doc_id"], ["source"], "n", "total").select("doc_id", "n", "total")


def characters_before(spark, sf):
    """Characters of all documents up to and with each, in order of ids."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return N.running_sum(d, "n_chars", ["doc_id"], "characters").select("doc_id", "characters")


def caption_asof(spark, sf):
    """Events as blocks: views are captions, purchases tables, signups figures."""
    e = table(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for kv in {"view": "Caption", "purchase": "Table", "signup": "Figure"}.items() for x in kv])[F.col("event_type")]
    b = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), kind.alias("block_type"), F.col("event_id").cast("string").alias("text")).where("block_type is not null")
    return R.attach_captions(b).select("doc_id", "pos", "block_type", "caption")


CAPTIONS = """WITH b AS (SELECT user_id AS doc_id, event_id AS pos, CASE event_type WHEN 'view' THEN 'Caption' WHEN 'purchase' THEN 'Table' WHEN 'signup' THEN 'Figure' END AS block_type FROM events),
l AS (SELECT *, lag(block_type) OVER w AS pt, lag(pos) OVER w AS pp FROM b WHERE block_type IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, block_type, CASE WHEN pt = 'Caption' THEN pp::VARCHAR END AS caption FROM l WHERE block_type <> 'Caption'"""


def job_events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for kv in {"view": "start", "click": "complete", "error": "error", "purchase": "batch_complete", "signup": "cancel"}.items() for x in kv])[F.col("event_type")]
    return e.select(F.col("user_id").alias("job_id"), "event_id", "ts", kind.alias("event_type"), F.col("event_id").cast("string").alias("slug"))


def job_state_from_events(spark, sf):
    return J.job_state(job_events(spark, sf))


JOB_STATE = """SELECT user_id AS job_id, count(*) FILTER (event_type = 'click') AS processed, count(*) FILTER (event_type = 'error') AS errors,
  CASE WHEN count(*) FILTER (event_type IN ('purchase', 'signup')) > 0 THEN CASE arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('purchase', 'signup')) WHEN 'purchase' THEN 'completed' ELSE 'cancelled' END
  WHEN count(*) FILTER (event_type IN ('view', 'click', 'error')) > 0 THEN 'running' ELSE 'pending' END AS status,
  arg_max(event_id, (ts, event_id)) FILTER (event_type = 'view')::VARCHAR AS last_slug FROM events GROUP BY 1"""


def session_pause_days(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return J.session_pauses(e, "user_id", "ts", "event_id", interval=2).where("pause").select("user_id", "event_id", "number_today")


PAUSES = """SELECT user_id, event_id, n AS number_today FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n % 2 = 0"""


def upsert_translations(spark, sf):
    """Turns of a conversation by role: the latest of turns 0, 1, 4, 5, 8, ... are the table, that of
    the other turns the upsert."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("article_id"), F.col("role").alias("target_language"), F.md5("text").alias("title"), "turn")
    last = lambda rows, status: rows.groupBy("article_id", "target_language").agg(F.max_by("title", "turn").alias("title"), F.max("turn").alias("created")).withColumn("status", F.lit(status))
    columns = ["article_id", "target_language", "title", "status", "created"]
    old, new = last(c.where("turn % 4 < 2"), "old").select(*columns), last(c.where("turn % 4 >= 2"), "new").select(*columns)
    return S.upsert(old, new, ["article_id", "target_language"], ["title", "status"])


UPSERT = """WITH c AS (SELECT conv_id AS article_id, role AS target_language, md5(text) AS title, turn FROM conversations),
o AS (SELECT article_id, target_language, arg_max(title, turn) AS title, max(turn) AS turn FROM c WHERE turn % 4 < 2 GROUP BY 1, 2),
n AS (SELECT article_id, target_language, arg_max(title, turn) AS title, max(turn) AS turn FROM c WHERE turn % 4 >= 2 GROUP BY 1, 2)
SELECT article_id, target_language, coalesce(n.title, o.title) AS title, CASE WHEN n.turn IS NOT NULL THEN 'new' ELSE 'old' END AS status, coalesce(o.turn, n.turn) AS created FROM o FULL JOIN n USING (article_id, target_language)"""


def replace_categories(spark, sf):
    old = links(spark, sf)
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("article_id"), F.col("quality").cast("string").alias("primary_category"), F.array(F.col("toxic").cast("string")).alias("secondary_categories"))
    return S.replace_children(old, S.category_rows(rows), "article_id")


REPLACE = """SELECT doc_id AS article_id, source AS category_id, (doc_id % 2)::INT AS is_primary FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, quality::VARCHAR, 1 FROM labels UNION ALL SELECT doc_id, toxic::VARCHAR, 0 FROM labels"""


def insert_new_articles(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    rows = table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("id"), F.lit("new").alias("source"))
    return S.insert_new(a, rows, "id")


INSERT = """SELECT doc_id AS id, source FROM documents UNION ALL SELECT doc_id * 2, 'new' FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)"""


def keyword_dictionary(spark, sf):
    """Keywords by number of articles: first those of every document, its first word, and then those of
    labelled documents are replaced by all their words."""
    d = table(spark, sf, "documents")
    words = lambda df, c: df.select(F.col("doc_id").alias("article_id"), F.explode(F.array_distinct(c)).alias("keyword"))
    own = F.transform(F.coalesce(X.words(F.col("text")), F.array().cast("array<string>")), lambda w: F.lower(w))
    empty = spark.createDataFrame([], "id long, keyword string"), spark.createDataFrame([], "article_id long, keyword_id long")
    known, links = S.replace_keywords(*empty, words(d, F.slice(own, 1, 1)))
    known, links = S.replace_keywords(known, links, words(R.split_by_presence(d, table(spark, sf, "labels"), "doc_id")[0], own))
    return links.join(known, links.keyword_id == known.id).groupBy("keyword").agg(F.count("*").alias("n"))


KEYWORDS = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, unnest(list_distinct(w)) AS keyword FROM w WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, w[1] FROM w WHERE (doc_id NOT IN (SELECT doc_id FROM labels) OR len(w) = 0) AND len(w) > 0)
SELECT keyword, count(*) AS n FROM k GROUP BY 1"""


def token_cleanup(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("token"), F.col("ts").cast("string").alias("created_at"), (F.col("user_id") % 2).cast("int").alias("used"))
    return S.clean_tokens(e, F.lit("2024-01-02 00:00:00").cast("timestamp")).select("token")


def events_by_window(spark, sf):
    """Extension: counts by hour and type."""
    return J.windowed_counts(table(spark, sf, "events"), size="1 hour").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


def revenue_rollup(spark, sf):
    """Extension: order totals by status and priority with subtotals."""
    o = table(spark, sf, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))


QUERIES = {
    "status_progress_zero_filled": (status_progress, STATUS),
    "progress_roll_up": (progress_roll_up, "SELECT count(*)::BIGINT AS total, 2::BIGINT AS remaining FROM documents"),
    "progress_percent": (progress_percent, f"WITH {ARTICLES} SELECT round(100.0 * count(*) FILTER (status = 'translated') / count(*))::BIGINT AS percent FROM articles"),
    "admin_stats": (admin_stats, f"WITH {ARTICLES} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, 0::BIGINT AS in_progress, count(*) FILTER (status = 'translated') AS translated, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'translated' AND toxic = 1) AS flagged FROM articles"),
    "flagged_recent": (flagged_recent, f"WITH {ARTICLES} SELECT id, n_chars AS processed_at FROM articles WHERE status = 'translated' AND toxic = 1 ORDER BY n_chars DESC NULLS LAST, id LIMIT 20"),
    "recently_completed": (recently_completed, f"WITH {ARTICLES} SELECT id, status, n_chars AS processed_at FROM articles WHERE status <> 'pending' ORDER BY n_chars DESC NULLS LAST, id LIMIT 10"),
    "admin_filter": (admin_filter, f"WITH {ARTICLES} SELECT id, category FROM articles WHERE status = 'translated' AND coalesce(toxic, 0) = 0 AND id % 3 = 0"),
    "search_documents": (search_documents, "SELECT doc_id AS id FROM documents WHERE text ILIKE '%the and%' OR source ILIKE '%the and%'"),
    "docs_with_optional_label": (with_label("left"), "SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"),
    "docs_with_label_inner": (with_label("inner"), "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)"),
    "labelled_docs": (presence(0), "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "unlabelled_docs": (presence(1), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "queue_next": (queue_next, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P', 'O') ORDER BY o_orderstatus <> 'P', o_orderdate, o_orderkey LIMIT 1"),
    "article_with_translation": (article_with_translation, WITH_TRANSLATION),
    "articles_by_category": (articles_by_category, f"WITH {TRANSLATIONS} SELECT d.doc_id AS id, d.n_chars::VARCHAR AS year, md5(t.translated_title) AS title FROM documents d LEFT JOIN translations t ON t.article_id = d.doc_id AND t.target_language = 'fr' WHERE d.source = 'src3'"),
    "translated_articles": (translated_articles, f"WITH {TRANSLATIONS} SELECT d.doc_id AS id, d.n_chars::VARCHAR AS year, CASE WHEN d.doc_id % 2 = 1 THEN d.source END AS category_id FROM documents d JOIN translations t ON t.article_id = d.doc_id AND t.target_language = 'fr'"),
    "site_stats": (site_stats, f"WITH {TRANSLATIONS} SELECT d.n AS total, t.n AS translated, d.n - t.n AS pending FROM (SELECT count(*) AS n FROM documents) d, (SELECT count(*) AS n FROM translations) t"),
    "page_paths": (page_paths, "SELECT unnest(['fr', 'en']) AS lang, count(*) AS n FROM documents GROUP BY 1"),
    "line_page": (line_page, "SELECT doc_id, pos, md5(line) AS digest FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE pos // 10 = 1"),
    "documents_page": (documents_page, "SELECT doc_id, -n_chars AS shorter, row_number() OVER (ORDER BY -n_chars, doc_id) - 1 AS n, count(*) OVER () AS total FROM documents QUALIFY n BETWEEN 300 AND 399"),
    "documents_in_source": (documents_in_source, "SELECT doc_id, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY source) AS total FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)"),
    "characters_before": (characters_before, "SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS characters FROM documents"),
    "caption_asof": (caption_asof, CAPTIONS),
    "job_state_from_events": (job_state_from_events, JOB_STATE),
    "session_pause_days": (session_pause_days, PAUSES),
    "upsert_translations": (upsert_translations, UPSERT),
    "replace_children": (replace_categories, REPLACE),
    "insert_new_articles": (insert_new_articles, INSERT),
    "keyword_dictionary": (keyword_dictionary, KEYWORDS),
    "token_cleanup": (token_cleanup, "SELECT event_id::VARCHAR AS token FROM events WHERE user_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-01 23:00:00'"),
    "events_by_window": (events_by_window, "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "revenue_rollup": (revenue_rollup, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
}
