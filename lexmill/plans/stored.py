"""Registered queries over written tables: buckets, caches, indexes and streams, and their SQL."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions import text as X
from lexmill.operators import classify as C, extraction as E, relational as R, search as I
from lexmill.plans.layout import PARAGRAPHS
from lexmill.plans.tables import articles, translations, TRANSLATIONS
from lexmill.plans.texts import CHUNKS, docs
from lexmill.session import shared_dir, table
from lexmill.sources import readers
from lexmill.sources.chunk_cache import ChunkCache
from lexmill.sources.store import Store, write_json
from lexmill.streaming import jobs as J

THEN = datetime.datetime(2024, 1, 1, 12)


def place(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lexmill-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def store_upsert(spark, sf):
    """Documents in buckets of their ids, changed by the labels: known ones take the label's quality."""
    store = Store(spark, place(spark, "upsert"))
    base = docs(spark, sf).select("doc_id", "source", F.lit(None).cast("int").alias("quality"))
    store.upsert("articles", base, ["doc_id"])
    change = table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("doc_id"), F.lit("label").alias("source"), F.col("quality").cast("int").alias("quality"))
    store.upsert("articles", change, ["doc_id"], updated=["quality"])
    return store.read("articles")


UPSERTED = """WITH l AS (SELECT doc_id * 2 AS doc_id, any_value(quality) AS quality FROM labels GROUP BY 1)
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'label' ELSE source END AS source, quality::INTEGER AS quality FROM documents d FULL JOIN l ON d.doc_id = l.doc_id"""


def polled_events(spark, sf):
    """The newest event of each user, kept up to date in a store by a stream over the events' file that
    takes what there is and stops."""
    root = place(spark, "polled")
    store = Store(spark, f"{root}/store")
    shape = table(spark, sf, "events").schema
    stream = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf).select("user_id", "event_id", "event_type")
    J.poll(stream, store, "users", ["user_id"], f"{root}/checkpoint", order="event_id").awaitTermination()
    return store.read("users")


def cached_chunks(spark, sf):
    """Chunks by way of the cache: half of the texts first, then all, when only the others are chunked;
    expired entries are dropped."""
    cache = ChunkCache(Store(spark, place(spark, "chunks")), delimiter="\n", split=False)
    d = docs(spark, sf)
    cache.refresh(d.where("doc_id % 2 = 0"), THEN)
    got = cache.chunks(d, THEN + datetime.timedelta(minutes=30))
    return got.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "n_paragraphs", X.count_words(F.col("chunk")).alias("n_words"), F.md5("chunk").alias("digest"))


def search_by_index(spark, sf):
    """The rows of a scan, by an index of trigrams."""
    a, path = articles(spark, sf), place(spark, "grams")
    I.build_index(a, "id", ["text", "category"], path)
    return I.search(a, path, "the and", "id", ["text", "category"]).select("id")


def index_grams(spark, sf):
    """How many documents hold each trigram of their texts."""
    return docs(spark, sf).select("doc_id", F.explode(I.grams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def chunk_answers(spark, sf):
    """Answers for chunks: delivered ones, the completion after the last, a document without a usable
    text and one that isn't there."""
    d = docs(spark, sf).withColumns({"extraction_method": F.lit("html"), "extraction_problems": F.when(F.length("text") < 150, F.array(F.lit("UNUSABLE"))).otherwise(F.array().cast("array<string>"))})
    c, out = E.chunks(docs(spark, sf), delimiter="\n", split=False), None
    for doc, number in ASKED:
        one = E.deliver(d, c, doc, number).select("doc_id", "error", "chunk_no", F.md5("chunk").alias("digest"), "total_chunks", "complete", "extraction_method", "next_step")
        out = one if out is None else out.union(one)
    return out


ASKED = ((1, 0), (2, 1), (4, 2), (5, 99), (-7, 1), *((i, 1) for i in range(20, 40)))
ANSWERS = f"""WITH p AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM {PARAGRAPHS}),
c AS (SELECT doc_id, i // 4 + 1 AS chunk_no, md5(string_agg(t, chr(10) ORDER BY i)) AS digest FROM p GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1),
a(doc_id, k) AS (VALUES {', '.join(f'({i}, {max(1, k)})' for i, k in ASKED)}),
b AS (SELECT a.doc_id, k, d.doc_id IS NOT NULL AS there, d.doc_id IS NOT NULL AND coalesce(length(text) < 150, false) AS bad FROM a LEFT JOIN documents d ON d.doc_id = a.doc_id)
SELECT b.doc_id::BIGINT AS doc_id, CASE WHEN NOT there THEN 'ARTICLE_NOT_FOUND' WHEN bad THEN 'EXTRACTION_FAILED' END AS error, CASE WHEN digest IS NOT NULL AND NOT bad THEN k END::BIGINT AS chunk_no,
  CASE WHEN NOT bad THEN digest END AS digest, coalesce(n, 0)::BIGINT AS total_chunks, there AND NOT bad AND digest IS NULL AS complete, CASE WHEN there THEN 'html' END AS extraction_method,
  CASE WHEN NOT there THEN 'get_next_article' WHEN bad THEN 'skip_article' WHEN digest IS NULL THEN 'validate_classification' ELSE 'get_chunk' END AS next_step
FROM b LEFT JOIN c ON c.doc_id = b.doc_id AND c.chunk_no = b.k LEFT JOIN n ON n.doc_id = b.doc_id"""


def review_side_by_side(spark, sf):
    """Articles beside their French translation."""
    both = R.translations_for_review(articles(spark, sf).drop("status"), translations(spark, sf))
    return both.select("id", F.md5("text").alias("source"), F.md5("translated_title").alias("target"), "target_language")


def job_reads(spark, sf):
    """Jobs as the site reads them: those that run, the latest ones, and the newest events of each."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "job_id")
    jobs = e.groupBy(F.col("job_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("last"), F.min("event_id").alias("created_at"))
    jobs = jobs.withColumn("status", F.when(F.col("last") == "view", "running").otherwise("completed"))
    newest = R.latest_events(e, limit=3).select(F.lit("event").alias("kind"), F.col("job_id").alias("id"), "event_id")
    running = R.running_jobs(jobs).select(F.lit("running").alias("kind"), "id", F.col("created_at").alias("event_id"))
    return newest.union(running).union(R.recent_jobs(jobs).select(F.lit("recent").alias("kind"), "id", F.col("created_at").alias("event_id")))


JOB_READS = """WITH j AS (SELECT user_id AS id, arg_max(event_type, event_id) AS last, min(event_id) AS created_at FROM events GROUP BY 1)
SELECT 'event' AS kind, user_id AS id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3
UNION ALL SELECT 'running', id, created_at FROM j WHERE last = 'view'
UNION ALL SELECT * FROM (SELECT 'recent', id, created_at FROM j ORDER BY created_at DESC, id DESC LIMIT 10)"""

def json_round_trip(spark, sf):
    """Documents written as JSON files and read back."""
    path = place(spark, "json")
    d = docs(spark, sf).select("doc_id", "source", "lang", "text")
    write_json(d, path)
    return spark.read.schema(d.schema).json(path).select("doc_id", "source", "lang", F.md5("text").alias("digest"))


def tolerant_flag_lists(spark, sf):
    """Lists out of a JSON column, in which some rows hold other text: flags of labelled documents, the
    texts of the others."""
    d, labelled = docs(spark, sf), table(spark, sf, "labels").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    flags = F.when(F.col("toxic").isNotNull(), F.to_json(F.array("source", "lang"))).otherwise(F.col("text"))
    found = X.tolerant_flags(flags)
    return d.join(labelled, "doc_id", "left").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("flags"))


TYPES = {"empirical": {"en": ["The "], "fr": ["Les ", "une "]}, "synthesis": ["und "], "theoretical": None, "other": ["el "]}


def methods_of_texts(spark, sf):
    """The first method of a file's mapping of which a text holds a pattern."""
    return docs(spark, sf).select("doc_id", C.method_of(F.col("text"), readers.type_methods(TYPES)).alias("method"))


METHODS_SQL = """SELECT doc_id, CASE WHEN contains(t, 'the ') OR contains(t, 'les ') OR contains(t, 'une ') THEN 'empirical' WHEN contains(t, 'und ') THEN 'synthesis' WHEN contains(t, 'el ') THEN 'other' END AS method FROM (SELECT doc_id, lower(text) AS t FROM documents)"""

QUERIES = {
    "json_round_trip": (json_round_trip, "SELECT doc_id, source, lang, md5(text) AS digest FROM documents"),
    "tolerant_flag_lists": (tolerant_flag_lists, "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL) THEN 2 ELSE 0 END::BIGINT AS n, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL) THEN source || '|' || lang ELSE '' END AS flags FROM documents"),
    "methods_of_texts": (methods_of_texts, METHODS_SQL),
    "store_upsert": (store_upsert, UPSERTED),
    "polled_events": (polled_events, "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1"),
    "cached_chunks": (cached_chunks, CHUNKS),
    "search_by_index": (search_by_index, "SELECT doc_id AS id FROM documents WHERE text ILIKE '%the and%' OR source ILIKE '%the and%'"),
    "index_grams": (index_grams, "SELECT gram, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i, 3)))) AS gram FROM documents) GROUP BY 1"),
    "chunk_answers": (chunk_answers, ANSWERS),
    "review_side_by_side": (review_side_by_side, f"WITH {TRANSLATIONS} SELECT doc_id AS id, md5(text) AS source, md5(translated_title) AS target, target_language FROM documents JOIN translations ON article_id = doc_id WHERE target_language = 'fr'"),
    "job_reads": (job_reads, JOB_READS),
}
