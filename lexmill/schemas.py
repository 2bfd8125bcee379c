"""Schemas of the article tables, and creation and migration of a store of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.sources import store as S

TABLES = {
    "categories": "id string, label_fr string, label_en string, description string, url_slug string, priority int",
    "articles": "id string, source_language string, source_title string, source_url string, authors string, year string, journal string, doi string, citation string, abstract string, body_html string, raw_html string, acknowledgements string, references array<string>, open_access boolean, peer_reviewed boolean, method string, voice string, source string, processing_status string, created_at timestamp, updated_at timestamp",
    "article_categories": "article_id string, category_id string, is_primary int",
    "keywords": "id long, keyword string",
    "article_keywords": "article_id string, keyword_id long",
    "translations": "id long, article_id string, target_language string, translated_title string, translated_summary string, translated_full_text string, status string, translator_notes string, created_at timestamp, updated_at timestamp",
    "session_state": "id int, articles_processed_count int, human_review_interval int, last_reset_at timestamp, last_reset_date date",
    "validation_tokens": "token string, article_id string, classification_data string, created_at timestamp, used int",
    "batch_jobs": "id string, job_type string, status string, target_count int, processed_count int, current_article string, started_at timestamp, completed_at timestamp, pid long, error_message string, log_path string, created_at timestamp",
    "batch_job_events": "id long, job_id string, event_type string, article_slug string, message string, timestamp timestamp",
}
#: Columns that came later, with their defaults.
ADDED = {
    "articles": {
        "extraction_method": "cast(null as string)", "extraction_problems": "cast(array() as array<string>)", "glossary_version": "cast(null as string)",
        "processing_flags": "cast(array() as array<string>)", "processing_notes": "cast(null as string)", "processed_at": "cast(null as timestamp)", "summary_original": "cast(null as string)",
    },
}


def migrate(name: str, df: DataFrame) -> DataFrame:
    """df with columns of its table that it lacks; running it again changes nothing."""
    return S.migrate(df, {c: F.expr(e) for c, e in ADDED.get(name, {}).items()})


def empty(spark: SparkSession, name: str) -> DataFrame:
    df = spark.createDataFrame([], TABLES[name])
    return migrate(name, spark.createDataFrame([(1, 0, 5, None, None)], TABLES[name]) if name == "session_state" else df)


def create(store: S.Store) -> None:
    """All tables that the store lacks."""
    known = store.manifest()
    missing = {name: empty(store.spark, name) for name in TABLES if name not in known}
    if missing:
        store.publish(missing)
