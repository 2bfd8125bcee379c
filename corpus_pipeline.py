"""A corpus pipeline over documents: language, lines, near copies, mixture, tokens.

Each stage works on all rows of the one before. Defined cases: a row without an id, or with one that
others have, is a document of its own in all stages; a null, blank or letterless text has no language
and goes in the first stage; rows without source or language belong to the value '' of the mixture;
repeated rows are copies, of which the third stage keeps one; texts of any length are taken whole;
an empty table passes through all stages; extra columns are kept, whatever their names (but those
the last stage adds replace columns of their names)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import langid, linedup, mixing, ngram_join, spm
from lexmill.session import ship, stash, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with a score of langid.LEAST at least."""
    ship(spark)
    return langid.filter_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sources share."""
    return linedup.remove_boilerplate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents."""
    ship(spark)
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which source, language and topic have their target weights."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number, and whether they decode to the text and equal those of the
    sentencepiece library; the text has served its purpose."""
    ship(spark)
    return spm.encode_checked(docs).drop("text")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("source_mixing", mixture),
    ("sentencepiece", tokens),
]

#: Language identification is learned and n-gram classes are a transitive closure: no plain SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{name}")
    return docs
