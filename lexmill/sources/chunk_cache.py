"""A table of chunks by the hash of their text: texts that haven't changed are not chunked again.

Entries stand in a bucketed table of a Store, a row a distinct text, with the time they were made. A
refresh makes entries for texts that have none or an expired one, all in one snapshot; a document
whose text changes meets the entry of its new text. Purging drops what has expired."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from lexmill.operators import extraction as E
from lexmill.session import free
from lexmill.sources.store import Store

EXPIRY = datetime.timedelta(hours=1)


class ChunkCache:
    def __init__(self, store: Store, name: str = "chunks", expiry: datetime.timedelta = EXPIRY, **options) -> None:
        """options are those of extraction.chunks; a table holds the chunks of one set of options."""
        self.store, self.name, self.expiry, self.options = store, name, expiry, options

    def _entries(self, now: datetime.datetime) -> DataFrame | None:
        if self.name not in self.store.manifest():
            return None
        return self.store.read(self.name).where(F.col("made_at") > F.lit(now - self.expiry))

    def refresh(self, docs: DataFrame, now: datetime.datetime, text: str = "text") -> int:
        """Make the entries that docs' texts (null: empty) lack; returns the number of texts chunked."""
        told = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
        entries = self._entries(now)
        if entries is not None:
            told = told.join(entries.select("sha"), "sha", "left_anti")
        fresh = told.groupBy("sha").agg(F.min("text").alias("text"))
        parts = E.chunks(fresh, key="sha", **self.options).groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk", "n_paragraphs"))).alias("chunks"))
        # Texts without a paragraph are known to have no chunks.
        made = fresh.select("sha").join(parts, "sha", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(parts.schema["chunks"].dataType)))
        made = made.withColumn("made_at", F.lit(now))
        before = self.store.manifest()
        self.store.upsert(self.name, made, ["sha"], newest_by="made_at")
        if self.store.manifest() == before:
            return 0
        return self.store.read(self.name).where(F.col("made_at") == F.lit(now)).count()

    def chunks(self, docs: DataFrame, now: datetime.datetime, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, chunk_no, chunk, n_paragraphs) of docs, refreshed first."""
        self.refresh(docs, now, text)
        (sha,) = free(docs, "sha")
        own = docs.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias(sha))
        held = self._entries(now).select(F.col("sha").alias(sha), "chunks")
        return own.join(held, sha).select(key, F.explode("chunks").alias("c")).select(key, "c.*")

    def purge(self, now: datetime.datetime) -> int:
        """Drop expired entries; returns the number dropped. Nothing is rewritten if there are none."""
        if self.name not in self.store.manifest():
            return 0
        gone = self.store.read(self.name).where(F.col("made_at") <= F.lit(now - self.expiry)).select("sha")
        n = gone.count()
        if n:
            self.store.delete(self.name, gone, ["sha"])
        return n
