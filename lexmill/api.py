"""The tool surface: one method per task, over named tables, each a thin call of the operators.

Tables are DataFrames by name: articles, translations, article_categories, keywords,
article_keywords, tokens, session, texts(doc_id, text), blocks, parsed, paragraphs, fixes, gate.
Methods that change tables replace them here; `commit` publishes all of them at once."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import vocabulary as V
from lexmill.operators import blocks as B, classify as C, extraction as E, glossary as G, quality as Q, relational as R
from lexmill.operators.lemmas import Lemmas
from lexmill.sources import readers, store as S
from lexmill.streaming import jobs as J


class Workbench:
    def __init__(self, tables: dict[str, DataFrame], glossary: DataFrame | None = None, now: Column | None = None, lemmas: Lemmas | None = None) -> None:
        """glossary is an index of terms (glossary.index), lemmas the model that content words are compared by."""
        self.tables, self.glossary, self.lemmas = dict(tables), glossary, lemmas
        self._now = now

    @property
    def now(self) -> Column:
        """The time of a call, the same whenever its tables are computed."""
        return self._now if self._now is not None else F.lit(datetime.datetime.now(datetime.timezone.utc))

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def commit(self, store: S.Store) -> None:
        store.publish(self.tables)

    # Queue and session.
    def get_next_article(self) -> DataFrame:
        """The claimed article, with `outcome`: ok, SESSION_PAUSE (nothing is claimed) or COMPLETE;
        `progress`, counts by status; and `articles_processed` of the session."""
        now = self.now
        self.tables["session"] = J.session_limit(self["session"], F.to_date(now)).select(*self["session"].columns)
        limit = F.col("articles_processed_count") >= F.col("human_review_interval")
        state = self["session"].select(limit.alias("limit_reached"), F.col("articles_processed_count").alias("articles_processed"))
        # One row: an article only while the session is open.
        found = R.next_in_queue(self["articles"], "processing_status", "created_at", "id").join(state.where(~F.col("limit_reached")).select(), how="left_semi")
        self.tables["articles"] = S.claim_next(self["articles"], found)
        progress = self.get_progress().agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("progress"))
        outcome = F.when(F.col("limit_reached"), "SESSION_PAUSE").when(F.col("id").isNull(), "COMPLETE").otherwise("ok")
        return state.join(found, F.lit(True), "left").join(progress, F.lit(True)).withColumn("outcome", outcome).drop("limit_reached")  # one row each

    def get_taxonomy(self) -> dict[str, DataFrame]:
        return C.taxonomy(self["articles"].sparkSession)

    def get_progress(self) -> DataFrame:
        return R.status_counts(self["articles"], "processing_status")

    def skip_article(self, key, code: str, notes: str | None = None) -> None:
        if code not in V.FLAG_CODES:
            raise ValueError(f"unknown flag code: {code}")
        self.tables["articles"] = S.mark_skipped(self["articles"], key, code, notes, self.now)

    def set_human_review_interval(self, n: int) -> None:
        self.tables["session"] = S.session_interval(self["session"], n)

    def reset_session_counter(self) -> None:
        self.tables["session"] = S.session_reset(self["session"], self.now)

    # Chunks, classification, saving.
    def get_chunk(self, key, number: int) -> DataFrame:
        """One chunk with its glossary terms."""
        chunk = E.deliver_chunk(E.chunks(self["texts"].where(F.col("doc_id") == key)), key, number)
        if self.glossary is None:
            return chunk
        terms = G.find_terms(chunk, self.glossary, text="chunk").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("en", "fr"))).alias("terms"))
        return chunk.join(terms, "doc_id", "left")

    def validate_classification(self, rows: DataFrame) -> DataFrame:
        return C.validate(rows)

    def save_article(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """Decisions for rows (see classify.gate, without its flag columns) whose texts are in
        pairs(article_id, source_text, target_text); with a glossary, its terms found in a source are looked
        for in the target, by lemma and as they are, with their alternatives. Accepted rows go into all tables at once:
        article, translation (columns translated_title, -_summary and -_full_text), categories,
        keywords, the token used (column token) and the session's counter, which rises by their
        number. Rejected rows change nothing."""
        terms = None
        if self.glossary is not None:
            terms = "terms"
            found = G.terms_by_text(pairs.select("article_id", "source_text"), self.glossary, "article_id", "source_text")
            pairs = G.with_terms(pairs, found, "article_id")
        checked = Q.check_pairs(pairs, terms=terms, lemmas=self.lemmas).select("article_id", "blocking_flags", "warning_flags")
        none = F.array().cast("array<string>")
        joined = rows.join(checked, "article_id", "left").withColumns({c: F.coalesce(c, none) for c in ("blocking_flags", "warning_flags")})
        decided, now = C.gate(joined), self.now
        good = decided.where("decision = 'accepted'")
        codes = F.concat(F.transform("flags", lambda f: f.code), F.when(C.is_checked(), F.col("warning_flags")).otherwise(none))
        more = [c for c in ("source", "extraction_method", "extraction_problems", "glossary_version") if c in rows.columns]
        done = good.select(F.col("article_id").alias("id"), "method", "voice", "peer_reviewed", codes.alias("processing_flags"), F.col("notes").alias("processing_notes"), *more)
        self.tables["articles"] = S.mark_translated(self["articles"], done, now)
        texts = [c for c in ("translated_title", "translated_summary", "translated_full_text") if c in rows.columns]
        if "translations" in self.tables and texts:
            new = good.select("article_id", F.lit("fr").alias("target_language"), *texts, F.lit("translated").alias("status"), now.alias("updated_at"))
            new = new.select(*[c for c in new.columns if c in self["translations"].columns])
            self.tables["translations"] = S.upsert(self["translations"], new, ["article_id", "target_language"], [c for c in new.columns if c not in ("article_id", "target_language")])
        if "tokens" in self.tables and "token" in rows.columns:
            self.tables["tokens"] = S.mark_tokens_used(self["tokens"], good)
        if "article_categories" in self.tables:
            self.tables["article_categories"] = S.replace_children(self["article_categories"], S.category_rows(good), "article_id")
        if "keywords" in self.tables:
            self.tables["keywords"], self.tables["article_keywords"] = S.replace_keywords(self["keywords"], self["article_keywords"], good.select("article_id", F.explode("keywords").alias("keyword")))
        if "session" in self.tables:
            self.tables["session"] = S.session_increment(self["session"], good.count())
        return decided.select("article_id", "decision", "notes")

    # Intake.
    def ingest_article(self, rows: DataFrame) -> None:
        """Rows with an id that is not yet known."""
        self.tables["articles"] = S.insert_new(self["articles"], rows, "id")

    def search_article_url(self, query: str) -> DataFrame:
        return R.search(self["articles"], query, ["source_title"])

    def set_article_url(self, key, url: str) -> None:
        self.tables["articles"] = S.set_url(self["articles"], key, url)

    def list_intake(self, found: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Files (see readers.files) not yet extracted, and those that are."""
        known, fresh = R.split_by_presence(found, done.select("slug"), "slug")
        return fresh, known

    def list_raw_outputs(self, path: str) -> DataFrame:
        return readers.files(self["articles"].sparkSession, path, "*.json")

    def find_file(self, files: DataFrame, query: str) -> DataFrame:
        return R.find_by_words(files, query)

    def parse_blocks(self, blocks: DataFrame) -> DataFrame:
        self.tables["blocks"], self.tables["parsed"] = blocks, B.parse_documents(blocks)
        return self["parsed"]

    # Review.
    def get_article_for_review(self, key) -> DataFrame:
        return B.raw_review_blocks(self["blocks"].where(F.col("doc_id") == key))

    def complete_article_review(self, rows: DataFrame) -> DataFrame:
        """rows with errors of the review; none means complete."""
        columns = ("title", "authors", "year", "method", "voice", "abstract", "abstract_confirmed")
        return rows.withColumn("errors", C.review_errors(*map(F.col, columns)))

    def get_body_for_review(self, key, number: int = 0) -> DataFrame:
        """A page of ten paragraphs, with `total` pages; a number beyond them is an error."""
        own = B.review(self["paragraphs"].where(F.col("doc_id") == key))
        total = -(-own.count() // 10)
        if not 0 <= number < max(1, total):
            raise ValueError(f"INVALID_CHUNK: {number} of {total}")
        return R.page(own, "pos", number, partition="doc_id").withColumn("total", F.lit(total))

    def complete_body_review(self, fixes: DataFrame, acknowledged: DataFrame) -> DataFrame:
        """Flagged paragraphs left; if there are none, fixes are applied."""
        left = B.unaddressed(B.review(self["paragraphs"]), fixes, acknowledged)
        if left.isEmpty():
            self.tables["paragraphs"] = B.apply_fixes(self["paragraphs"], fixes)
        return left

    def get_preprocessing_status(self) -> DataFrame:
        return self["parsed"].groupBy("stage").agg(F.count("*").alias("n"))

    # The gate: checks show, confirmations record; see streaming.jobs.review_gate.
    def check_fields(self) -> DataFrame:
        return C.field_statuses(self["parsed"], "doc_id")

    def confirm_fields(self, overrides: DataFrame) -> DataFrame:
        self.tables["parsed"] = (out := B.confirm_fields(self["parsed"], overrides)).drop("error")
        return out.select("doc_id", "error").where("error is not null")

    def check_warnings(self) -> DataFrame:
        return B.warnings_for_review(self["parsed"], B.review(self["paragraphs"]))

    def check_references(self) -> DataFrame:
        empty = self["parsed"].where(F.size("references") == 0).select("doc_id")
        return B.reference_hints(self["blocks"].join(empty, "doc_id", "left_semi"))

    def confirm_references(self, more: DataFrame) -> None:
        """more(doc_id, additional)."""
        j = self["parsed"].join(more, "doc_id", "left")
        self.tables["parsed"] = j.withColumn("references", B.append_references(F.col("references"), F.col("additional"))).drop("additional")

    def check_formulas(self) -> DataFrame:
        return B.unwrapped_formulas(self["paragraphs"])

    def confirm_formulas(self, wraps: DataFrame) -> None:
        """wraps(doc_id, pos, formula)."""
        j = self["paragraphs"].join(wraps, ["doc_id", "pos"], "left")
        self.tables["paragraphs"] = j.withColumn("text", F.when(F.col("formula").isNotNull(), B.wrap_formula(F.col("text"), F.col("formula"))).otherwise(F.col("text"))).drop("formula")

    def gate_outcomes(self) -> DataFrame:
        """Check, confirm, complete and reset events of gate(doc_id, seq, event, ok), judged."""
        return J.review_gate(self["gate"])

    def publish_parsed(self, keys: DataFrame) -> None:
        """Documents of keys go from the cache to ready."""
        self.tables["parsed"] = S.move_stage(self["parsed"], keys, "doc_id", "cache", "ready")
