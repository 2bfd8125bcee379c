"""Mutations as transitions DataFrame -> DataFrame, and atomic publication of snapshots.

Parquet tables are not updated in place: each transition returns the table's next state, and
`publish` writes all tables of a change to a new version before one pointer names it. A table in
buckets of its keys is changed by `Store.upsert`, which writes the buckets it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lexmill.functions import text as X
from lexmill.session import free, stash

#: Buckets of a table that changes by upserts: a change rewrites those it touches.
BUCKETS = 64


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of unknown keys are added; of repeated ones the least, compared by all columns in order."""
    return table.unionByName(_one_each(rows, key).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("__r")).select("__r.*")


def insert_status(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, outcome): a row per row: created for one of each unknown key, else DUPLICATE."""
    known = table.select(key).distinct().withColumn("__k", F.lit(True))
    n = rows.groupBy(key).agg(F.count("*").alias("__n")).join(known, key, "left")
    fresh = F.col("__k").isNull()
    repeats = F.array_repeat(F.lit("DUPLICATE"), (F.col("__n") - F.when(fresh, 1).otherwise(0)).cast("int"))
    return n.select(key, F.explode(F.concat(F.when(fresh, F.array(F.lit("created"))).otherwise(F.array().cast("array<string>")), repeats)).alias("outcome"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """table with `updated` columns taken from rows of equal keys (null included); other rows are
    added; other columns of known rows stay."""
    new = rows.select(*keys, *[F.col(c).alias(f"__{c}") for c in rows.columns if c not in keys]).withColumn("__new", F.lit(True))
    old = table.withColumn("__old", F.lit(True))
    j = old.join(new, keys, "full_outer")
    out = []
    for c in table.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in rows.columns:
            out.append(F.col(c))
        elif c in updated:
            out.append(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c))
    return j.select(*out)


def replace_children(table: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in rows are replaced by rows."""
    return table.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows)


def category_rows(articles: DataFrame) -> DataFrame:
    """(article_id, category_id, is_primary) of articles(article_id, primary_category, secondary_categories)."""
    primary = articles.select("article_id", F.col("primary_category").alias("category_id"), F.lit(1).alias("is_primary"))
    second = articles.select("article_id", F.explode("secondary_categories").alias("category_id"), F.lit(0).alias("is_primary"))
    return primary.unionByName(second)


def replace_keywords(keywords: DataFrame, links: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next dictionary(id, keyword) and links(article_id, keyword_id) for rows(article_id, keyword)."""
    fresh = rows.select("keyword").distinct().join(keywords, "keyword", "left_anti").select(F.xxhash64("keyword").alias("id"), "keyword")
    known = keywords.unionByName(fresh)
    own = rows.distinct().join(known, "keyword").select("article_id", F.col("id").alias("keyword_id"))
    return known, replace_children(links, own, "article_id")


def update(table: DataFrame, when: Column, **values) -> DataFrame:
    """table with columns set where `when` holds."""
    hit = F.coalesce(when, F.lit(False))
    return table.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def update_from(table: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with columns set from rows of equal key."""
    new = rows.select(key, *[F.col(c).alias(f"__{c}") for c in columns]).withColumn("__new", F.lit(True))
    j = table.join(new, key, "left")
    return j.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def mark_translated(articles: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """articles with those of rows translated: classification, flags, notes, and, where rows and
    articles have them, source, extraction method and problems, and glossary version."""
    columns = ["method", "voice", "peer_reviewed", "processing_flags", "processing_notes"]
    columns += [c for c in ("source", "extraction_method", "extraction_problems", "glossary_version") if c in rows.columns and c in articles.columns]
    done = update_from(articles, rows, "id", columns)
    hit = F.col("__hit")
    marked = done.join(rows.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return update(marked, hit, processing_status="translated", processed_at=now, updated_at=now).drop("__hit").select(*articles.columns)


def mark_skipped(articles: DataFrame, key, code: str, notes: str | None, now: Column) -> DataFrame:
    return update(articles, F.col("id") == key, processing_status="skipped", processing_flags=F.array(F.lit(code)), processing_notes=F.lit(notes), processed_at=now)


def confirm_url(articles: DataFrame, key, url: str) -> DataFrame:
    """A pending_url article gets a valid URL and is pending; any other case changes nothing."""
    ok = (F.col("id") == key) & (F.col("processing_status") == "pending_url") & F.lit(url).rlike("^https?://")
    return update(articles, ok, source_url=url, processing_status="pending")


def set_url(articles: DataFrame, key, url: str) -> DataFrame:
    """A URL for any status; blank ones clear it and others must be http(s)."""
    value = X.blank_to_null(F.lit(url))
    return update(articles, (F.col("id") == key) & (value.isNull() | value.rlike("^https?://[^ ]+$")), source_url=value)


def claim_next(articles: DataFrame, claimed: DataFrame) -> DataFrame:
    """articles with the claimed row in progress (see relational.next_in_queue)."""
    hit = claimed.select("id").withColumn("__c", F.lit(True))
    return update(articles.join(hit, "id", "left"), F.col("__c"), processing_status="in_progress").select(*articles.columns)


def mark_reviewed(articles: DataFrame, key, note: str, reset: bool = False) -> DataFrame:
    """Flags cleared and a note appended; reset makes the article pending again."""
    notes = F.when(F.coalesce("processing_notes", F.lit("")) == "", F.lit(note)).otherwise(F.concat_ws("; ", "processing_notes", F.lit(note)))
    values = {"processing_flags": F.array().cast("array<string>"), "processing_notes": notes}
    if reset:
        values |= {"processing_status": F.lit("pending"), "processed_at": F.lit(None).cast(dict(articles.dtypes)["processed_at"])}
    return update(articles, F.col("id") == key, **values)


def token_row(spark: SparkSession, token: str, article_id: str, payload: dict, now: str) -> DataFrame:
    return spark.createDataFrame([(token, article_id, json.dumps(payload), now, 0)], "token string, article_id string, classification_data string, created_at string, used int")


def issue_tokens(validated: DataFrame, payload: list[str], now: Column) -> DataFrame:
    """(token, article_id, classification_data, created_at, used): a token row for each valid one of
    validated(article_id, valid, token, ...), with the columns of payload as JSON."""
    data = F.to_json(F.struct(*payload))
    return validated.where("valid").select("token", F.col("article_id").cast("string").alias("article_id"), data.alias("classification_data"), now.cast("string").alias("created_at"), F.lit(0).alias("used"))


def mark_token_used(tokens: DataFrame, token: str) -> DataFrame:
    return update(tokens, F.col("token") == token, used=1)


def mark_tokens_used(tokens: DataFrame, used: DataFrame) -> DataFrame:
    """tokens with those of used(token) marked."""
    hit = used.select("token").distinct().withColumn("__u", F.lit(True))
    return update(tokens.join(hit, "token", "left"), F.col("__u"), used=1).select(*tokens.columns)


def clean_tokens(tokens: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Used and old tokens go."""
    return tokens.where((F.col("used") == 0) & (F.to_timestamp("created_at") >= now - F.expr(f"INTERVAL {hours} HOURS")))


def session_increment(state: DataFrame, n: int = 1) -> DataFrame:
    return state.withColumn("articles_processed_count", F.col("articles_processed_count") + F.lit(n))


def session_reset(state: DataFrame, now: Column) -> DataFrame:
    return state.withColumns({"articles_processed_count": F.lit(0), "last_reset_at": now, "last_reset_date": F.to_date(now)})


def session_interval(state: DataFrame, n: int) -> DataFrame:
    if not 1 <= n <= 20:
        raise ValueError("the interval must be from 1 to 20")
    return state.withColumn("human_review_interval", F.lit(n))


def approve(articles: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert of reviewed documents: empty values become null, the language defaults to en, and the
    status is pending."""
    clean = rows.select(*[X.blank_to_null(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    clean = clean.withColumns({"source_language": F.coalesce("source_language", F.lit("en")), "processing_status": F.lit("pending")})
    return upsert(articles, clean, ["id"], [c for c in clean.columns if c != "id"])


def move_stage(docs: DataFrame, keys: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """Documents of keys at stage source go to target."""
    hit = keys.select(key).distinct().withColumn("__m", F.lit(True))
    return update(docs.join(hit, key, "left"), F.col("__m") & (F.col("stage") == source), stage=target).select(*docs.columns)


def load_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last of rows with equal key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def migrate(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns it lacks, by their defaults."""
    return df.withColumns({c: v for c, v in columns.items() if c not in df.columns})


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


class Conflict(RuntimeError):
    """Another writer published first."""


class Store:
    """Versioned snapshots of several tables under one root. A change counts once the next numbered
    manifest exists, which one rename brings about: readers take the newest one and see all of a
    change or nothing of it, after a crash at any point too. Of two writers that start from the same
    manifest one fails with Conflict."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _newest(self) -> int:
        """Number of the newest manifest, 0 if there is none."""
        fs, jvm = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest-*.json")) or []
        return max((int(x.getPath().getName()[9:-5]) for x in found), default=0)

    def manifest(self, number: int | None = None) -> dict[str, str]:
        """Paths of tables by name, as of the newest manifest or that of a number."""
        number = self._newest() if number is None else number
        if not number:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/manifest-{number:010d}.json").collect()))

    def read(self, name: str) -> DataFrame:
        held = self.manifest()[name]
        if isinstance(held, str):
            return self.spark.read.parquet(f"{self.root}/{held}")
        return self._parts(held, held["parts"])

    def _parts(self, held: dict, numbers) -> DataFrame:
        """Buckets of a bucketed table; rows of none if there are none."""
        paths = [f"{self.root}/{held['parts'][k]}" for k in numbers]
        shape = StructType.fromJson(held["schema"])
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def publish(self, tables: dict[str, DataFrame], check: Callable[[], None] | None = None) -> dict[str, str]:
        """Write tables to a new version and point to them; an error before that changes nothing."""
        version, number = uuid.uuid4().hex, self._newest()
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{version}")
        if check:
            check()
        return self._point({name: f"{name}/{version}" for name in tables}, number, version)

    def _point(self, entries: dict, number: int, version: str) -> dict:
        """Bring about the manifest after `number`, with new entries."""
        current = self.manifest(number) | entries
        fs, jvm = self._fs()
        temporary, final = (jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}") for n in (f".manifest-{version}", f"manifest-{number + 1:010d}.json"))
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(current).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise Conflict(f"{final} exists")
        return current

    def upsert(self, name: str, rows: DataFrame, keys: list[str], updated: list[str] | None = None, also: dict[str, DataFrame] | None = None, newest_by: str | None = None) -> list[int]:
        """Take `updated` columns (all but the keys by default) of rows into a table in buckets of its keys,
        which the first call creates; other rows are added. Only buckets that hold a key of rows are read
        and written; the next manifest names them and keeps the others. Tables of `also` are published
        with them. With newest_by, a row that is older than the known one by that column changes nothing.
        Of several rows of one key one is taken, the newest if there is such a column. Null keys are keys.
        Returns the numbers of the buckets written."""
        number, version = self._newest(), uuid.uuid4().hex
        held = self.manifest(number).get(name)
        if held is None:
            held = {"keys": keys, "buckets": BUCKETS, "schema": rows.schema.toNullable().jsonValue(), "parts": {}}
        elif isinstance(held, str) or held["keys"] != keys:
            raise ValueError(f"{name} is not in buckets of {keys}")
        part, fresh, known = free(rows, "part", "fresh", "known")
        order = F.col(newest_by) if newest_by else F.lit(0)
        one = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias(fresh)).select(f"{fresh}.*")
        one = stash(one.withColumn(part, F.pmod(F.xxhash64(*keys), F.lit(held["buckets"])).cast("int")), "upsert")
        touched = sorted(r[0] for r in one.select(part).distinct().collect())  # at most as many as buckets
        if not touched and not also:
            return []
        shape = StructType.fromJson(held["schema"])
        old = self._parts(held, [str(k) for k in touched if str(k) in held["parts"]])
        new = one.select(F.struct(*rows.columns).alias(fresh), *[F.col(k).alias(f"{fresh}{k}") for k in keys])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{fresh}{k}")) for k in keys])
        joined = old.withColumn(known, F.lit(True)).join(new, same, "full_outer")
        there, is_old = F.col(fresh).isNotNull(), F.coalesce(F.col(known), F.lit(False))
        if newest_by:
            there &= ~is_old | (F.col(f"{fresh}.{newest_by}") >= F.col(newest_by)) | F.col(newest_by).isNull()
        taken = set(rows.columns) - set(keys) if updated is None else set(updated)
        columns = []
        for c in shape.names:
            if c not in rows.columns:
                columns.append(F.col(c))
            else:
                first = F.col(f"{fresh}.{c}")
                columns.append(F.when(~is_old, first).when(there & F.lit(c in taken), first).otherwise(F.col(c)).cast(shape[c].dataType).alias(c))
        merged = joined.select(*columns)
        merged = merged.withColumn(part, F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(held["buckets"])).cast("int"))
        if touched:
            merged.repartition(max(1, len(touched)), part).write.partitionBy(part).parquet(f"{self.root}/{name}/{version}")
        held = {**held, "parts": held["parts"] | {str(k): f"{name}/{version}/{part}={k}" for k in touched}}
        more = {}
        for other, df in (also or {}).items():
            df.write.parquet(f"{self.root}/{other}/{version}")
            more[other] = f"{other}/{version}"
        self._point({name: held, **more}, number, version)
        return touched

    def delete(self, name: str, rows: DataFrame, keys: list[str]) -> list[int]:
        """Drop the rows of a bucketed table whose keys are in rows; only their buckets are rewritten."""
        number, version = self._newest(), uuid.uuid4().hex
        held = self.manifest(number)[name]
        (part,) = free(rows, "part")
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(held["buckets"])).cast("int")
        gone = stash(rows.select(*keys).distinct().withColumn(part, bucket), "delete")
        touched = [str(r[0]) for r in gone.select(part).distinct().orderBy(part).collect() if str(r[0]) in held["parts"]]
        if not touched:
            return []
        old = self._parts(held, touched)
        other = gone.select(*[F.col(k).alias(f"{part}{k}") for k in keys])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{part}{k}")) for k in keys])
        left = old.join(other, same, "left_anti").withColumn(part, bucket)
        left.repartition(len(touched), part).write.partitionBy(part).parquet(f"{self.root}/{name}/{version}")
        full = {str(r[0]) for r in self.spark.read.schema(left.schema).parquet(f"{self.root}/{name}/{version}").select(part).distinct().collect()}
        parts = {k: v for k, v in held["parts"].items() if k not in touched} | {k: f"{name}/{version}/{part}={k}" for k in touched if k in full}
        self._point({name: {**held, "parts": parts}}, number, version)
        return [int(k) for k in touched]
