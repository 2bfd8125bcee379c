"""Cross-site boilerplate removal by the spread of lines over distinct sites.

One HyperLogLog sketch of sites per line hash is built map-side and merged by aggregation.
Lines whose estimate is near the threshold get exact distinct counts; lines clearly above are
boilerplate and lines clearly below are not. Boilerplate lines leave every document.

Defined cases: a null text stays null; an empty text stays empty; a null site counts as the
site ''; lines are compared without outer blanks; blank lines are never removed; repeated rows
and ties are treated alike; very long texts count whole; an empty table gives no rows; columns of
any name pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.session import free, stash

MIN_SITES = 8
#: log2 of the sketch's registers, and the relative error band treated as near.
SKETCH_LG, BAND = 8, 0.25


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line without outer blanks; null for blank lines."""
    bare = F.trim(F.regexp_replace(line, r"[\t\r\f\x0b]", " "))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(7)).alias("b")))


def line_spread(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (key, estimate, exact, sites) of lines that may reach min_sites."""
    each = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(F.transform(_lines(F.col(text)), _key)).alias("key")).where("key is not null")
    # One row per line and site of a task first: a line repeated within a site costs one update.
    sketches = each.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(SKETCH_LG)).alias("sketch"))
    estimated = sketches.select("key", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites * (1 - BAND))
    estimated = stash(estimated, "line-spread")
    near = estimated.where(F.col("estimate") <= min_sites * (1 + BAND)).select("key")
    exact = each.join(near, "key", "left_semi").distinct().groupBy("key").agg(F.count("*").alias("exact"))
    return estimated.join(exact, "key", "left").withColumn("sites", F.coalesce("exact", "estimate"))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of lines found on at least min_sites distinct sites."""
    return line_spread(docs, text, site, min_sites).where(F.col("sites") >= min_sites).select("key")


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, counts: bool = False) -> DataFrame:
    """docs with boilerplate lines cut from `text`; with counts, also n_lines and n_removed.

    Documents holding such a line take a join on a row key made here, so hot lines spread over
    tasks; the set of lines itself is joined by hash and may be of any size.
    """
    keys = stash(boilerplate(docs, text, site, min_sites), "boilerplate")
    id_, cut, left, key = free(docs, "row", "cut", "kept", "key")
    fingerprint = F.struct(*[F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns if c != text], F.col(text)).alias(f"f{seed}") for seed in (1, 2)])
    keyed = docs.withColumn(id_, fingerprint)  # equal rows share a key: their lines are equal too
    at = keyed.select(id_, F.posexplode(F.transform(_lines(F.col(text)), _key)).alias("pos", key)).where(F.col(key).isNotNull())
    hits = at.join(keys.withColumnRenamed("key", key), key, "left_semi").groupBy(id_).agg(F.collect_set("pos").alias(cut))
    joined = keyed.join(hits, id_, "left")
    lines = _lines(F.col(text))
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col(cut), i)), "\n")
    out = joined.withColumn(left, F.when(F.col(cut).isNull(), F.col(text)).otherwise(kept))
    columns = [F.col(left).alias(c) if c == text else F.col(c) for c in docs.columns]
    if counts:
        columns += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_removed")]
    return out.select(*columns)


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    cut = remove_boilerplate(docs.select("doc_id", "text", "source"), counts=True)
    return cut.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.when(F.col("n_removed") > 0, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Exact distinct counts: equal to the operator's rows wherever the sketch is clear of the band.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
         unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
bare AS (SELECT *, trim(regexp_replace(line, '[\\t\\r\\f\\v]', ' ', 'g'), ' ') AS b FROM lines),
wide AS (SELECT b FROM bare WHERE b <> '' GROUP BY b HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (SELECT bare.*, b IN (SELECT b FROM wide) AS cut FROM bare)
SELECT d.doc_id, coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(m.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(m.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut) AS kept
  FROM marked GROUP BY doc_id) m USING (doc_id)
"""
