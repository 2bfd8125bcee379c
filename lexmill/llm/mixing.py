"""Mixing sources to target weights, in DataFrame operations only.

Documents fall into cells of source, language and topic; the topic is that of a column, or else
the first of a few rules on the form of the text. Iterative proportional fitting rakes
the cells' token counts until each marginal has its target share; the raked weights set each
cell's inclusion probability for a token budget, and a hash of the document decides. Targets are
shares given by value, or by default the tempered shares (tokens to the power `temper`). Texts are
read once: what is known of each row is written before cells are counted.

Defined cases: null source or language is the value ''; a null or empty text has no tokens; a
cell without tokens is always included (it costs nothing); values a given target leaves out share
what it leaves over in proportion to their tokens; a cell that lacks the tokens its weight asks
for is taken whole and the others make up for it; equal rows share one fate; empty tables give
no rows; columns of any name pass through unchanged (but one of the name given to the result). Marginals that the cells can't meet together
end as close as `ROUNDS` rounds bring them, with a warning; if a given target is missed by more than
`MISS`, that is an error.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.session import free, stash

#: Topics by the first pattern found in the text; texts without any are prose.
TOPICS = {
    "legal": r"(?i)\blicen[sc]ed?\b|copyright|all rights reserved",
    "contact": r"@|\+[0-9]",
    "table": r" \| ",
    "list": r"(?m)^\s*[-*] ",
}
DIMS = ("source", "lang", "topic")
ROUNDS, CLOSE, MISS = 24, 1e-4, 0.05
RATE, TEMPER, SEED = 0.6, 0.7, 11


def n_tokens(text: Column) -> Column:
    """Number of blank-separated words."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column, topics: Mapping[str, str] = TOPICS) -> Column:
    chain = reduce(lambda c, kv: c.when(text.rlike(kv[1]), kv[0]), topics.items(), F.when(F.lit(False), ""))
    return F.coalesce(chain.otherwise("prose"), F.lit("prose"))


def describe(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, topics: Mapping[str, str] = TOPICS, seed: int = SEED, name: str = "__mix") -> DataFrame:
    """docs with a struct `name` (source, lang, topic, n_tokens, chance): the cell and size of each row,
    and a number from 0 to 1 that is a hash of the whole row. A column of that name is replaced."""
    docs = docs.drop(name)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fate = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns if c != text], F.col(text))
    chance = F.shiftrightunsigned(fate, 11) / F.lit(float(1 << 53))
    of = value(topic) if topic else topic_of(F.col(text), topics)
    return docs.withColumn(name, F.struct(value(source).alias("source"), value(lang).alias("lang"), of.alias("topic"), n_tokens(F.col(text)).alias("n_tokens"), chance.alias("chance")))


def _with_targets(cells: DataFrame, dim: str, given: Mapping[str, float] | None, temper: float) -> DataFrame:
    """cells with t_<dim>, the target share of the cell's value in that marginal."""
    marginal = cells.groupBy(dim).agg(F.sum("tokens").alias("m"))
    if given:
        known = F.create_map(*[F.lit(x) for kv in given.items() for x in (kv[0], float(kv[1]))])[F.col(dim)]
        loose = marginal.agg(F.sum(F.when(known.isNull(), F.col("m")))).first()[0]
        share = F.coalesce(known, F.lit(max(0.0, 1.0 - sum(given.values()))) * F.col("m") / F.lit(float(loose or 1)))
    else:
        total = marginal.agg(F.sum(F.pow("m", F.lit(temper)))).first()[0]
        share = F.pow("m", F.lit(temper)) / F.lit(float(total or 1))
    return cells.join(marginal.select(dim, share.alias(f"t_{dim}")), dim)


def rake(cells: DataFrame, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, dict[str, float]]:
    """cells(source, lang, topic, tokens, t_*) with `weight`, the raked shares, and the worst gap of
    each marginal. A round fits the three marginals in turn; rounds go on until none deviates by
    `close`. Sums are grouped, so that a value with most of the cells is summed by all tasks, and
    Spark broadcasts them only if they are small."""
    out, gaps = cells.withColumn("weight", F.col("tokens").cast("double")), {}
    for _ in range(rounds):
        for dim in DIMS:
            total = out.groupBy(dim).agg(F.sum("weight").alias("total"))
            fitted = F.when(F.col("total") > 0, F.col("weight") * F.col(f"t_{dim}") / F.col("total")).otherwise(0.0)
            out = out.join(total, dim).withColumn("weight", fitted).drop("total")
        out = stash(out, "raked")
        sums = [out.groupBy(dim).agg(F.abs(F.sum("weight") - F.max(f"t_{dim}")).alias("gap")).select(F.lit(dim).alias("dim"), "gap") for dim in DIMS]
        gaps = {r["dim"]: r["gap"] for r in reduce(DataFrame.union, sums).groupBy("dim").agg(F.max("gap").alias("gap")).collect()}  # a row a marginal
        if max(gaps.values(), default=0.0) < close:
            break
    return out, gaps


def calibrate(raked: DataFrame, rate: float = RATE) -> DataFrame:
    """raked with `probability`: tokens expected in the sample are rate x all tokens, dealt out by
    weight; cells that can't supply theirs are taken whole and the factor of the rest rises."""
    sums = raked.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w")).first()
    if not sums["t"] or not sums["w"]:
        return raked.withColumn("probability", F.lit(1.0))
    wanted = factor = rate * sums["t"] / sums["w"]
    for _ in range(200):
        whole = F.col("weight") * factor >= F.col("tokens")
        got = raked.agg(F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(~whole, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        if not got["w"]:
            break
        wanted, factor = factor, (rate * sums["t"] - got["t"]) / got["w"]
        if abs(factor - wanted) <= 1e-12 * wanted:
            break
    else:
        raise RuntimeError("calibration did not settle")
    return raked.withColumn("probability", F.when(F.col("tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("weight") * factor / F.col("tokens"))))


def weigh(described: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rate: float = RATE, temper: float = TEMPER, name: str = "__mix") -> DataFrame:
    """Described rows with the struct `name` (source, lang, topic, n_tokens, weight, probability, sampled)."""
    cells = described.groupBy(*[F.col(f"{name}.{d}").alias(d) for d in DIMS]).agg(F.sum(f"{name}.n_tokens").alias("tokens"))
    cells, targets = stash(cells, "cells"), targets or {}
    for dim in DIMS:
        cells = _with_targets(cells, dim, targets.get(dim), temper)
    raked, gaps = rake(stash(cells, "targets"))
    if missed := {d: g for d, g in gaps.items() if g > MISS and d in targets}:
        raise ValueError(f"target shares can't be met: off by {missed}")
    if max(gaps.values(), default=0.0) >= CLOSE:
        warnings.warn(f"marginals are off by up to {gaps}", stacklevel=2)
    fitted = stash(calibrate(raked, rate), "fitted")
    cell, each, chance = free(described, "cell", "weight", "probability")
    fitted = fitted.select(F.struct(*DIMS).alias(cell), F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).alias(each), F.col("probability").alias(chance))
    # Spark broadcasts the cells only if their written size is under its threshold.
    joined = described.withColumn(cell, F.struct(*[F.col(f"{name}.{d}").alias(d) for d in DIMS])).join(fitted, cell)
    known = [F.col(f"{name}.{c}").alias(c) for c in (*DIMS, "n_tokens")]
    result = F.struct(*known, F.col(each).alias("weight"), F.col(chance).alias("probability"), (F.col(f"{name}.chance") < F.col(chance)).alias("sampled"))
    return joined.select(*[F.col(c) for c in described.columns if c != name], result.alias(name))


def mix(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, targets: Mapping[str, Mapping[str, float]] | None = None, rate: float = RATE, temper: float = TEMPER, topics: Mapping[str, str] = TOPICS, seed: int = SEED, name: str = "__mix") -> DataFrame:
    """docs with a struct `name` (source, lang, topic, n_tokens, weight, probability, sampled)."""
    return weigh(stash(describe(docs, text, source, lang, topic, topics, seed, name), "described"), targets, rate, temper, name)


def sample(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: the sampled documents, with the columns of docs."""
    (name,) = free(docs, "mix")
    return mix(docs, **options, name=name).where(F.col(f"{name}.sampled")).select(*docs.columns)


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    described = describe(docs.select("doc_id", "text", "source", "lang")).select("doc_id", "__mix")
    return weigh(stash(described, "described")).select("doc_id", "__mix.*")
