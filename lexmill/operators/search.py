"""Keyword search by an inverted index of trigrams, before the exact test.

The index is a table (gram, key), in folders of grams by hash. A query reads the folders of its own
trigrams alone, keys that have all of them are candidates, and `relational.search` decides on
these: the rows are those of a scan of all texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.operators import relational as R

SIZE, FOLDERS = 3, 256


def grams(c: Column, size: int = SIZE) -> Column:
    """Distinct runs of `size` characters, in lower case; in time in proportion to the text."""
    characters = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), ""), lambda x: x != "")

    def runs(cs: Column) -> Column:
        starts = F.when(F.size(cs) >= size, F.sequence(F.lit(0), F.size(cs) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(cs, i + k) for k in range(size)]))

    # Bound as a variable, the characters are told apart once.
    return F.array_distinct(F.transform(F.array(characters), runs)[0])


def folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def build_index(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Write the index of df's columns: a row for each trigram of each key."""
    own = F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in columns])))
    rows = df.select(F.col(key), F.explode(own).alias("gram")).withColumn("folder", folder(F.col("gram")))
    rows.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").options(compression="zstd").parquet(path)


def wanted(query: str, size: int = SIZE) -> list[str]:
    """Trigrams that any match holds: those of runs without wildcards."""
    runs = [r.lower() for r in re.split(r"[%_\\]", query)]
    return sorted({r[i : i + size] for r in runs for i in range(len(r) - size + 1)})


def candidates(spark: SparkSession, path: str, key: str, query: str) -> DataFrame | None:
    """Keys that hold all trigrams of a query; None if it has none, and all rows have to be read."""
    need = wanted(query)
    if not need:
        return None
    numbers = sorted({r[0] for r in spark.createDataFrame([(g,) for g in need], "gram string").select(folder(F.col("gram"))).collect()})  # as few as the query has trigrams
    postings = spark.read.parquet(path).where(F.col("folder").isin(numbers) & F.col("gram").isin(need))
    return postings.groupBy(key).agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(need)).select(key)


def search(df: DataFrame, path: str, query: str, key: str, columns: list[str]) -> DataFrame:
    """Rows of df that relational.search finds, with only candidates of the index tested. A key may
    repeat; rows without one are always tested."""
    found = candidates(df.sparkSession, path, key, query)
    if found is None:
        return R.search(df, query, columns)
    near = df.join(found, key, "left_semi").unionByName(df.where(F.col(key).isNull()))
    return R.search(near, query, columns)
