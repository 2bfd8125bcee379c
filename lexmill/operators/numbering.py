"""Row numbers and running sums over a whole table, without a window that one task computes.

Rows are dealt to range partitions by the order asked for and sorted there; each partition's count
(a row a partition and group) gives the others their offset. Rows that tie are told apart by their
place in the input, so that many equal rows still spread over partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.session import free, partitions, stash

#: monotonically_increasing_id holds the partition above these bits and the row's place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "n", total: str | None = None) -> DataFrame:
    """df with `name`, the number from 0 of each row in `order`, in its group of `by` if given, and
    optionally `total`, the rows of its group.

    Defined cases: nulls are a group of their own in `by` and sort as Spark sorts them (first, or as
    a Column says); rows that tie keep the order of the input; a group of any size, also of equal
    rows, spreads over partitions; an empty table gives no rows; columns named `name` or `total` are
    replaced, others pass through whatever their names.
    """
    df = df.drop(*(c for c in (name, total) if c and c in df.columns))
    tie, at, part, first, count, before, whole = free(df, "tie", "at", "part", "first", "count", "before", "whole")
    keys = [*by, *order]
    dealt = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(df.sparkSession), *keys, tie).sortWithinPartitions(*keys, tie).drop(tie)
    dealt = stash(dealt.withColumn(at, F.monotonically_increasing_id()), "numbered")
    dealt = dealt.withColumn(part, F.shiftrightunsigned(at, PLACE_BITS)).withColumn(at, F.col(at).bitwiseAND((1 << PLACE_BITS) - 1))

    # A row a partition and group: as many as partitions and groups together, at most. Without groups
    # the window below is one task's, over a row a partition.
    counts = dealt.groupBy(*by, part).agg(F.count("*").alias(count), F.min(at).alias(first))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = F.sum(count).over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn(before, F.coalesce(running, F.lit(0)) - F.col(first)).withColumn(whole, F.sum(count).over(group)).drop(count, first)
    other = counts.select(*[F.col(c).alias(f"{whole}_{c}") for c in (*by, part)], before, whole)
    same = F.col(part) == F.col(f"{whole}_{part}")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{whole}_{c}"))
    joined = dealt.join(other, same)
    wanted = [*df.columns, (F.col(at) + F.col(before)).alias(name)]
    return joined.select(*wanted, *([F.col(whole).alias(total)] if total else []))


def running_sum(df: DataFrame, value: str, order: Sequence[str | Column], name: str = "sum") -> DataFrame:
    """df with `name`, the sum of the long `value` (null: 0) over all rows up to and with this one, in
    `order`: sums within range partitions, plus one offset a partition. Defined cases as of numbered."""
    df = df.drop(name) if name in df.columns else df
    tie, at, part, own, before = free(df, "tie", "at", "part", "own", "before")
    dealt = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(df.sparkSession), *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    dealt = stash(dealt.withColumn(at, F.monotonically_increasing_id()), "ranged").withColumn(part, F.shiftrightunsigned(at, PLACE_BITS))
    dealt = dealt.withColumn(own, F.sum(F.coalesce(F.col(value), F.lit(0)).cast("long")).over(Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))
    sums = dealt.groupBy(part).agg(F.max_by(own, at).alias(own))
    sums = sums.select(F.col(part).alias(f"{before}_{part}"), F.coalesce(F.sum(own).over(Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return dealt.join(sums, F.col(part) == F.col(f"{before}_{part}")).select(*df.columns, (F.col(own) + F.col(before)).alias(name))
