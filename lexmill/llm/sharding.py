"""Sharding by a minimax contiguous partition of atomic groups.

Documents of equal texts are one group and never part. Groups have an order: those of a sizeable
part of a shard first, the largest of them leading, then the others by a digest of their text. Over
the running sums of group sizes, the smallest capacity for which `shards` contiguous runs hold all
groups is found by halving the range of capacities, and each capacity is checked greedily: a run
takes groups as long as they fit. Capacities are checked many at once (a pass over the running sums
finds the next cut of each), so that a pass halves the range DOUBLINGS times. Cuts lie within that
capacity as near to even shares as group bounds allow: the greedy runs would fill the first shards
and leave the last ones empty. The last groups before the cuts then tell each document's shard.

Defined cases: a null text is an empty one (size 1); equal texts share a shard whatever their ids;
rows may repeat and ids be null; slots count rows of a shard from 0 in order of group and id, equal
rows in the order of the input; with fewer groups than shards the last shards are empty; groups over
a shard's even share have a shard alone or nearly so; an empty table gives no rows; columns of any
name pass through, but those the operator adds replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.operators.numbering import numbered, running_sum
from lexmill.session import free, stash

SHARDS = 8
#: Groups of at least one SIZEABLE-th of an even share come first, by size.
SIZEABLE = 16
DOUBLINGS = 8


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


class Runs:
    """Running sums of ordered groups (bound, key, place), written; bounds that are asked for are
    found by one pass over them."""

    def __init__(self, groups: DataFrame, shards: int) -> None:
        totals = groups.agg(F.sum("size").alias("total"), F.max("size").alias("largest")).first()
        self.total, self.largest, self.shards = totals["total"] or 0, totals["largest"] or 0, shards
        sizeable = -(-self.total // (shards * SIZEABLE))
        ranked = groups.withColumn("rank", F.when(F.col("size") >= sizeable, -F.col("size")).otherwise(0))
        self.bounds = stash(running_sum(ranked, "size", ["rank", "key"], "bound").select("bound", "rank", "key"), "bounds")

    def around(self, wanted: list[int]) -> list[tuple[int, int]]:
        """For each wanted sum (ascending), the largest bound up to it (0 if none) and the least one
        beyond it (the total if none). A task answers those within its own range of bounds and tells
        that range: the driver gets about a row a wanted sum and a row a task, whatever the groups."""
        at = np.array(wanted, np.int64)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy(zero_copy_only=False) for b in batches)]))
            if len(bounds):
                own = np.flatnonzero((at >= bounds[0]) & (at < bounds[-1]))
                k = np.searchsorted(bounds, at[own], "right")
                i = np.r_[-1 - TaskContext.get().partitionId(), own]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.r_[bounds[-1], bounds[k - 1]]), pa.array(np.r_[bounds[0], bounds[k]])], ["i", "below", "above"])

        # Only bounds up to one group's size away can be answers: the others are not read.
        near = self.bounds.where(F.col("bound").between(min(wanted) - self.largest, max(wanted) + self.largest)).select("bound")
        found = near.mapInArrow(part, "i long, below long, above long").groupBy("i").agg(F.max("below").alias("below"), F.min("above").alias("above")).collect()
        within = {r["i"]: (r["below"], r["above"]) for r in found if r["i"] >= 0}
        lasts, firsts = np.sort([0, *(r["below"] for r in found if r["i"] < 0)]), np.sort([*(r["above"] for r in found if r["i"] < 0), self.total])
        out = []
        for i, t in enumerate(wanted):
            below, above = within.get(i, (0, self.total))
            k, j = np.searchsorted(lasts, t, "right"), np.searchsorted(firsts, t, "right")
            out.append((max(below, int(lasts[k - 1])), min(above, int(firsts[j])) if j < len(firsts) else above))
        return out

    def holds(self, capacities: list[int]) -> list[bool]:
        """Whether greedy runs of each capacity (ascending, none under the largest group) end within
        the shards."""
        ends = [0] * len(capacities)
        for _ in range(self.shards):
            open_ = [i for i, end in enumerate(ends) if end < self.total]
            if not open_:
                break
            asked = sorted({min(ends[i] + capacities[i], self.total) for i in open_})
            reached = dict(zip(asked, self.around(asked), strict=True))
            for i in open_:
                ends[i] = reached[min(ends[i] + capacities[i], self.total)][0]
        return [end >= self.total for end in ends]

    def capacity(self, doublings: int = DOUBLINGS) -> int:
        """The smallest capacity that holds."""
        low = max(self.largest, -(-self.total // self.shards))
        high = max(low, min(self.total, -(-self.total // self.shards) + self.largest))
        # Runs of an even share and the largest group always hold: each but the last exceeds an even share.
        while low < high:
            step = max(1, -(-(high - low) // (1 << doublings)))
            tried = list(range(low, high, step))
            held = self.holds(tried)
            first = held.index(True) if True in held else len(tried)
            low, high = tried[first - 1] + 1 if first else low, tried[first] if first < len(tried) else high
        return high

    def cuts(self, capacity: int) -> list[int]:
        """Bounds between shards: none of more than capacity, each as near as can be to an even share of
        what is left, and with a group in it while there are any."""
        least = [self.total] * (self.shards + 1)  # the least bound from which later shards hold the rest
        for j in range(self.shards - 1, 0, -1):
            at = least[j + 1] - capacity
            below, above = self.around([at])[0] if at > 0 else (0, 0)
            least[j] = at if below == at else above if at > 0 else 0
        out, start = [], 0
        for j in range(1, self.shards):
            even = start + (self.total - start) // (self.shards - j + 1)
            asked = sorted({start, even, min(start + capacity, self.total)})
            found = dict(zip(asked, self.around(asked), strict=True))
            below, above = found[even]
            near = below if even - below <= above - even else above
            start = min(max(near, found[start][1], least[j]), found[min(start + capacity, self.total)][0])
            out.append(start)
        return out

    def lasts(self, cuts: list[int]) -> list[tuple[int, str] | None]:
        """(rank, key) of the last group before each cut; None before the first group."""
        asked = sorted({c for c in cuts if c})
        found = {r["bound"]: (r["rank"], r["key"]) for r in self.bounds.where(F.col("bound").isin(asked)).collect()} if asked else {}  # a row a cut
        return [found.get(c) for c in cuts]


def place(sized: DataFrame, size: str, digest: str, key: str, shards: int = SHARDS, name: str = "shard", slot: str = "slot") -> tuple[DataFrame, int]:
    """Rows with a size and a text's digest, with `shard` and `slot` added; and the capacity."""
    kept = [c for c in sized.columns if c not in (name, slot)]
    sized = sized.select(*kept)
    group, rank = free(sized, "group", "rank")
    runs = Runs(stash(sized.groupBy(F.col(digest).alias("key")).agg(F.sum(size).alias("size")), "groups"), shards)
    if not runs.total:
        return sized.select(*kept, F.lit(0).alias(name), F.lit(0).cast("long").alias(slot)).where(F.lit(False)), 0
    capacity = runs.capacity()
    lasts = runs.lasts(runs.cuts(capacity))

    # Sizeable groups, at most shards * SIZEABLE, are told by their keys; others by where their digest lies.
    sizeable = runs.bounds.where("rank < 0").select(F.col("key").alias(group), F.col("rank").alias(rank))
    ranked = sized.join(F.broadcast(sizeable), F.col(digest) == F.col(group), "left").withColumn(rank, F.coalesce(F.col(rank), F.lit(0)))
    of = F.lit(0)
    for last in lasts:
        if last is not None:
            of = of + ((F.col(rank) > last[0]) | ((F.col(rank) == last[0]) & (F.col(digest) > last[1]))).cast("int")
    out = numbered(ranked.withColumn(name, of), [rank, digest, key], [name], slot)
    return out.select(*kept, name, slot), capacity


def digest_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def shard(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS, size: str = "size", name: str = "shard", slot: str = "slot") -> tuple[DataFrame, int]:
    """docs, dealt to ranges of shards, with `size`, `shard` and `slot`; and the capacity: no shard's
    sizes exceed it, and no partition into contiguous runs has a smaller one."""
    kept = [c for c in docs.columns if c not in (size, name, slot)]
    (digest,) = free(docs, "digest")
    out, capacity = place(docs.select(*kept, size_of(F.col(text)).alias(size), digest_of(F.col(text)).alias(digest)), size, digest, key, shards, name, slot)
    return out.drop(digest), capacity


def op13(spark: SparkSession, docs: DataFrame) -> DataFrame:
    text = F.col("text")
    slim = docs.select("doc_id", size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), digest_of(text).alias("digest"))
    out, _ = place(stash(slim, "sizes"), "size", "digest", "doc_id")  # texts are read once
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle() -> str:
    """The smallest capacity by dynamic programming over all bounds, then the cuts step by step."""
    k = SHARDS
    steps = [
        """g AS (SELECT md5(coalesce(text, '')) AS key, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size FROM documents GROUP BY 1)""",
        """t AS MATERIALIZED (SELECT sum(size)::BIGINT AS total FROM g)""",
        f"""r AS (SELECT key, size, CASE WHEN size >= (total + {k * SIZEABLE - 1}) // {k * SIZEABLE} THEN -size ELSE 0 END AS rank FROM g, t)""",
        """p AS MATERIALIZED (SELECT key, rank, sum(size) OVER (ORDER BY rank, key)::BIGINT AS bound FROM r)""",
        """b AS MATERIALIZED (SELECT bound FROM p UNION ALL SELECT 0)""",
        """f1 AS MATERIALIZED (SELECT bound, bound AS most FROM b)""",
    ]
    for j in range(2, k + 1):
        steps.append(f"f{j} AS MATERIALIZED (SELECT e.bound, min(greatest(f.most, e.bound - f.bound)) AS most FROM b e JOIN f{j - 1} f ON f.bound <= e.bound GROUP BY 1)")
    steps.append(f"c AS MATERIALIZED (SELECT most AS capacity, total FROM f{k}, t WHERE bound = total)")
    steps.append(f"l{k} AS (SELECT total AS least FROM t)")
    for j in range(k - 1, 0, -1):
        steps.append(f"l{j} AS MATERIALIZED (SELECT min(bound) AS least FROM b, l{j + 1} l, c WHERE bound >= l.least - capacity)")
    steps.append("s0 AS (SELECT 0::BIGINT AS start)")
    for j in range(1, k):
        steps.append(f"""e{j} AS MATERIALIZED (SELECT start, start + (total - start) // {k - j + 1} AS even FROM s{j - 1}, t),
n{j} AS MATERIALIZED (SELECT max(bound) FILTER (bound <= even) AS below, coalesce(min(bound) FILTER (bound > even), any_value(total)) AS above,
  coalesce(min(bound) FILTER (bound > start), any_value(total)) AS one, max(bound) FILTER (bound <= start + capacity) AS far, any_value(even) AS even FROM b, e{j}, c),
s{j} AS MATERIALIZED (SELECT least(greatest(CASE WHEN even - below <= above - even THEN below ELSE above END, one, least), far) AS start FROM n{j}, l{j})""")
    cuts = " UNION ALL ".join(f"SELECT start FROM s{j}" for j in range(1, k))
    steps.append(f"""k AS MATERIALIZED ({cuts})""")
    steps.append("""h AS MATERIALIZED (SELECT key, rank, (SELECT count(*) FROM k WHERE k.start < p.bound)::INTEGER AS shard FROM p)""")
    # The CRC-32 of bytes, eight shifts each, over the pairs of hex digits of a text.
    steps.append("""x AS MATERIALIZED (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, o: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::BIGINT) AS crc FROM (SELECT DISTINCT text FROM documents WHERE text <> ''))""")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, (octet_length(encode(coalesce(d.text, ''))) + 1)::BIGINT AS size, coalesce(crc, 0) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY rank, key, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM documents d JOIN h ON key = md5(coalesce(d.text, '')) LEFT JOIN x ON d.text = x.text"""


ORACLE = _oracle()
