"""Vector code compression: product codes from a delta-maintained Lloyd iteration.

Vectors are written once, in sorted buckets of a row number. Each round joins them, without a
shuffle, to the assignments that the round before wrote, assigns every part anew, writes the new
assignments, and shuffles only plus and minus contributions of parts whose entry changed, summed
by task. The driver keeps the running integer sums and counts of the codebook entries.

Defined cases: a vector that is null, empty, or has a null or non-finite component, or one too large
for a long once scaled, is dropped; so is one whose length is not the commonest (ties: the longer);
lengths that parts don't divide are filled up with zeros; with fewer vectors than entries the
codebooks have an entry a vector; ids may be null (last in order) or repeat (then in order of their
vectors); ties of distance go to the lower entry; a sum of errors beyond a long is null; an empty
table gives no rows; columns of any name pass through, but those the operator adds replace columns
of their names. What goes through the driver is the codebooks and their sums, of a size that the
parameters and the vectors' length set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lexmill.llm.whitening import rows_of, usable
from lexmill.session import bucketed, free, partitions

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK = 4096  # vectors whose distances are held at a time
LOW = (1 << 32) - 1


def integers(column: Column, width: int, parts: int = PARTS, scale: int = SCALE) -> Column:
    """floor(scale * component) of a usable vector, filled up with zeros to a multiple of `parts`."""
    whole = F.transform(column, lambda c: F.floor(c.cast("double") * scale))
    fill = -width % parts
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), fill)) if fill else whole


@dataclass
class Codebooks:
    """Entries of each part, as exact integers: books[part][entry][position]."""

    books: list[list[list[int]]]

    @property
    def reach(self) -> int:
        return max((abs(v) for b in self.books for e in b for v in e), default=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and exact squared distance of each part of each row; ties go to the lower entry.
        Doubles hold the sums if the numbers are small, else longs, else Python's integers do."""
        parts, width = len(self.books), len(self.books[0][0])
        x = x.reshape(len(x), parts, width)
        most = 4 * width * (max(self.reach, int(np.abs(x).max(initial=0))) + 1) ** 2
        kind = np.float64 if most < 1 << 52 else np.int64 if most < 1 << 62 else object
        codes, far = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), object if kind is object else np.int64)
        for p, entries in enumerate(self.books):
            b, v = np.array(entries, kind), x[:, p].astype(kind)
            d = (v * v).sum(axis=1)[:, None] - 2 * (v @ b.T) + (b * b).sum(axis=1)[None, :]
            codes[:, p] = own = d.argmin(axis=1)
            far[:, p] = d[np.arange(len(v)), own]
        return codes, far

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for e in b for v in e).encode()).hexdigest()


STATE = "row long, codes binary, part int, entry int, high array<long>, low array<long>"


def packed(values: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = values.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(values))])


def reassign(vectors: DataFrame, before: DataFrame | None, books: Codebooks, buckets: int) -> DataFrame:
    """The written state of a round: rows (row, codes), and rows (part, entry, high, low) of what the
    changed parts of a task's vectors add to an entry's sums, less what they take away; the last of
    the sums is the count. A sum is high * 2**32 + low, so none can overflow."""
    parts, width, entries, fresh = len(books.books), len(books.books[0][0]), max(map(len, books.books)), before is None
    joined = vectors.select("row", "x", F.lit(None).cast("binary").alias("codes")) if before is None else vectors.select("row", "x").join(before, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((2, parts, entries, width + 1), np.int64)
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows, x, old = (c.slice(at, BLOCK) for c in batch.columns)
                x = rows_of(x, parts * width)
                codes, _ = books.nearest(x)
                known = None if fresh else np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(-1, parts)
                ones = np.concatenate([x.reshape(-1, parts, width), np.ones((len(x), parts, 1), np.int64)], axis=2)
                for p in range(parts):
                    moved = slice(None) if known is None else np.flatnonzero(codes[:, p] != known[:, p])
                    v = ones[moved, p]
                    for sign, to in ((1, codes), (-1, known)):
                        if to is not None:
                            np.add.at(high[p], to[moved, p], sign * (v >> 32))
                            np.add.at(low[p], to[moved, p], sign * (v & LOW))
                last = rows[-1].as_py()
                sums = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([rows, packed(codes), *[pa.nulls(len(rows), t) for t in (pa.int32(), pa.int32(), sums, sums)]], NAMES)
        p, e = np.nonzero(((high != 0) | (low != 0)).any(axis=2))
        if len(p):
            # The row number is one of this task's, so that the sums go to a bucket it writes anyway.
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), last, np.int64)), pa.nulls(len(p), pa.binary()), *(pa.array(a.astype(np.int32)) for a in (p, e)), *(pa.array(list(a[p, e])) for a in (high, low))], NAMES)

    return bucketed(joined.mapInArrow(run, STATE), "row", buckets, "codes")


NAMES = [part.split()[0] for part in STATE.split(", ")]


def train(vectors: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after `rounds` of assigning the vectors (row, x, in sorted buckets of row) and replacing
    each entry that is used by the floor of its parts' mean."""
    buckets = partitions(vectors.sparkSession)
    sums = [[[0] * (len(e) + 1) for e in b] for b in books.books]  # the last is the count
    before = None
    for _ in range(rounds):
        state = reassign(vectors, before, books, buckets)
        before = state.where("codes is not null").select("row", "codes")
        width = len(books.books[0][0]) + 1
        added = [F.sum(F.get(side, F.lit(w))) for side in ("high", "low") for w in range(width)]
        deltas = state.where("codes is null").groupBy("part", "entry").agg(*added).collect()
        if not deltas:
            break  # nothing moved, and nothing will
        for part, entry, *d in deltas:
            own = sums[part][entry]
            sums[part][entry] = [s + (high << 32) + low for s, high, low in zip(own, d[:width], d[width:], strict=True)]
        books = Codebooks([[[v // s[-1] for v in s[:-1]] if s[-1] else e for e, s in zip(b, own, strict=True)] for b, own in zip(books.books, sums, strict=True)])
    return books


def compress(df: DataFrame, column: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, name: str = "codes", error: str = "error") -> tuple[DataFrame, Codebooks | None]:
    """Rows of df that are usable, with `codes` (a byte a part) and `error` (the exact squared distance
    from the entries); and the codebooks, which start as the parts of the vectors of least `key`."""
    kept = [c for c in df.columns if c not in (name, error)]
    own = df.select(*kept).where(usable(F.col(column), scale))
    shape = StructType([*own.schema.fields]).add(name, "binary").add(error, "long")
    width = own.groupBy(F.size(column).alias("w")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("w").desc()).limit(1).collect()
    if not width:
        return df.sparkSession.createDataFrame([], shape), None
    (x,) = free(own, "x")
    own = own.where(F.size(column) == width[0]["w"]).withColumn(x, integers(F.col(column), width[0]["w"], parts, scale))
    first = [r["x"] for r in own.select(F.col(key).alias("k"), F.col(x).alias("x")).orderBy(F.col("k").asc_nulls_last(), "x").limit(entries).collect()]
    span = len(first[0]) // parts
    books = Codebooks([[list(v[p * span : (p + 1) * span]) for v in first] for p in range(parts)])
    n = partitions(df.sparkSession)
    vectors = own.select(F.monotonically_increasing_id().alias("row"), F.col(x).alias("x")).repartition(n, "row")
    books = train(bucketed(vectors, "row", n, "vectors"), books, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                columns = [c.slice(at, BLOCK) for c in batch.columns]
                codes, far = books.nearest(rows_of(columns[-1], parts * span))
                total = far.sum(axis=1)
                total = pa.array([int(t) if t < 1 << 63 else None for t in total] if total.dtype == object else total, pa.int64())
                yield pa.RecordBatch.from_arrays([*columns[:-1], packed(codes), total], [*kept, name, error])

    return own.mapInArrow(run, shape), books


def op12(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    coded, books = compress(vectors.select("vec_id", "embedding", "label"))
    coded = coded.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = books.digest() if books is not None else ""
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds in SQL: a table of parts, and two tables a round."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT r, s AS part, list_slice(x, s * (len(x) // {PARTS}) + 1, (s + 1) * (len(x) // {PARTS})) AS w FROM v, range({PARTS}) t(s))""",
        f"""f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry FROM v)""",
        f"""b0 AS MATERIALIZED (SELECT part, entry, w FROM p JOIN f USING (r) WHERE entry < {ENTRIES})""",
    ]
    for i in range(1, ROUNDS + 2):
        steps.append(f"""d{i} AS (SELECT r, p.part, entry, p.w, list_sum(list_transform(list_zip(p.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS far FROM p JOIN b{i - 1} b USING (part)),
a{i} AS MATERIALIZED (SELECT r, part, min(far * {ENTRIES} + entry) AS best, any_value(w) AS w FROM d{i} GROUP BY r, part)""")
        if i <= ROUNDS:
            steps.append(f"""s{i} AS (SELECT part, entry, pos, sum(c)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT part, (best % {ENTRIES})::BIGINT AS entry, unnest(w) AS c, generate_subscripts(w, 1) AS pos FROM a{i}) GROUP BY 1, 2, 3),
m{i} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS w FROM s{i} GROUP BY 1, 2),
b{i} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.w, b.w) AS w FROM b{i - 1} b LEFT JOIN m{i} m USING (part, entry))""")
    last = ROUNDS + 1
    return "WITH " + ",\n".join(steps) + f""",
c AS (SELECT r, string_agg(printf('%02x', (best % {ENTRIES})::BIGINT), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{last} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h"""


ORACLE = _oracle()
