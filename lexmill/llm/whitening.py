"""Embedding whitening from an exact scatter matrix in residue numbers.

Entries become integers. Each partition multiplies its vectors by themselves modulo several primes
(double-precision products that stay exact), Spark sums the residues, and the Chinese remainder
theorem gives the exact sums of all entries and of all products. The covariance is exact up to one
rounding, and a double eigendecomposition of it gives the components.

Defined cases: a vector that is null, empty, or has a null or non-finite entry, or one too large for
a long once scaled, is dropped; so is one whose length is not the commonest (of distinct vectors;
ties: the longer); a vector that repeats counts once for the fit and is whitened each time; ids may
be null or repeat; a component whose variance is under LEAST of the first one's is rounding alone
and is not returned, so equal vectors, a single one or an empty table give no components; columns of
any name pass through, but those the operator adds replace columns of their names. The matrix of one
number for each pair of dimensions goes through the driver, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from lexmill.session import free, stash

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Residues are under 2**19 in size and a block has at most 2**15 vectors: its products' sums are exact doubles.
PRIMES_BELOW, BLOCK = 1 << 20, 1 << 15
LARGEST, LEAST = 2.0**61, 1e-9


def primes(product: int, below: int = PRIMES_BELOW) -> list[int]:
    """The largest primes under `below` whose product exceeds `product`."""
    out: list[int] = []
    at = below
    while prod(out) <= product:
        at -= 1
        if at % 2 and all(at % f for f in range(3, int(at**0.5) + 1, 2)):
            out.append(at)
    return out


def usable(column: Column, scale: int = SCALE) -> Column:
    """Whether a vector has entries, all of them finite numbers that fit."""
    fits = lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False))
    return column.isNotNull() & (F.size(column) > 0) & F.coalesce(F.forall(column, fits), F.lit(False))


def whole(column: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """The integers floor(scale * entry) + offset of a usable vector."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column of vectors of `width` entries as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def residues(x: np.ndarray, shift: int, prime: int) -> np.ndarray:
    """x - shift modulo prime, in the range around zero, as doubles; with a first column of ones."""
    half = prime // 2
    r = (np.remainder(x, prime) + (half - shift) % prime) % prime - half
    return np.hstack([np.ones((len(x), 1)), r.astype(np.float64)])


def scatter(fit: DataFrame, column: str, width: int, shift: int, moduli: list[int]) -> list[list[int]]:
    """Exact sums over fit of all products of (1, entries - shift), from residues by the Chinese
    remainder theorem."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(moduli), width + 1, width + 1), np.int64)
        seen = False
        for batch in batches:
            x = rows_of(batch.column(0), width)
            for at in range(0, len(x), BLOCK):
                seen = True
                for k, p in enumerate(moduli):
                    r = residues(x[at : at + BLOCK], shift, p)
                    held[k] = (held[k] + (r.T @ r).astype(np.int64)) % p
        if seen:
            for k in range(len(moduli)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, k, np.int32)), pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(list(held[k]))], ["prime", "line", "sums"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        # As many rows as there were partitions; a line is a vector's length.
        p = moduli[key[0].as_py()]
        total = np.zeros(width + 1, np.int64)
        for chunk in table.column("sums").chunks:
            total = (total + rows_of(chunk, width + 1).sum(axis=0)) % p
        return pa.table({"prime": [key[0].as_py()], "line": [key[1].as_py()], "sums": [total]}, schema=pa.schema([("prime", pa.int32()), ("line", pa.int32()), ("sums", pa.list_(pa.int64()))]))

    shape = "prime int, line int, sums array<long>"
    lines = fit.select(column).mapInArrow(part, shape).groupBy("prime", "line").applyInArrow(added, shape).collect()
    modulus = prod(moduli)
    out = np.zeros((width + 1, width + 1), object)
    for row in lines:
        p = moduli[row["prime"]]
        rest = modulus // p
        out[row["line"]] += np.array(row["sums"], object) * (rest * pow(rest, -1, p))
    out %= modulus
    return np.where(out > modulus // 2, out - modulus, out).tolist()


@dataclass
class Whitening:
    """Fitted components of integer vectors; rows of `axes` are unit eigenvectors."""

    width: int
    n: int
    sums: list[int]
    reach: int
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - sums, exactly: longs, or Python's integers where longs could overflow."""
        small = (self.n * self.reach) ** 2 * self.width < 1 << 62 and max(map(abs, self.sums)) < 1 << 62
        kind = np.int64 if small else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared length of n*x - sums (exact) and the whitened vector of each row."""
        off = self.deviations(x)
        return (off * off).sum(axis=1), (off / self.n).astype(np.float64) @ (self.axes / np.sqrt(self.variances)[:, None]).T


def fit(vectors: DataFrame, column: str, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of integer vectors, each distinct one counted once; None if there are none."""
    distinct = stash(vectors.select(F.col(column).alias("x")).distinct(), "whitening")
    shape = distinct.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"))
    shape = shape.orderBy(F.col("n").desc(), F.col("width").desc()).limit(1).collect()
    if not shape:
        return None
    width, n, low, high = shape[0]
    distinct = distinct.where(F.size("x") == width)
    shift = (low + high) // 2
    size = max(high - shift, shift - low, 1)
    sums = scatter(distinct, "x", width, shift, primes(2 * n * size * size))
    total, products = sums[0][1:], [line[1:] for line in sums[1:]]
    exact = n * np.array(products, object) - np.multiply.outer(np.array(total, object), np.array(total, object))
    covariance = np.array([[int(e) / (n * n) for e in line] for line in exact])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes.T[::-1]
    kept = min(components, int((values > max(values[0], 0) * LEAST).sum())) if values[0] > 0 else 0
    axes = axes[:kept] * np.sign(axes[np.arange(kept), np.abs(axes[:kept]).argmax(axis=1)])[:, None]
    trace = sum(int(exact[i][i]) for i in range(width)) / (n * n)
    model = Whitening(width, n, [int(t) + n * shift for t in total], high - low, axes, values[:kept], values[:kept] / trace if trace else values[:kept])
    model.identity_error = identity_error(distinct, model) if kept else 0.0
    return model


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of whitened vectors minus the identity, measured."""
    k = len(model.variances)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k + 1, k + 1))
        for batch in batches:
            _, z = model.apply(rows_of(batch.column(0), model.width))
            z = np.hstack([np.ones((len(z), 1)), z])
            held += z.T @ z
        i, j = np.indices(held.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(held.ravel())], ["i", "j", "sum"])

    sums = np.zeros((k + 1, k + 1))
    for row in fit.select("x").mapInArrow(part, "i int, j int, sum double").groupBy("i", "j").agg(F.sum("sum").alias("sum")).collect():  # (k+1)^2 rows
        sums[row["i"], row["j"]] = row["sum"]
    means = sums[0, 1:] / model.n
    return float(np.abs(sums[1:, 1:] / model.n - np.outer(means, means) - np.eye(k)).max())


def whiten(df: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, name: str = "whitened", deviation: str = "deviation") -> tuple[DataFrame, Whitening | None]:
    """Rows of df that are usable, with `whitened` (an array of doubles, a component each) and
    `deviation` (the exact squared length of n*x - S; null if beyond a long); and the model."""
    kept = [c for c in df.columns if c not in (name, deviation)]
    (x,) = free(df, "x")
    integers = df.select(*kept, F.when(usable(F.col(column), scale), whole(F.col(column), scale, offset)).alias(x)).where(F.col(x).isNotNull())
    model = fit(integers, x, components)
    shape = StructType([*df.select(*kept).schema.fields]).add(name, ArrayType(DoubleType())).add(deviation, "long")
    if model is None:
        return df.sparkSession.createDataFrame([], shape), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, z = model.apply(rows_of(batch.column(len(kept)), model.width))
            far = pa.array([int(f) if f < 1 << 63 else None for f in far] if far.dtype == object else far, pa.int64())
            flat = pa.array(z.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, far], [*kept, name, deviation])

    return integers.where(F.size(x) == model.width).mapInArrow(run, shape), model


def op11(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    whitened, model = whiten(vectors.select("vec_id", "embedding"))
    each = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]) if model is not None and len(model.explained) else F.array().cast("array<double>")
    n, error = (model.n, model.identity_error) if model is not None else (0, 0.0)
    return each.select("vec_id", (F.col("component") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))
