"""Whitening and vector codes against plain loops over awkward vectors."""

from fractions import Fraction
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.llm import codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, __x int, x string"


def vectors(seed=5, n=300, width=24):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 0.2) * (1 + j % 5) for j in range(width)], i % 4 or None, 1, "z") for i in range(n)]
    out += [(5000 + i, out[3][1], 2, 1, "z") for i in range(150)] + [(None, out[4][1], 1, 1, "z"), (7, out[9][1], 1, 1, "z"), (7, out[7][1], 0, 1, "z")]
    bad = [None, [], [1.0, None] * (width // 2), [float("nan")] * width, [float("inf")] * width, [0.5] * (width - 1), [1e38] * width]
    return out + [(9000 + i, v, 3, None, None) for i, v in enumerate(bad)]


def kept(rows):
    return [r for r in rows if r[1] and len(r[1]) == 24 and all(c is not None and abs(c) < 1e30 for c in r[1])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(4).cache()


def as_float(v):
    return [float(np.float32(c)) for c in v]


def test_primes_and_residues():
    found = whitening.primes(1 << 70)
    assert len(set(found)) == 4 and np.prod(np.array(found, object)) > 1 << 70
    assert all(pow(2, p - 1, p) == 1 and p < 1 << 20 for p in found)
    x = np.array([[-(1 << 60), 5, (1 << 60) + 3]])
    for p in found:
        r = whitening.residues(x, 77, p)
        assert (np.abs(r) <= p // 2).all() and [(int(a) - (int(b) - 77)) % p for a, b in zip(r[0, 1:], x[0], strict=True)] == [0, 0, 0]


def test_scatter_is_exact(spark):
    rng = random.Random(1)
    rows = [[rng.randint(-(1 << 55), 1 << 55) for _ in range(6)] for _ in range(400)]
    data = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(7)
    got = whitening.scatter(data, "x", 6, 12345, whitening.primes(2 * 400 * (1 << 112)))
    full = [[1, *(v - 12345 for v in r)] for r in rows]
    assert got == [[sum(r[i] * r[j] for r in full) for j in range(7)] for i in range(7)]


def test_whitening(spark, df):
    rows = kept(vectors())
    x = [[int(np.floor(c * 64)) + 1_000_000 for c in as_float(r[1])] for r in rows]
    own = sorted(set(map(tuple, x)))
    n, sums = len(own), [sum(c) for c in zip(*own, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(v, mean, strict=True)] for v in own])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    got = whitening.op11(spark, df).collect()
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    want = {}
    for r, v in zip(rows, x, strict=True):
        want[(r[0], sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)))] = [float(c - m) for c, m in zip(v, mean, strict=True)]
    assert by.keys() == want.keys() and len(got) == 16 * len(rows)
    for key, off in want.items():
        for k in range(16):
            r, value = by[key][k + 1], values[-1 - k]
            assert r["n"] == n and abs(r["explained"] / (value / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
            assert abs(abs(r["whitened"]) - abs(np.dot(off, axes[:, -1 - k]) / np.sqrt(value))) < 1e-7


def test_general_interface_and_names(spark, df):
    out, model = whitening.whiten(df, components=5)
    assert out.columns == [*df.columns, "whitened", "deviation"] and out.count() == len(kept(vectors()))
    assert {len(r["whitened"]) for r in out.collect()} == {5} and np.allclose(model.axes @ model.axes.T, np.eye(5))
    assert out.where("__x = 1 and x = 'z'").count() == len(kept(vectors()))


def test_large_deviations(spark):
    big = spark.createDataFrame([(i, [float(v), 1.0]) for i, v in enumerate([2.0**50, -(2.0**50), 3.0, 4.0])], "vec_id long, embedding array<double>")
    out, model = whitening.whiten(big)
    x = [[int(v * 64) + 1_000_000, 1_000_064] for v in (2.0**50, -(2.0**50), 3.0, 4.0)]
    want = {sum((4 * a - s) ** 2 for a, s in zip(v, map(sum, zip(*x, strict=True)), strict=True)) for v in x}
    assert len(model.variances) == 1 and {r["deviation"] for r in out.collect()} == {v if v < 1 << 63 else None for v in want}
    assert whitening.fit(big.select(F.array(F.lit(3).cast("long")).alias("x")), "x").variances.size == 0  # equal vectors


@pytest.mark.parametrize("what", ["empty", "unusable"])
def test_nothing(spark, df, what):
    none = df.where("vec_id >= 9000 and vec_id <> 9005") if what == "unusable" else df.where("false")
    assert whitening.op11(spark, none).count() == 0 and codes.op12(spark, none).count() == 0
    assert codes.compress(none)[0].columns == [*df.columns, "codes", "error"]


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks by the definition, in Python's integers."""
    x = [[int(np.floor(c * 4096)) for c in as_float(r[1])] for r in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    w = len(x[0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(x[i], p) for i in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        codes_ = [[nearest(v, p)[1] for p in range(parts)] for v in x]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for v, c in zip(x, codes_, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    final = [[nearest(v, p) for p in range(parts)] for v in x]
    return ["".join(f"{k:02x}" for _, k in f) for f in final], [sum(d for d, _ in f) for f in final], books


@pytest.mark.parametrize("n", [9, 1000])
def test_codes(spark, df, n):
    rows = kept(vectors())
    rows = rows[:n]
    code, error, books = lloyd(rows)
    by_label = {}
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    got = codes.op12(spark, spark.createDataFrame(rows, SCHEMA) if n == 9 else df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], c, e, by_label[r[2]], digest)) for r, c, e in zip(rows, code, error, strict=True))


def test_codes_of_all_sizes():
    """Doubles, longs and Python's integers give the same nearest entries."""
    rng = random.Random(2)
    for reach in (50, 1 << 24, 1 << 27, 1 << 40):
        x = np.array([[rng.randint(-reach, reach) for _ in range(8)] for _ in range(40)])
        books = codes.Codebooks([[[rng.randint(-reach, reach) for _ in range(4)] for _ in range(5)] for _ in range(2)])
        got, far = books.nearest(x)
        for v, g, f in zip(x.tolist(), got, far, strict=True):
            for p in range(2):
                want = min((sum((a - b) ** 2 for a, b in zip(v[p * 4 : p * 4 + 4], e, strict=True)), k) for k, e in enumerate(books.books[p]))
                assert (int(f[p]), int(g[p])) == want


def test_rounds_shuffle_only_changes(spark, df):
    """Later rounds send contributions of changed parts alone, and join without a shuffle."""
    rows = df.where("vec_id < 300 and vec_id is not null").select("embedding").withColumn("row", F.monotonically_increasing_id())
    x = codes.integers(F.col("embedding"), 24)
    n = codes.partitions(spark)
    table = codes.bucketed(rows.select("row", x.alias("x")).repartition(n, "row"), "row", n, "test")
    first = [r["x"] for r in table.orderBy("x").limit(16).collect()]
    books = codes.Codebooks([[v[p * 3 : p * 3 + 3] for v in first] for p in range(8)])
    one = codes.reassign(table, None, books, n)
    known = one.where("codes is not null").select("row", "codes")
    again = codes.reassign(table, known, books, n)
    assert again.where("codes is null").count() == 0 and again.count() == table.count() == known.count()
    assert one.where("codes is null").agg(F.sum(F.element_at("low", -1))).first()[0] == 8 * table.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.join(known, "row")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(entry.oracle_sql()["op12_vector_codes"]).fetchall()
    got = entry.queries()["op12_vector_codes"](spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
