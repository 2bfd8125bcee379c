"""Row numbers and running sums of a whole table against plain loops, on awkward rows."""

import random

from pyspark.sql import functions as F

from lexmill.operators import numbering, relational
from lexmill.sources import readers

SCHEMA = "g string, k long, v long, __at string, n string"


def rows():
    rng = random.Random(3)
    out = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40), rng.choice([None, 1, 5]), "x", "y") for _ in range(500)]
    return out + [("hot", 7, 2, None, None)] * 400 + [("hot", None, 2, None, None)] * 3


def test_numbered_whole(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    out = numbering.numbered(df, ["k", "g"], name="n", total="total")
    got = out.orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(len(rows()))) and {r["total"] for r in got} == {len(rows())}
    low = lambda x: (x is not None, x if x is not None else 0)
    assert [low(r["k"]) for r in got] == sorted(low(r[1]) for r in rows())
    assert sorted(map(repr, ((r["g"], r["k"], r["v"], r["__at"]) for r in got))) == sorted(repr(r[:4]) for r in rows())


def test_numbered_by_group(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = numbering.numbered(df, [F.col("k").desc_nulls_last()], ["g"], "n", "total").collect()
    for g in ("a", "b", None, "hot"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["n"])
        want = sorted((r[1] for r in rows() if r[0] == g), key=lambda k: -1 if k is None else k, reverse=True)
        assert [r["n"] for r in own] == list(range(len(want))) and [r["k"] for r in own] == want and {r["total"] for r in own} == {len(want)}


def test_running_sum(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = sorted(numbering.running_sum(df.drop("n"), "v", ["g", "k"], "s").collect(), key=lambda r: r["s"])
    assert got[-1]["s"] == sum(r[2] or 0 for r in rows())
    keys = lambda g, k: (g is not None, g or "", k is not None, k or 0)
    for before, r in zip(got, got[1:], strict=False):
        assert keys(before["g"], before["k"]) <= keys(r["g"], r["k"]) and r["s"] - before["s"] in (0, r["v"] or 0)


def test_empty_page_and_batches(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert numbering.numbered(nothing, ["k"], ["g"]).count() == numbering.running_sum(nothing, "v", ["k"]).count() == relational.page(nothing, "k", 0).count() == 0
    df = spark.createDataFrame([(i, i * 3 % 50) for i in range(50)], "i int, k int").repartition(4)
    assert sorted(r["k"] for r in relational.page(df, "k", 2, 20).collect()) == list(range(40, 50))
    assert relational.page(df, "k", 9, 20).count() == 0
    found = spark.createDataFrame([(f"s{i:02}",) for i in range(12)], "slug string")
    left = readers.to_do(found, found.where("slug = 's03'")).orderBy("slug").collect()
    assert [r["batch"] for r in left] == [0] * 5 + [1] * 5 + [2]
