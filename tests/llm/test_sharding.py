"""Minimax shards against a plain search over all bounds, and the registered query against its SQL."""

import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.llm import sharding

SCHEMA = "doc_id long, text string, __digest string, shard string"


def texts(seed=4, n=150):
    rng = random.Random(seed)
    out = [(i, "é" * rng.randint(0, 9) + "w" * rng.randint(0, 60) + str(i % 90), "d", "s") for i in range(n)]
    return out + [(900, None, "d", "s"), (901, "", None, None), (None, "no id", "d", "s"), (None, "no id", "d", "s"), (7, "id again", "d", "s")] + [(1000 + i, "hot copy of a page", "d", "s") for i in range(160)]


def smallest(sizes, shards):
    """The least capacity of contiguous runs, by trying every one."""
    for capacity in range(max(sizes), sum(sizes) + 1):
        runs, held = 1, 0
        for s in sizes:
            if held + s > capacity:
                runs, held = runs + 1, 0
            held += s
        if runs <= shards:
            return capacity


def test_shards_are_minimax(spark):
    rows = texts()
    out, capacity = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "__digest", "size", "shard", "slot"] and len(got) == len(rows)
    own = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        own.setdefault(r["text"] or "", set()).add(r["shard"])
        assert r["__digest"] in ("d", None)
    assert all(len(s) == 1 for s in own.values())
    total, groups = sum(r["size"] for r in got), {}
    for r in got:
        groups[r["text"] or ""] = groups.get(r["text"] or "", 0) + r["size"]
    import hashlib

    sizeable = -(-total // (8 * sharding.SIZEABLE))
    ordered = sorted(groups, key=lambda t: (-groups[t] if groups[t] >= sizeable else 0, hashlib.md5(t.encode()).hexdigest()))
    assert capacity == smallest([groups[t] for t in ordered], 8)
    by = {k: [r for r in got if r["shard"] == k] for k in range(8)}
    assert all(by.values()) and max(sum(r["size"] for r in s) for s in by.values()) <= capacity
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    in_order = [own[t] for t in ordered]
    assert in_order == sorted(in_order, key=min)  # contiguous
    # The hot group exceeds an even share; the other shards are near to even.
    rest = sorted(sum(r["size"] for r in s) for s in by.values())[:-1]
    assert rest[-1] - rest[0] <= 2 * max(v for t, v in groups.items() if t != "hot copy of a page")


@pytest.mark.parametrize("seed", range(3))
def test_capacity_by_few_and_many_doublings(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 30, rng.randint(1, 400)]) for _ in range(rng.choice([3, 40, 200]))]
    groups = spark.createDataFrame([(f"{i:04}", s) for i, s in enumerate(sizes)], "key string, size long")
    runs = sharding.Runs(groups, 5)
    ordered = sorted(range(len(sizes)), key=lambda i: (-sizes[i] if sizes[i] >= -(-sum(sizes) // 80) else 0, i))
    want = smallest([sizes[i] for i in ordered], 5)
    assert runs.capacity(1) == runs.capacity(14) == want
    assert runs.holds([want - 1, want] if want > max(sizes) else [want])[-1]
    cuts = [0, *runs.cuts(want), sum(sizes)]
    assert max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) <= want


def test_few_and_no_documents(spark):
    few = spark.createDataFrame([(1, "a", "d", "s"), (2, "b", "d", "s"), (3, "a", "d", "s")], SCHEMA)
    out, capacity = sharding.shard(few)
    assert capacity == 4 and sorted((r["doc_id"], r["slot"]) for r in out.collect() if r["text"] == "a") == [(1, 0), (3, 1)]
    assert sharding.shard(few.where("false"))[0].count() == 0 and sharding.op13(spark, few.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)] * 4, SCHEMA)
    assert sorted(r["slot"] for r in sharding.op13(spark, nulls).collect()) == [0, 1, 2, 3]


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = "doc_id size text_crc32 law shard slot grown_shard".split()
    got = entry.queries()["op13_sharding"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    want = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()['op13_sharding']})").fetchall()
    rows = got.select(*columns).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    of = dict(con.execute("select doc_id, text from documents").fetchall())
    assert all(r["text_crc32"] == zlib.crc32((of[r["doc_id"]] or "").encode()) for r in rows)
