"""The review gate as a stream, polling into a store, and upserts of buckets."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexmill.sources.store import Conflict, Store
from lexmill.streaming import jobs as J

EVENTS = "doc_id string, ts timestamp, seq long, event string, ok boolean"
BEGIN = datetime.datetime(2024, 1, 1, 12)


@pytest.fixture
def rocksdb(spark):
    J.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def gate_events(seed=1, docs=8, n=14):
    """Events of documents, a minute apart; steps mostly in order, some not."""
    rng, rows = random.Random(seed), []
    steps = [f"{v}:{s}" for s in J.STEPS for v in ("check", "confirm")] + ["complete", "reset", "check:nothing"]
    for d in range(docs):
        for i in range(n):
            event = steps[i % len(steps)] if rng.random() < 0.8 else rng.choice(steps)
            rows.append((f"d{d}", BEGIN + datetime.timedelta(minutes=i, seconds=d), i, event, rng.random() < 0.9))
    return rows


def by_row(rows):
    return sorted((r["doc_id"], r["seq"], r["event"], r["outcome"], r["done"]) for r in rows)


def run(spark, path, batches, schema, make, tmp):
    """Write each batch as a file and process it as a micro-batch of its own."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        J.start_to_end(make(J.read_event_stream(spark, f"{path}/in", spark.createDataFrame([], schema).schema)), f"{path}/out", f"{path}/cp").awaitTermination()
    return spark.read.schema(J.OUTCOME).parquet(f"{path}/out").collect() if not out else out


def test_gate_in_event_time(spark, tmp_path, rocksdb):
    """Events that come out of order and in later micro-batches count where they belong: outcomes are
    those of the batch query. The last batch moves the watermark on."""
    rows = gate_events()
    rng = random.Random(2)
    late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rng.uniform(0, 8)))
    batches = [late[i : i + 30] for i in range(0, len(late), 30)]
    batches.append([("end", BEGIN + datetime.timedelta(hours=3), 0, "reset", True)])
    got = run(spark, f"file://{tmp_path}", batches, EVENTS, J.review_gate_stream, tmp_path)
    want = J.review_gate(spark.createDataFrame(rows, EVENTS), ("ts", "seq")).collect()
    assert by_row(r for r in got if r["doc_id"] != "end") == by_row(want) and len(want) == len(rows)


def test_gate_forgets(spark, tmp_path, rocksdb):
    """A document without events for the time that is remembered begins anew."""
    at = lambda hours: BEGIN + datetime.timedelta(hours=hours)
    batches = [[("d", at(0), 0, "check:fields", True), ("d", at(0.1), 1, "confirm:fields", True)], [("x", at(9), 0, "reset", True)], [("x", at(10), 1, "reset", True)], [("d", at(11), 2, "check:warnings", True)], [("x", at(30), 2, "reset", True)]]
    got = run(spark, f"file://{tmp_path}", batches, EVENTS, lambda e: J.review_gate_stream(e, remembered="5 hours"), tmp_path)
    outcomes = {r["seq"]: (r["outcome"], r["done"]) for r in got if r["doc_id"] == "d"}
    assert outcomes == {0: ("ok", ""), 1: ("ok", "fields"), 2: ("PREREQUISITE_MISSING", "")}


def test_gate_of_documents_and_nulls(spark):
    rows = [(None, 0, "check:fields", True), (None, 1, "confirm:fields", True), ("a", 0, "confirm:fields", True), ("a", 1, "check:fields", None), ("a", 2, "confirm:fields", None)]
    got = by_row(r for r in J.review_gate(spark.createDataFrame(rows, "doc_id string, seq long, event string, ok boolean")).where("doc_id is not null").collect())
    assert [g[3] for g in got] == ["PREREQUISITE_MISSING", "ok", "ISSUES_NOT_ADDRESSED"]


JOBS = "id long, ts timestamp, status string"


def test_polling_is_exactly_once(spark, tmp_path):
    """A crash after publishing and before the stream's own commit repeats the batch, which then changes
    nothing; older rows never replace newer ones."""
    store, path = Store(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}"
    at = lambda m: BEGIN + datetime.timedelta(minutes=m)
    batches = [[(1, at(1), "pending"), (2, at(2), "running"), (1, at(3), "running")], [(1, at(9), "completed"), (2, at(0), "pending"), (3, at(4), "pending")]]

    class Crash(RuntimeError):
        pass

    class Fragile(Store):
        def upsert(self, *args, **kwargs):
            super().upsert(*args, **kwargs)
            raise Crash("after the publication")

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, JOBS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = lambda: J.read_event_stream(spark, f"{path}/in", spark.createDataFrame([], JOBS).schema)
        with pytest.raises(Exception, match="after the publication"):
            J.poll(stream(), Fragile(spark, store.root), "jobs", ["id"], f"{path}/cp").awaitTermination()
        before = store._newest()
        J.poll(stream(), store, "jobs", ["id"], f"{path}/cp").awaitTermination()
        assert store._newest() == before == i + 1  # the repeated batch published nothing
    assert sorted((r["id"], r["status"]) for r in store.read("jobs").collect()) == [(1, "completed"), (2, "running"), (3, "pending")]


def test_upsert_writes_touched_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    base = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.col("id").alias("w"))
    assert len(store.upsert("t", base, ["k"])) == 64
    before = dict(store.manifest()["t"]["parts"])
    change = spark.createDataFrame([(5, "new", -1), (5000, "added", -2), (None, "null", -3), (None, "null", -3)], "k long, v string, w long")
    touched = store.upsert("t", change, ["k"], updated=["v"])
    after = store.manifest()["t"]["parts"]
    assert len(touched) == 3 and sorted(int(b) for b in after if after[b] != before.get(b)) == touched
    rows = {r["k"]: (r["v"], r["w"]) for r in store.read("t").collect()}
    assert rows[5] == ("new", 5) and rows[5000] == ("added", -2) and rows[None] == ("null", -3) and rows[6] == ("old", 6) and len(rows) == 2002
    assert store.read("t").count() == 2002 and store.upsert("t", change.where("false"), ["k"]) == []
    with pytest.raises(ValueError):
        store.upsert("t", change, ["v"])
    store.upsert("t", spark.createDataFrame([(None, "again", -9), (7, "seven", 3)], "k long, v string, w long"), ["k"])
    rows = {r["k"]: (r["v"], r["w"]) for r in store.read("t").collect()}
    assert rows[None] == ("again", -9) and rows[7] == ("seven", 3) and len(rows) == 2002
    other = Store(spark, store.root)
    other._newest = lambda: store._newest() - 1
    with pytest.raises(Conflict):
        other.upsert("t", change, ["k"])
