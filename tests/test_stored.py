"""The chunk cache, search by index, chunk answers, tokens, sessions and job reads on fixtures."""

import datetime

from pyspark.sql import functions as F

from lexmill.operators import extraction as E, relational as R, search as I
from lexmill.sources.chunk_cache import ChunkCache
from lexmill.sources.store import Store
from lexmill.streaming import jobs as J

NOON = datetime.datetime(2024, 5, 1, 12)
MINUTE = datetime.timedelta(minutes=1)


def test_chunk_cache(spark, tmp_path):
    """Unchanged texts are not chunked again, changed and expired ones are."""
    store = Store(spark, f"file://{tmp_path}/s")
    cache = ChunkCache(store, delimiter="\n", split=False)
    texts = [(1, "a\nb\nc\nd\ne"), (2, "same"), (3, "same"), (4, None), (5, "")]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert cache.refresh(df(texts), NOON) == 3 and cache.refresh(df(texts), NOON + MINUTE) == 0
    version = store._newest()
    assert sorted((r["doc_id"], r["chunk_no"], r["chunk"]) for r in cache.chunks(df(texts), NOON + 2 * MINUTE).collect()) == [(1, 1, "a\nb\nc\nd"), (1, 2, "e"), (2, 1, "same"), (3, 1, "same")]
    assert store._newest() == version  # nothing was written
    assert cache.refresh(df([(1, "a\nb"), *texts[1:]]), NOON + 50 * MINUTE) == 1
    assert cache.purge(NOON + 55 * MINUTE) == 0 and cache.purge(NOON + 61 * MINUTE) == 3
    assert store.read("chunks").count() == 1
    assert cache.refresh(df(texts), NOON + 62 * MINUTE) == 3 and cache.refresh(df([(1, "a\nb")]), NOON + 63 * MINUTE) == 0
    want = E.chunks(df(texts), delimiter="\n", split=False)
    assert sorted(map(tuple, cache.chunks(df(texts), NOON + 64 * MINUTE).collect())) == sorted(map(tuple, want.collect()))


def test_search_by_index(spark, tmp_path):
    rows = [(i, f"Paper {i} about {'WIND' if i % 7 == 0 else 'solar'} power in 100% of cases_{i}", f"s{i % 3}") for i in range(300)] + [(None, "wind without id", None), (900, None, None), (901, "wi nd", "x"), (902, "ÉTÉ indien", "y")]
    df = spark.createDataFrame(rows, "id long, text string, tag string")
    path = f"file://{tmp_path}/index"
    I.build_index(df, "id", ["text", "tag"], path)
    for query in ("wind", "WIND power", "ind%cases_2", "été", "s1", "zz", "%", "no such text", "about solar", "100"):
        got, want = (sorted(map(repr, map(tuple, x.collect()))) for x in (I.search(df, path, query, "id", ["text", "tag"]), R.search(df, query, ["text", "tag"])))
        assert got == want, query
    found = I.candidates(spark, path, "id", "wind power")
    files = spark.read.parquet(path).where(F.col("folder").isin(1, 2))
    assert found.count() == 43 and len(files.inputFiles()) <= I.FOLDERS
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "folder" in plan.split("PartitionFilters")[1][:200]
    assert I.search(df.where("false"), path, "wind", "id", ["text"]).count() == 0
    assert spark.range(1).select(F.size(I.grams(F.lit("ab"))), F.size(I.grams(F.lit(None).cast("string"))), I.grams(F.lit("AbéX"))).first()[:] == (0, 0, ["abé", "béx"])


def test_chunk_answers(spark):
    docs = spark.createDataFrame([("a", "p1\np2\np3\np4\np5", "pdf", ["TOOSHORT"]), ("b", "x", "pdf", ["UNUSABLE", "GARBLED"]), ("c", "", "html", [])], "doc_id string, text string, extraction_method string, extraction_problems array<string>")
    chunked = E.chunks(docs, delimiter="\n")
    answer = lambda doc, n: E.deliver(docs, chunked, doc, n).first()
    one = answer("a", 0)
    assert (one["chunk_no"], one["chunk"], one["total_chunks"], one["complete"], one["next_step"]) == (1, "p1\np2\np3\np4", 2, False, "get_chunk")
    end = answer("a", 3)
    assert (end["chunk"], end["complete"], end["extraction_method"], end["extraction_problems"], end["next_step"]) == (None, True, "pdf", ["TOOSHORT"], "validate_classification")
    assert answer("b", 1)["error"] == "EXTRACTION_FAILED" and answer("b", 1)["chunk"] is None
    assert answer("c", 1)["complete"] and answer("c", 1)["total_chunks"] == 0
    assert (answer("zz", 1)["error"], answer("zz", 1)["complete"]) == ("ARTICLE_NOT_FOUND", False)


def test_sessions_and_job_reads(spark):
    at = lambda day, hour: datetime.datetime(2024, 5, day, hour)
    rows = [(1, 1, at(1, 8), "purchase"), (1, 2, at(2, 8), "purchase"), (1, 3, at(2, 9), "purchase"), (2, 4, at(1, 8), "purchase"), (2, 5, at(1, 9), "signup"), (2, 6, at(1, 10), "purchase"), (3, 7, at(1, 1), "view"), (None, 8, at(1, 1), "purchase")]
    e = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, event_type string")
    got = {r["user_id"]: r["articles_processed_count"] for r in J.sessions(e).collect()}
    assert got == {1: 2, 2: 1, 3: 0, None: 1}
    newest = R.latest_events(e.withColumnRenamed("user_id", "job_id"), limit=1).collect()
    assert {(r["job_id"], r["event_id"]) for r in newest} == {(1, 3), (2, 6), (3, 7), (None, 8)}
