from pyspark.sql import functions as F

from lexmill.api import Workbench

ARTICLES = "id string, processing_status string, created_at string, source_title string, source_url string, method string, voice string, peer_reviewed boolean, processing_flags array<string>, processing_notes string, processed_at timestamp, updated_at timestamp"


def test_loop(spark):
    rows = [("a", "pending", "2020", "T a", None, None, None, None, [], None, None, None), ("b", "pending", "2019", "T b", None, None, None, None, [], None, None, None)]
    state = spark.createDataFrame([(1, 0, 2, None, None)], "id int, articles_processed_count int, human_review_interval int, last_reset_at timestamp, last_reset_date date")
    w = Workbench({"articles": spark.createDataFrame(rows, ARTICLES), "session": state}, now=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    first = w.get_next_article().first()
    assert (first["id"], first["outcome"]) == ("b", "ok")
    assert w["articles"].where("id = 'b'").first()["processing_status"] == "in_progress"
    save = [("b", None, [("TBL", "one table")], True, True, True, True, "empirical", "academic", True), ("a", None, [("NOPE", "x")], True, True, True, True, "empirical", "academic", True)]
    s = spark.createDataFrame(save, "article_id string, token_error string, flags array<struct<code:string,detail:string>>, exists boolean, open_access boolean, has_source boolean, has_full_text boolean, method string, voice string, peer_reviewed boolean")
    pairs = spark.createDataFrame([("b", "One two three 5.", "Un deux trois.")], "article_id string, source_text string, target_text string")
    out = {r["article_id"]: (r["decision"], r["notes"]) for r in w.save_article(s, pairs).collect()}
    assert out["b"][0] == "QUALITY_CHECK_FAILED" and out["a"][0] == "INVALID_FLAGS"
    pairs = spark.createDataFrame([("b", "One two three 5.", "Un deux trois quatre.")], "article_id string, source_text string, target_text string")
    out = {r["article_id"]: (r["decision"], r["notes"]) for r in w.save_article(s, pairs).collect()}
    assert out["b"] == ("accepted", "[TBL] one table; [QUALITY] Auto-detected: STATMIS")
    done = w["articles"].where("id = 'b'").first()
    assert done["processing_status"] == "translated" and done["processing_flags"] == ["TBL", "STATMIS"]
    w.skip_article("a", "PAYWALL")
    assert {r["status"]: r["n"] for r in w.get_progress().collect()}["skipped"] == 1
    assert w.get_next_article().first()["outcome"] in ("COMPLETE", "SESSION_PAUSE")
