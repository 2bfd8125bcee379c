"""Every tool of the workbench, pauses and saves; the store after crashes; HTML of any depth."""

import pytest
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.api import Workbench
from lexmill.functions import html as H
from lexmill.sources.store import Conflict, Store



def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


ARTICLE = "id string, processing_status string, created_at string, source_title string, source_url string, method string, voice string, peer_reviewed boolean, processing_flags array<string>, processing_notes string, extraction_method string, processed_at timestamp, updated_at timestamp"
SAVE = "article_id string, token_error string, flags array<struct<code:string,detail:string>>, exists boolean, open_access boolean, has_source boolean, has_full_text boolean, method string, voice string, peer_reviewed boolean, primary_category string, secondary_categories array<string>, keywords array<string>, token string, translated_title string, translated_full_text string, extraction_method string"


def bench(spark, processed=0, **more):
    rows = [(k, "pending", str(2020 + n), f"Title {k}", None, None, None, None, [], None, None, None, None) for n, k in enumerate("abc")]
    state = spark.createDataFrame([(1, processed, 2, None, None)], schemas.TABLES["session_state"]).withColumn("last_reset_date", F.to_date(now()))
    return Workbench({"articles": spark.createDataFrame(rows, ARTICLE), "session": state, **more}, now=now())


def test_a_pause_claims_nothing(spark):
    w = bench(spark, processed=2)
    r = w.get_next_article().first()
    assert (r["outcome"], r["id"], r["articles_processed"]) == ("SESSION_PAUSE", None, 2)
    assert w["articles"].where("processing_status = 'in_progress'").isEmpty()
    w.reset_session_counter()
    r = w.get_next_article().first()
    assert (r["outcome"], r["id"]) == ("ok", "a") and r["progress"]["in_progress"] == 1
    w.set_human_review_interval(1)
    assert w["session"].first()["human_review_interval"] == 1
    with pytest.raises(ValueError):
        w.set_human_review_interval(21)


def test_a_save_writes_all_or_nothing(spark):
    empty = {n: schemas.empty(spark, n) for n in ("translations", "article_categories", "keywords", "article_keywords")}
    tokens = spark.createDataFrame([("t1", "a", "{}", "2024", 0), ("t2", "b", "{}", "2024", 0)], "token string, article_id string, classification_data string, created_at string, used int")
    w = bench(spark, **empty, tokens=tokens)
    row = lambda k, token, error: (k, error, [("TBL", "one table")], True, True, True, True, "empirical", "academic", True, "education", ["support"], ["k1", "k2"], token, "Titre", "Un deux trois.", "html")
    s = spark.createDataFrame([row("a", "t1", None), row("b", "t2", "INVALID_TOKEN: used")], SAVE)
    pairs = spark.createDataFrame([(k, "One two three.", "Un deux trois.") for k in "ab"], "article_id string, source_text string, target_text string")
    out = {r["article_id"]: r["decision"] for r in w.save_article(s, pairs).collect()}
    assert out == {"a": "accepted", "b": "INVALID_TOKEN: used"}
    done = {r["id"]: r for r in w["articles"].collect()}
    assert done["a"]["processing_status"] == "translated" and done["a"]["extraction_method"] == "html" and done["b"]["processing_status"] == "pending"
    assert [(r["article_id"], r["target_language"], r["translated_title"], r["status"]) for r in w["translations"].collect()] == [("a", "fr", "Titre", "translated")]
    assert {r["token"]: r["used"] for r in w["tokens"].collect()} == {"t1": 1, "t2": 0}
    assert {(r["article_id"], r["category_id"], r["is_primary"]) for r in w["article_categories"].collect()} == {("a", "education", 1), ("a", "support", 0)}
    assert w["keywords"].count() == 2 and w["article_keywords"].count() == 2
    assert w["session"].first()["articles_processed_count"] == 1  # one accepted row


def test_every_tool(spark, tmp_path):
    blocks = spark.createDataFrame([("d", 0, "SectionHeader", "<h1>A Title</h1>", 0, {}), ("d", 1, "SectionHeader", "<h2>Introduction</h2>", 0, {}), ("d", 2, "Text", "<p>Body of the text.</p>", 0, {}), ("d", 3, "SectionHeader", "<h2>References</h2>", 1, {}), ("d", 4, "Footnote", "<p>A reference that is long enough.</p>", 1, {})], "doc_id string, pos int, block_type string, html string, page int, images map<string,string>")
    texts = spark.createDataFrame([("a", "One paragraph about avoidance.\n\nTwo.")], "doc_id string, text string")
    paragraphs = spark.createDataFrame([("d", n, "p", t) for n, t in enumerate(["A paragraph that ends well, F(1, 2) = 3.1 here.", "continues in lower case letters here."])], "doc_id string, pos int, tag string, text string")
    gate = spark.createDataFrame([("d", 0, "check:fields", True), ("d", 1, "complete", True)], "doc_id string, seq long, event string, ok boolean")
    from lexmill.operators import glossary as G

    terms = G.index(spark.createDataFrame([(0, "avoidance", "évitement", None, None, None)], "ord int, en string, fr string, fr_alt array<string>, abbreviation string, note string"))
    w = bench(spark, texts=texts, paragraphs=paragraphs, gate=gate)
    w.glossary = terms
    assert set(w.get_taxonomy()) == {"methods", "voices", "categories", "flags"}
    assert w.get_chunk("a", 1).first()["terms"] == {"avoidance": "évitement"}
    rows = spark.createDataFrame([("a", "empirical", "academic", "education", [], [f"k{i}" for i in range(5)])], "article_id string, method string, voice string, primary_category string, secondary_categories array<string>, keywords array<string>")
    assert w.validate_classification(rows).first()["valid"]
    w.ingest_article(spark.createDataFrame([("z", "pending"), ("a", "pending")], "id string, processing_status string"))
    assert w["articles"].count() == 4 and w.search_article_url("title B").first()["id"] == "b"
    w.set_article_url("b", "https://x/y")
    assert w["articles"].where("id = 'b'").first()["source_url"] == "https://x/y"
    with pytest.raises(ValueError):
        w.skip_article("b", "NOPE")
    w.skip_article("b", "PAYWALL")
    assert {r["status"]: r["n"] for r in w.get_progress().collect()}["skipped"] == 1
    found = spark.createDataFrame([("s1.pdf", "s1"), ("s2.pdf", "s2")], "name string, slug string")
    fresh, known = w.list_intake(found, found.where("slug = 's1'"))
    assert (fresh.first()["slug"], known.first()["slug"]) == ("s2", "s1") and w.find_file(found, "s2.pdf").first()["outcome"] == "FOUND"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "One Two.json").write_text("{}")
    assert w.list_raw_outputs(f"file://{tmp_path}/raw").first()["slug"] == "one-two"
    assert w.parse_blocks(blocks).first()["title"] == "A Title"
    assert {r["stage"]: r["n"] for r in w.get_preprocessing_status().collect()} == {"cache": 1}
    assert w.get_article_for_review("d").count() == 5
    review = spark.createDataFrame([("T", "A", "2019", "empirical", "academic", "", True)], "title string, authors string, year string, method string, voice string, abstract string, abstract_confirmed boolean")
    assert w.complete_article_review(review).first()["errors"] == []
    page = w.get_body_for_review("d").collect()
    assert len(page) == 2 and page[0]["total"] == 1 and page[1]["issues"] == ["ORPHAN"]
    with pytest.raises(ValueError, match="INVALID_CHUNK"):
        w.get_body_for_review("d", 1)
    assert {r["field"]: r["status"] for r in w.check_fields().collect()}["authors"] == "missing"
    overrides = spark.createDataFrame([("d", False, None, "A. Author", None, None, None)], "doc_id string, all_fields_ok boolean, title string, authors string, year string, citation string, abstract string")
    assert w.confirm_fields(overrides).isEmpty() and w["parsed"].first()["authors"] == "A. Author"
    assert w.check_warnings().first()["total"] == 4 and w.check_references().first()["hints"] == ["A reference that is long enough."]
    w.confirm_references(spark.createDataFrame([("d", ["More"])], "doc_id string, additional array<string>"))
    assert w["parsed"].first()["references"] == ["More"] and w.check_formulas().first()["unwrapped"] == ["F(1, 2) = 3.1"]
    w.confirm_formulas(spark.createDataFrame([("d", 0, "F(1, 2) = 3.1")], "doc_id string, pos int, formula string"))
    assert '<span class="formula">F(1, 2) = 3.1</span>' in w["paragraphs"].orderBy("pos").first()["text"]
    assert [r["outcome"] for r in w.gate_outcomes().orderBy("seq").collect()] == ["ok", "INCOMPLETE_CHECKS"]
    none = spark.createDataFrame([], "doc_id string, pos int, action string, text string")
    assert w.complete_body_review(none, none.select("doc_id", "pos")).count() > 0 and w["paragraphs"].count() == 2
    fixes = spark.createDataFrame([("d", 1, "join_previous", None)], "doc_id string, pos int, action string, text string")
    seen = spark.createDataFrame([("d", 0)], "doc_id string, pos int")
    assert w.complete_body_review(fixes, seen).isEmpty() and w["paragraphs"].count() == 1
    w.publish_parsed(spark.createDataFrame([("d",)], "doc_id string"))
    assert {r["stage"]: r["n"] for r in w.get_preprocessing_status().collect()} == {"ready": 1}
    store = Store(spark, f"file://{tmp_path}/db")
    w.tables = {k: w[k] for k in ("articles", "session")}
    w.commit(store)
    assert store.read("articles").count() == 4


class Failing:
    """A file system that fails at one of its operations."""

    def __init__(self, fs, at):
        self.fs, self.at = fs, at

    def __getattr__(self, name):
        if name == self.at:
            raise OSError(f"crash at {name}")
        return getattr(self.fs, name)


@pytest.mark.parametrize("at", ["create", "exists", "rename", "check"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, at):
    root = f"file://{tmp_path}/db"
    store = Store(spark, root)
    store.publish({"t": spark.range(3), "u": spark.range(1)})
    own = Store._fs

    def stop():
        if at == "check":
            raise OSError("crash before the manifest")

    monkeypatch.setattr(Store, "_fs", lambda self: (lambda fs, jvm: (Failing(fs, at), jvm))(*own(self)))
    with pytest.raises(OSError):
        store.publish({"t": spark.range(9)}, stop)
    monkeypatch.setattr(Store, "_fs", own)
    assert Store(spark, root).read("t").count() == 3 and Store(spark, root).read("u").count() == 1
    store.publish({"t": spark.range(5)})
    assert store.read("t").count() == 5 and set(store.manifest()) == {"t", "u"}


def test_two_writers_conflict(spark, tmp_path):
    one, two = Store(spark, f"file://{tmp_path}/db"), Store(spark, f"file://{tmp_path}/db")
    one.publish({"t": spark.range(1)})
    with pytest.raises(Conflict):
        one.publish({"t": spark.range(2)}, check=lambda: two.publish({"u": spark.range(7)}))
    assert one.read("t").count() == 1 and one.read("u").count() == 7


@pytest.mark.parametrize("source", ["<p>x" * 100_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<li>x</q>" * 50_000])
def test_html_of_any_depth(source):
    assert H.page_text(source).count("x") == source.count("x") and H.element_text(source).count("x") == source.count("x")
    assert len(H.elements(source)) <= 1 and H.article(source)["title"] is None


def test_math_is_handed_through():
    assert H.element_text("<p>a <math>x &lt; y</math> b __MATH_0__</p>", keep_math=True) == "a <math>x &lt; y</math> b __MATH_0__"
    assert H.element_text("<p>a <math>\\alpha</math> b</p>") == "a\\alphab"
