from pyspark.sql import functions as F

from lexmill.operators import blocks as B, classify as C, glossary as G, relational as R
from lexmill.sources import readers, store as S
from lexmill.streaming import jobs as J

BLOCKS = "doc_id string, pos int, block_type string, html string, page int, images map<string,string>"


def rows(spark, *blocks, doc="d"):
    return spark.createDataFrame([(doc, i, k, h, p, {}) for i, (k, h, p) in enumerate(blocks)], BLOCKS)


def test_join_across_page(spark):
    b = rows(spark, ("Text", "<p>This goes</p>", 0), ("PageFooter", "<p>9</p>", 0), ("Table", "<table></table>", 1), ("Text", "<p>on here.</p>", 1), ("Text", "<p>New one.</p>", 1))
    out = B.join_split_sentences(b).orderBy("pos").collect()
    assert [r["block_type"] for r in out] == ["Text", "PageFooter", "Table", "Text"] and out[0]["html"] == "<p>This goes on here.</p>" and out[0]["joined"]


def test_join_stops_at_heading_but_not_at_metadata(spark):
    b = rows(spark, ("Text", "<p>This goes</p>", 0), ("SectionHeader", "<h2>Methods</h2>", 0), ("Text", "<p>on here.</p>", 0))
    assert B.join_split_sentences(b).count() == 3
    b = rows(spark, ("Text", "<p>This goes</p>", 0), ("SectionHeader", "<h2>Corresponding author</h2>", 0), ("Text", "<p>a@b.c</p>", 0), ("PageHeader", "", 1), ("Text", "<p>on here.</p>", 1))
    assert B.join_split_sentences(b).count() == 4


def test_join_column_break_and_chain(spark):
    b = rows(spark, ("Text", "<p>First part,</p>", 0), ("Text", "<p>Second part with a</p>", 0), ("Text", "<p>third end.</p>", 0))
    out = B.join_split_sentences(b).collect()
    assert len(out) == 1 and out[0]["html"] == "<p>First part, Second part with a third end.</p>"


def test_parse_documents(spark):
    b = rows(
        spark,
        ("PageHeader", "<p>J Test (2019) 3, 1-9</p>", 0), ("SectionHeader", "<h1>A Title</h1>", 0), ("Text", "<p>J. Smith, A. Doe</p>", 0),
        ("SectionHeader", "<h2>Abstract</h2>", 0), ("Text", "<p>About things.</p>", 0), ("Text", "<p>Keywords: one, two</p>", 0),
        ("SectionHeader", "<h2>Introduction</h2>", 1), ("Text", "<p>Body text.</p>", 1), ("Caption", "<p>Table 1. Cap</p>", 1), ("Table", "<table></table>", 1),
        ("Figure", '<img alt="pic"/>', 1), ("Footnote", "<p>mail a.b@c.org</p>", 1), ("PageFooter", "doi 10.1234/x.1", 1),
        ("SectionHeader", "<h2>References</h2>", 2), ("ListGroup", "<ul><li>Ref one</li><li>Ref two</li></ul>", 2), ("Text", "<p>3. Ref three</p>", 2),
    )
    r = B.parse_documents(b).first()
    assert (r["title"], r["authors"], r["year"], r["doi"], r["author_email"]) == ("A Title", "J. Smith, A. Doe", "2019", "10.1234/x.1", "a.b@c.org")
    assert r["abstract"] == r["abstract_en"] == "About things." and r["keywords"] == "one, two"
    assert r["references"] == ["Ref one", "Ref two", "3. Ref three"]
    assert r["tables"][0]["caption"] == "Table 1. Cap" and r["figures"][0]["id"] == "fig_1" and r["figures"][0]["caption"] is None
    assert 'data-figure-id="fig_1"' in r["body_html"] and r["sections_found"]["references"] == 3
    assert r["warnings"] == ["[UNCLASSIFIED] 1 blocks in preamble not categorized"] and r["skipped_chrome"] == 2


def test_body_review(spark):
    p = spark.createDataFrame([("d", i, t, x) for i, (t, x) in enumerate([("p", "A paragraph that is quite long and has no end at all here"), ("p", "continues in lower case here."), ("p", "12"), ("h2", "Head"), ("p", "Figure 1 shows it all well.")])], "doc_id string, pos int, tag string, text string")
    issues = {r["pos"]: r["issues"] for r in B.review(p).collect()}
    assert issues == {0: ["INCOMPLETE"], 1: ["ORPHAN"], 2: ["PAGE_ARTIFACT", "SHORT_FRAGMENT"], 3: [], 4: ["CAPTION"]}
    fixes = spark.createDataFrame([("d", 1, "join_previous", None), ("d", 2, "delete", None), ("d", 4, "replace", "New."), ("d", 9, "delete", None)], "doc_id string, pos int, action string, text string")
    out = [r["text"] for r in B.apply_fixes(p, fixes).orderBy("pos").collect()]
    assert out == ["A paragraph that is quite long and has no end at all here continues in lower case here.", "Head", "New."]
    left = B.unaddressed(B.review(p), fixes, spark.createDataFrame([("d", 0)], "doc_id string, pos int"))
    assert left.count() == 0


def test_formulas(spark, one):
    p = spark.createDataFrame([("d", 0, "p", "F(1, 2) = 3.1 and p < .05")], "doc_id string, pos int, tag string, text string")
    r = B.unwrapped_formulas(p, F.array(F.lit("p < .05"))).first()
    assert r["unwrapped"] == ["F(1, 2) = 3.1"] and r["total_unwrapped"] == 1
    assert one(B.wrap_formula(F.lit("a x a"), F.lit("a"))) == '<span class="formula">a</span> x a'


def test_glossary(spark):
    entries = spark.createDataFrame([(0, "demand avoidance", "évitement", ["refus"], "DA", None), (1, "term (X)", "terme", None, None, None), (2, "Demand Avoidance", "évitement des demandes", None, None, None)], "ord int, en string, fr string, fr_alt array<string>, abbreviation string, note string")
    ix = G.index(entries)
    assert {r["term_key"]: r["fr"] for r in ix.collect()}["demand avoidance"] == "évitement des demandes"
    texts = spark.createDataFrame([(1, "About demand-avoidance, and DA."), (2, "a term (X) here"), (3, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["en"]) for r in G.find_terms(texts, ix).collect()} == {(1, "Demand Avoidance"), (1, "demand avoidance")}
    assert (2, "term (X)") in {(r["doc_id"], r["en"]) for r in G.find_terms(texts, ix, lenient=True).collect()}
    found = spark.createDataFrame([(1, "demand avoidance", "évitement")], "doc_id long, en string, fr string")
    target = spark.createDataFrame([(1, "le Refus est là")], "doc_id long, text string")
    assert G.missing_terms(found, target, entries.where("ord = 0")).count() == 0
    assert G.missing_terms(found, spark.createDataFrame([(1, "rien")], "doc_id long, text string"), entries.where("ord = 0")).first()["missing"] == "demand avoidance -> évitement"


def test_classification(spark):
    k = [f"k{i}" for i in range(5)]
    data = [("a", "empirical", "academic", "education", [], k), ("b", "empiric", "nobody", "", ["support", "support", "x"], k[:3]), ("c", "empirical", "academic", "education", ["education"], k * 4), ("d", None, "academic", "education", None, None)]
    out = {r["article_id"]: r for r in C.validate(spark.createDataFrame(data, "article_id string, method string, voice string, primary_category string, secondary_categories array<string>, keywords array<string>")).collect()}
    assert out["a"]["valid"] and out["a"]["token"] and not out["b"]["valid"]
    assert "did you mean 'empirical'" in out["b"]["errors"][0] and len(out["b"]["errors"]) == 7
    assert len(out["c"]["errors"]) == 2 and len(out["d"]["errors"]) == 2


def test_heuristics(one):
    L = F.lit
    refs = F.array(*[L(f"Doe. Journal of X. 2010;{i}(2):3") for i in range(10)])
    assert one(C.peer_reviewed(C.peer_review_signals(L("25(4), 1-9"), L("10.1/x"), refs)), C.peer_reviewed(C.peer_review_signals(L(""), L(None).cast("string"), F.array()))) == (True, False)
    assert one(C.voice_of(L("a hospital study"), L(""), L("")), C.method_of(L("Systematic Review"))) == ("academic", "synthesis")
    assert one(C.apply_suggestion(L(None).cast("string"), L(""), L("s")), C.apply_suggestion(L("o"), L("c"), L("s"))) == ("s", "o")


def test_queue_and_counts(spark):
    a = spark.createDataFrame([(1, "pending", "2020"), (2, "pending", "2019"), (3, "in_progress", "2021"), (4, "translated", "2018")], "id long, status string, created string")
    assert R.next_in_queue(a, "status", "created", "id").first()["id"] == 3
    assert {r["status"]: r["n"] for r in R.status_counts(a).collect()} == {"pending": 2, "in_progress": 1, "translated": 1, "skipped": 0, "preprocessing": 0, "pending_url": 0}
    f = spark.createDataFrame([("smith-2020-demand.pdf",), ("smith-2021-other.pdf",)], "name string")
    assert R.find_by_words(f, "smith demand").first()["hits"] == ["smith-2020-demand.pdf"]
    assert R.find_by_words(f, "smith").first()["outcome"] == "AMBIGUOUS" and R.find_by_words(f, "zzz").first()["outcome"] == "NOT_FOUND"
    assert [r["id"] for r in R.pick(a, [4, 9, 1]).collect()] == [4, 1]


def test_next_rows_span_groups(spark):
    df = spark.createDataFrame([("a", i, i * 10) for i in (1, 4, 7, 22, 23)] + [("b", 5, 0)], "g string, o long, v long")
    got = {(r["g"], r["o"]): r["next"] and r["next"]["v"] for r in R.with_next(df, "g", "o", ["v"], width=5).collect()}
    assert got == {("a", 1): 40, ("a", 4): 70, ("a", 7): 220, ("a", 22): 230, ("a", 23): None, ("b", 5): None}


def test_store(spark, tmp_path):
    t = spark.createDataFrame([(1, "fr", "a", 0), (2, "fr", "b", 0)], "article_id long, lang string, title string, created int")
    new = spark.createDataFrame([(2, "fr", "B", 9), (3, "fr", "c", 9)], "article_id long, lang string, title string, created int")
    assert sorted(map(tuple, S.upsert(t, new, ["article_id", "lang"], ["title"]).collect())) == [(1, "fr", "a", 0), (2, "fr", "B", 0), (3, "fr", "c", 9)]
    assert {r["article_id"]: r["outcome"] for r in S.insert_status(t, new, "article_id").collect()} == {2: "DUPLICATE", 3: "created"}
    s = S.Store(spark, f"file://{tmp_path}/s")
    s.publish({"t": t})

    def fail():
        raise RuntimeError

    try:
        s.publish({"t": new}, fail)
    except RuntimeError:
        pass
    assert s.read("t").count() == 2 and s.read("t").where("title = 'b'").count() == 1
    s.publish({"t": new})
    assert s.read("t").where("title = 'B'").count() == 1
    known, links = S.replace_keywords(spark.createDataFrame([], "id long, keyword string"), spark.createDataFrame([], "article_id long, keyword_id long"), spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "article_id long, keyword string"))
    assert known.count() == 2 and links.count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "d1.json").write_text('{"children": [{"block_type": "Page", "children": [{"block_type": "Text", "html": "<p>a</p>", "page": 0}]}, {"block_type": "Other"}]}')
    (tmp_path / "d2.json").write_text('{"blocks": [{"block_type": "Text", "html": "<p>b</p>", "page": 0}, {"block_type": "Text", "html": "<p>c</p>", "page": 1}]}')
    assert sorted((r["doc_id"], r["pos"], r["html"]) for r in readers.read_blocks(spark, f"{tmp_path}/*.json").collect()) == [("d1", 0, "<p>a</p>"), ("d2", 0, "<p>b</p>"), ("d2", 1, "<p>c</p>")]
    c = spark.createDataFrame([(1, None, "short", "word " * 200), (2, "trusted", None, None), (3, None, None, None)], "doc_id long, txt string, html string, pdf_a string")
    out = {r["doc_id"]: (r["method"], r["problems"]) for r in readers.extract_chain(c).collect()}
    assert out[1][0] == "pdf_a" and out[2] == ("txt", ["TOOSHORT"]) and out[3] == (None, ["PDFEXTRACT"])
    data = {"terms": [{"en": "a b", "fr": "c"}, "skip"], "note": "x"}
    assert readers.glossary_entries(spark, data).count() == 1


def test_markers_and_jobs(spark):
    lines = spark.createDataFrame([(1, "ARTICLE_START: a-b-c"), (2, "noise"), (3, "ARTICLE_ERROR: a-b-c - no text - at all"), (4, "BATCH_COMPLETE")], "event_id long, value string")
    e = J.parse_markers(lines).orderBy("event_id").collect()
    assert [(r["event_type"], r["slug"], r["message"]) for r in e] == [("start", "a-b-c", None), ("error", "a-b-c", "no text - at all"), ("batch_complete", None, None)]
    state = J.job_state(J.parse_markers(lines).withColumn("job_id", F.lit(1)).withColumn("ts", F.col("event_id"))).first()
    assert (state["status"], state["errors"], state["last_slug"]) == ("completed", 1, "a-b-c")


GATE = [("check:fields", True), ("confirm:fields", True), ("confirm:warnings", True), ("check:warnings", True), ("confirm:warnings", False), ("complete", True), ("check:formulas", True), ("reset", True)]
GATE_WANT = ["ok", "ok", "PREREQUISITE_MISSING", "ok", "ISSUES_NOT_ADDRESSED", "INCOMPLETE_CHECKS", "PREREQUISITE_MISSING", "ok"]


def test_gate(spark):
    e = spark.createDataFrame([("d", i, x, ok) for i, (x, ok) in enumerate(GATE)], "doc_id string, seq long, event string, ok boolean")
    assert [r["outcome"] for r in J.review_gate(e).orderBy("seq").collect()] == GATE_WANT



def test_joining_spreads(spark):
    """Joined between barriers, documents are the same as joined whole: headings that hide a metadata
    section in tags or entities, unknown kinds, chrome and floats included."""
    import random

    rng = random.Random(5)
    heads = ["<h1>Methods</h1>", "<h2>Corresponding author</h2>", "<h2>Corre<b>sponding</b> author</h2>", "<h2>R&amp;D</h2>", "Auteur correspondant", "", None, "<h3>Results <i>here</i></h3>"]
    words = ["The first part of", "goes on here", "and ends.", "Another one starts", "(lower case next", "Done!", ""]
    kinds = ["Text"] * 9 + ["SectionHeader"] * 3 + ["PageHeader", "PageFooter", "Figure", "Caption", "Footnote", "Table", "Equation", "ListGroup", None]
    rows = []
    for d in ("a", "b", "c", None):
        for i in range(0 if d == "c" else 400):
            kind = rng.choice(kinds)
            rows.append((d, i, kind, rng.choice(heads) if kind == "SectionHeader" else f"<p>{rng.choice(words)}</p>", i // 9, {}))
    b = spark.createDataFrame(rows, "doc_id string, pos int, block_type string, html string, page int, images map<string,string>").withColumn("__segment", F.lit("x"))
    told = lambda df: sorted(map(repr, map(tuple, df.collect())))
    whole, spread = B.prepare(b), B.prepare(b, spread=True)
    assert told(whole) == told(spread) and whole.columns == spread.columns and whole.where("joined").count() > 50
    assert B.prepare(b.where("false"), spread=True).count() == 0
    sizes = B.segmented(b, "doc_id", "n").groupBy("doc_id", "n").count()
    assert sizes.agg(F.max("count")).first()[0] < 60 and sizes.count() > 100


def test_tables_in_part_files_are_listed_once(spark, tmp_path):
    top = tmp_path / "x.parquet" / "sf"
    spark.range(9).repartition(3).write.parquet(f"{top}/many.parquet")
    (top / "one.parquet").write_bytes(b"PAR1")
    (top / "other.txt").write_text("x")
    assert sorted(map(tuple, readers.entries(spark, str(top), ".parquet").collect())) == [("many.parquet", "many", ".parquet"), ("one.parquet", "one", ".parquet")]
