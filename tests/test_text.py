import pytest
from pyspark.sql import functions as F

from lexmill.functions import html as H, text as X
from lexmill.operators import extraction as E, quality as Q

L = F.lit


@pytest.mark.parametrize(("text", "n"), [
    ("This is one. Here is two. And three.", 3), ("Une phrase. Deux phrases. Trois phrases.", 3),
    ("Dr. Smith wrote a study. It was read.", 2), ("She moved to the U.S.A. last year. Then she left.", 2),
    ("Mr. Jones came. He went.", 2), ("We found p < 0.05 here. That is low.", 2), ("M. Dupont est venu. Il est parti.", 2), ("", 0),
])
def test_sentences(one, text, n):
    assert one(X.count_sentences(L(text))) == n


def test_slugs(one):
    assert one(X.slugify(L("Héllo  World_x! -- a")), X.file_slug(L("L'été 1.pdf"))) == ("hllo-world-x-a", "l-t-1-pdf")
    assert one(X.article_id(L("A Title"), L("J. Smith & B. Doe"), L("2020"))) == "smith-2020-a-title"
    assert one(X.ingest_id(L("The effects of 2019 on sleep"), L("Jane Doe, X"))) == "doe-2019-effects-2019-sleep"
    assert one(X.ingest_id(L(""), L(""))) == "untitled-article"


def test_numbers(one):
    assert one(X.numbers(L("42 people, 8.5 of 0.05, 85% and 12.5%"))) == ["0.05", "12.5%", "42", "8.5", "85%"]
    assert one(X.numbers(L("42grams 8,5"))) == ["42g", "5", "8"]
    assert one(X.numbers(L(None).cast("string"))) == []


def test_doi_year_mail(one):
    t = L('see 10.1234/abc.5). (2019) a.b@c.org')
    assert one(X.doi_of(t), X.year_of(t), X.email_of(t)) == ("10.1234/abc.5", "2019", "a.b@c.org")
    assert one(X.doi_of(L("https://doi.org/10.1/xy"), "link")) == "10.1/xy"


def test_sentence_ends(one):
    assert one(X.starts_lower(L("'atypical' range")), X.starts_lower(L("A b")), X.is_incomplete(L("open")), X.is_incomplete(L("done.")), X.is_incomplete(L(""))) == (True, False, True, False, False)


def test_sections(one):
    assert one(*[X.section_of(L(t)) for t in ("Summary and Conclusions", "Results", "3. Anything", "Remerciements", "Other")]) == ("abstract", "body", "body", "acknowledgements", None)
    assert one(X.is_cruft(L("Received 3 May")), X.is_cruft(L("Contact:")), X.is_cruft(L("A plain sentence."))) == (True, True, False)


def test_summary(one):
    good = "word " * 30 + "end."
    text = "HEADER\n\ndoi: 10.1/x one two three four five six seven eight nine ten\n\nALL CAPS TEXT THAT IS LONG ENOUGH TO BE TEN WORDS HERE NOW\n\n" + good
    assert one(X.summary(L(text))) == good
    assert one(X.summary(L("Short")), X.summary(L(""))) == (None, None)
    assert len(one(X.summary(L("w " * 400), 20)).split()) <= 30


def test_misc(one):
    assert one(X.key_findings(L("A b. C d! E f? G"))) == ["A b", "C d"]
    assert one(X.accepted_language(L("de, en;q=0.7, fr;q=0.9"))) == "fr"
    assert one(X.tolerant_flags(L("oops"))) == [] and one(X.tolerant_flags(L('["A"]'))) == ["A"]
    assert one(X.formulas(L("F(1, 156) = 4.07 and p < .05"))) == ["F(1, 156) = 4.07", "p < .05"]
    assert "did you mean 'empirical'" in one(X.suggestion(L("empiric"), ["synthesis", "empirical"]))
    assert one(X.hyphen_variant(L("a b c")), X.hyphen_variant(L("a-b")), X.hyphen_variant(L("ab"))) == ("a-b-c", "a b", None)


@pytest.mark.parametrize(("s", "t", "flag"), [(3, 3, None), (10, 7, "SENTMIS"), (10, 9, None), (0, 0, "SENTMIS")])
def test_sentence_ratio(one, s, t, flag):
    assert one(Q.sentence_flag(L(s), L(t))) == flag


@pytest.mark.parametrize(("s", "t", "flag"), [(100, 80, "WORDMIS"), (100, 160, "WORDMIS"), (100, 120, None), (100, 90, None), (100, 150, None), (0, 2, "WORDMIS")])
def test_word_ratio(one, s, t, flag):
    assert one(Q.word_flag(L(s), L(t))) == flag


def test_pairs(spark):
    rows = [("We saw 42 of 50. Fine.", "Nous avons vu 42 cas. Bien.", ["chat noir", "maison blanche", "grand arbre"]), ("A b c 7.", "A b c 7.", None)]
    out = Q.check_pairs(spark.createDataFrame(rows, "source_text string, target_text string, terms array<string>"), terms="terms").collect()
    assert out[0]["warning_flags"] == ["WORDDRIFT", "STATMIS", "TERMMIS"] and out[0]["missing_numbers"] == ["50"] and out[0]["passes"]
    assert out[1]["term_recall"] == 1.0 and not out[1]["warning_flags"]


def test_problems(one):
    assert one(E.extraction_problems(L("one two three four five"))) == ["UNUSABLE", "TOOSHORT"]
    assert "NOPARAGRAPHS" in one(E.extraction_problems(L("word " * 600)))
    assert "REPEATEDTEXT" in one(E.extraction_problems(L("word " * 600)))
    assert one(E.extraction_problems(L("� " * 200))) == ["UNUSABLE", "GARBLED"]
    assert one(E.extraction_problems(L(None).cast("string"))) == ["UNUSABLE", "TOOSHORT"]


def test_payload(one):
    b = lambda s: L(bytearray(s.encode()))
    assert one(E.classify_payload(b("%PDF-1"), L(""), L(200)), E.classify_payload(b("<html>Please subscribe"), L("text/html"), L(200)), E.classify_payload(b("x"), L("text/plain"), L(404)), E.classify_payload(b("x"), L("text/plain"), L(200))) == ("ok", "PAYWALL", "NOT_FOUND", "NOT_PDF")


def test_chunks(spark):
    text = "\n\n".join(f"Paragraph {i}." for i in range(8))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "Intro.\n\n" + " ".join(f"Sentence {i} has five words." for i in range(140)) + "\n\nOutro.")], "doc_id long, text string")
    n = {r["doc_id"]: r["n"] for r in E.chunks(df, target=2).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n[1] == 4 and 2 not in n and 3 not in n
    assert E.chunks(df.where("doc_id = 4")).agg(F.sum("n_paragraphs")).first()[0] == 4


def test_html():
    assert H.element_text("<p>a <b>b</b></p>") == "ab" and H.element_text("<p>a <b>b</b></p>", separator=" ") == "a b"
    assert H.element_text("<p>x <math>a&lt;b</math> y</p>", True) == "x <math>a&lt;b</math> y"
    assert H.math_to_span(r"<math>\alpha \leq 2</math>") == '<span class="formula">α ≤ 2</span>'
    assert H.page_text("<nav>no</nav><p>yes</p><script>x</script><p>and</p>") == "yes\n\nand"
    assert H.elements("<div><p>a</p><ul><li>b</li></ul></div>") == [("p", "a"), ("ul", "b")]
    found = H.resources('<div class="x-resource" id="r1"><h3>Title: T</h3><p>Year: 2020</p><p>Keywords: a, b</p><a href="https://doi.org/10.1/z">doi</a></div>')
    assert found[0]["doi"] == "10.1/z" and found[0]["keywords"] == ["a", "b"] and found[0]["title"] == "T" and found[0]["year"] == "2020"
    a = H.article("<h1>Title</h1><h2>Abstract</h2><p>About.</p><h2>Introduction</h2><p>It goes</p><p>on here.</p><p>Received 3 May</p><h2>References</h2><p>1. Ref</p>")
    assert a["title"] == "Title" and a["abstract"] == "About." and a["body"][1]["text"] == "It goes on here." and a["references"] == ["1. Ref"] and a["stripped_cruft"] == ["Received 3 May"]


def test_article_types_are_loaded(one):
    from lexmill.operators import classify as C
    from lexmill.sources import readers

    mapping = readers.type_methods({"empirical": {"en": ["Survey"], "fr": ["Enquête"]}, "synthesis": ["Review"], "other": None})
    assert mapping == {"empirical": ("survey", "enquête"), "synthesis": ("review",), "other": ()}
    kinds = [C.method_of(F.lit(x), {k: v for k, v in mapping.items() if v}) for x in ("An ENQUÊTE", "a review of surveys", "none")]
    assert one(*kinds) == ("empirical", "empirical", None)
