import unicodedata

from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions import urls as U
from scriptorium.functions import vectors as V


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first().x


def test_tokenize_folds_stems_and_drops_long_numbers(spark):
    assert one(spark, X.tokenize("t"), t="Zateplení FASÁDY 9081726354 od jihu, zateplením") == ["zatepleni", "zatepl", "fasady", "od", "jihu", "zateplenim", "zatepl"]
    assert one(spark, X.tokenize("t"), t="") == []
    assert one(spark, X.tokenize("t"), t=None) is None
    assert one(spark, X.tokenize("t"), t="1234 12345 a_b žluťoučký") == ["1234", "a_b", "zlutoucky", "zlutou"]
    assert one(spark, X.tokenize("t"), t="12345x 98765_ ١٢٣٤٥٦ x123456") == ["12345x", "98765_", "x123456", "x12345"]


def test_fold_agrees_with_decomposition(spark):
    text = "".join(chr(c) for c in range(0xC0, 0x250)) + "ßøł"
    want = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    assert one(spark, X.fold("t"), t=text) == want


def test_guess_lang(spark):
    for text, want in (("Co je plán?", "cs"), ("Jak se dela beton", "cs"), ("What is concrete", "en"), ("CPM critical path", "en"), ("", "en")):
        assert one(spark, X.guess_lang("t"), t=text) == want, text


def test_sentences_break_before_capitals_and_some_small_letters(spark):
    assert one(spark, X.sentences("t"), t="One. Two! 3rd? áno. no x") == ["One.", "Two!", "3rd?", "áno. no x"]


def test_paragraphs_and_pdf_text(spark):
    assert one(spark, X.paragraphs("t"), t=" a \n \n\n b\nc \n\n") == ["a", "b\nc"]
    assert one(spark, X.clean_pdf_text("t"), t="sta-\nvba je\nvelká\n\n\nDalší  odstavec") == "stavba je velká\n\nDalší odstavec"
    assert one(spark, X.rejoin_hyphens("t"), t="Není- li a X- Y") == "Není-li a X- Y"


def test_broken_ratio_and_headings(spark):
    assert one(spark, X.broken_ratio("t"), t="sm\x00rnice pro be✏nění") > 0.05
    assert one(spark, X.broken_ratio("t"), t="clean\ttext\n") == 0.0
    assert one(spark, X.broken_ratio("t"), t="") == 0.0
    got = one(spark, X.headings_in("t"), t="3 Výrobní proces\ntext\n3.1 Základní pojmy\n3.2 ne.\n3.3 malé,")
    assert [(h.number, h.line) for h in got] == [("3", "3 Výrobní proces"), ("3.1", "3.1 Základní pojmy")]


def test_chapter_and_section(spark):
    cases = {
        ("https://x/online-priprava-en-demo/text132.html", None, None): (13, "13.2"), ("https://x/kap5/text41.html", "4.1 Stage", None): (4, "4.1"), ("https://x/a/text11.html", "", ""): (11, None),
        ("https://x/kap5/text53.html", None, None): (5, "5.3"), ("https://x/a/text13uvod.html", None, None): (13, None), ("https://x/a/o7.html", None, None): (7, None), ("https://x/a/b.html", None, None): (None, None),
        ("https://x/a/text131.html", None, "Kapitola 3.2.1 a"): (3, "3.2.1"), ("https://x/a/text25.html", None, None): (2, "2.5"),
    }
    rows = spark.createDataFrame([(*k, *v) for k, v in cases.items()], "url string, title string, body string, ch int, sec string")
    for r in rows.select("url", "ch", "sec", X.chapter_section("url", "title", "body").alias("x")).collect():
        assert (r.x.chapter, r.x.section) == (r.ch, r.sec), r


def test_best_title(spark):
    rows = spark.createDataFrame(
        [("4.1 Stupně", "x", ["h"], "t", "f"), ("", "Kapitola 4", ["5", "Nadpis"], "t", "f"), (None, None, [], "|\n ab\n | První řádek |", "f"), ("", "", [], "", "f.html")],
        "b string, t string, h array<string>, x string, n string",
    )
    assert [r[0] for r in rows.select(X.best_title("b", "t", "h", "x", "n")).collect()] == ["4.1 Stupně", "Nadpis", "První řádek", "f.html"]


def test_urls(spark):
    assert one(spark, U.is_chrome("u"), u="https://x/y/obsah3small.html") and not one(spark, U.is_chrome("u"), u="https://x/y/text1.html")
    assert one(spark, U.fetchable("u"), u="https://x/A.HTM") and not one(spark, U.fetchable("u"), u="https://x/a.html?x=1")
    assert one(spark, U.content_images("i"), i=["b.gif", "", "SIPKA.gif", "a.gif", "b.gif"]) == ["a.gif", "b.gif"]
    assert one(spark, U.without_fragment("u"), u="a#b#c") == "a"


def test_chances_of_yes(spark):
    kind = "l array<struct<token:string,logprob:double>>"
    p = lambda *t: spark.createDataFrame([(list(t),)], kind).select(V.yes_chance("l").alias("p")).first().p
    assert p((" Yes", -0.01), ("no", -5.0)) > 0.99
    assert p(("No", -0.01), ("yes", -5.0)) < 0.05
    assert p(("maybe", -0.1)) == 0.5
    assert p(("yes", -900.0), ("no", -0.1)) == 0.0


def test_split_key_and_escape(spark):
    assert tuple(one(spark, X.split_key("k"), k="local:model:8b")) == ("local", "model:8b")
    assert tuple(one(spark, X.split_key("k"), k="st")) == ("st", "")
    assert one(spark, X.escape_html("t"), t="<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"


def test_normalise(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(V.l2_normalise("v").alias("u")).collect()
    assert abs(v[0].u[0] - 0.6) < 1e-8 and v[1].u == [0.0, 0.0]
    assert F is not None
