import json

import pytest
from pyspark.sql import functions as F

from scriptorium.api import Engine, Engines
from scriptorium.model import CHUNK, PAGE, Query
from scriptorium.operators import answers, chunking, corpus, index, rerankers, search
from scriptorium.sources import books, html, records
from scriptorium.streaming import ingest

BASE = "https://ucebnice.example/podklady/online-priprava"
HTML = """<!doctype html><html lang=cs><head><style>p {color: red}</style><title> 7.3  Izolace </title></head>
<body><noscript>bez skriptů</noscript><div><h2>Proti <b>vlhkosti</b></h2>Svislá izolace se klade na suchou zeď.<br/>Spoje se svaří a&nbsp;přeloží o deset centimetrů.</div>
<ul><li>penetrace<li>pásy</ul><p>Vodorovná izolace leží pod zdivem a nesmí být nikde přerušena.
<img alt=x src='foto\\detail.png'><img src=logo2.gif><img><a href=" ../kap8/text81.html?p=1#dole ">střecha</a><a href="JavaScript.html">js</a><a href=javascript:void(0)>x</a><a href="https://jinde.example/">ven</a>
<table><tr><th>tloušťka</th><td></td><td>5 mm</td></tr></table></body></html>"""


def page(url, text, lang="cs", edition="full", chapter=4, section="4.1", title="Název", book=""):
    return (url, url, "online-priprava", lang, edition, chapter, section, title, text, [], [], [], "text/html", 0.0, book)


def corpus_pages(spark):
    long = " ".join(f"Věta číslo {i} popisuje etapu stavby a její postup." for i in range(120))
    rows = [
        page(f"{BASE}/kap4/text41.html", "Stupně rozestavěnosti určují stav stavby. Rozestavěnost se sleduje po etapách a zapisuje do plánu."),
        page(f"{BASE}/kap9/text91.html", long, chapter=9, section="9.1", title="Dlouhá"),
        page(f"{BASE}-en/kap4/text41.html", "The stages of construction are described here and tracked in the plan. " * 10, lang="en", title="Stages"),
    ]
    return spark.createDataFrame(rows, PAGE)


def test_html_to_page(spark):
    url = f"{BASE}/kap7/text73.html"
    raw = [(url, HTML, "a"), (f"{BASE}/kap7/nadpis7.html", HTML, "nav"), (f"{BASE}/kap7/ram.html", HTML + "<frameset cols=2></frameset>", "frames"), (f"{BASE}/kap7/kratka.html", "<b>málo</b>", "short"), (f"{BASE}/x.html", None, "null"), ("https://jinde.example/a.html", HTML, "out")]
    editions = spark.createDataFrame([("online-priprava", "cs", "full"), ("online-priprava-en", "en", "full")], "edition_key string, lang string, edition string")
    p = html.pages_from_html(spark.createDataFrame(raw, "url string, html string, path string"), editions).collect()
    assert [x.path for x in p] == ["a"]
    p = p[0]
    assert (p.chapter, p.section, p.title, p.lang, p.edition, p.headings) == (7, "7.3", "7.3 Izolace", "cs", "full", ["Proti vlhkosti"])
    assert p.images == [f"{BASE}/kap7/foto/detail.png"] and p.links == [f"{BASE}/kap7/JavaScript.html", f"{BASE}/kap8/text81.html?p=1"]
    assert "zeď.\nSpoje se svaří a přeloží" in p.text and "penetrace\n\npásy" in p.text and "tloušťka | 5 mm |" in p.text
    assert "color" not in p.text and "bez skriptů" not in p.text


def test_collapse_is_a_single_pass():
    import random
    import re

    rng = random.Random(6)
    for _ in range(500):
        t = "".join(rng.choices("ab |\t\n \xa0", k=40))
        steps = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", t.replace("\xa0", " "))))
        assert html.collapse(t) == re.sub(r"(\s*\|\s*){2,}", " | ", steps).strip()


def test_decoding():
    assert html.decode("<meta charset=ISO-8859-2>šíp".encode("iso8859_2")) == "<meta charset=ISO-8859-2>šíp"
    assert html.decode("šíp".encode(), "text/plain; Charset=UTF-8") == "šíp"
    assert html.decode("šíp charset=x-none".encode("cp1250"), "text/html; charset=utf-8") == "šíp charset=x-none"
    assert html.decode(b" " * 3000 + b"charset=utf-8" + "ž".encode("cp1250"))[-1] == "ž"
    assert html.decode(b"") == html.decode(None) == ""


def test_bodies_by_searching_against_trying_every_end():
    import random

    rng = random.Random(2)
    for _ in range(300):
        text = "\n\n".join("Věta. " * rng.choice((1, 3, 20, 60, 300)) + "x" * rng.choice((0, 5, 190, 700)) for _ in range(rng.randint(1, 12)))
        parts, first, carry, want = list(chunking.pieces(text, 1400)), 0, "", []
        while first < len(parts):
            size = lambda end: len(carry) + sum(len(p) + 2 for p in parts[first:end])  # noqa: B023, E731
            stop = min((j for j in range(first + 1, len(parts)) if size(j) > 200 and size(j) + len(parts[j]) > 1400), default=len(parts))
            body = "\n\n".join(filter(None, [carry, *parts[first:stop]])).strip()
            if len(body) >= 80 and body != carry:
                want.append(body)
                carry = body[-200:].partition(" ")[2] if " " in body[-200:] else body[-200:]
            first = stop
        assert chunking.bodies(text) == want and all(len(p) <= 1400 or "." not in p[:-1] for p in parts)


def test_chunks(spark):
    chunks = chunking.chunk_pages(corpus_pages(spark)).orderBy("page_url", "ordinal").collect()
    assert [f.name for f in CHUNK] == chunks[0].__fields__
    long = [c for c in chunks if c.title == "Dlouhá"]
    assert len(long) >= 4 and all(len(c.id) == 16 for c in chunks) and len({c.id for c in chunks}) == len(chunks)
    assert long[1].body[:40] in long[0].body and all(c.text.startswith("Učebnice > Kapitola 9 > Dlouhá\n\n") for c in long)


@pytest.mark.parametrize("text, n", [("", 0), (None, 0), ("x" * 79, 0), ("x" * 80, 1), ("x" * 5000, 1), ("Slovo. " * 10, 0), (" \n\n " * 50, 0)])
def test_chunk_edges(text, n):
    assert len(chunking.bodies(text)) == n


def test_index_search_and_answers(spark, tmp_path):
    path = str(tmp_path / "index")
    index.build(chunking.chunk_pages(corpus_pages(spark)), index.HashedWords(), path)
    engine = Engine(spark, path)
    assert engine.info()["n_chunks"] > 5 and "books" not in engine.info()
    hits = engine.search(Query("rozestavěnost stavby"))
    assert hits and all(h["lang"] == "cs" for h in hits)
    by_page = [(h["page_url"], h["ordinal"]) for h in hits]
    assert not any(a[0] == b[0] and abs(a[1] - b[1]) == 1 for a in by_page for b in by_page)
    assert engine.search(Query("stages of construction", lang="en"))[0]["lang"] == "en"
    first = engine.answer(Query("rozestavěnost stavby"))
    again = engine.answer(Query("rozestavěnost stavby"))
    assert not first["cached"] and again["cached"] and first["answer"] == again["answer"]
    frames = answers.read_frames("".join(engine.stream(Query("rozestavěnost stavby"))))
    assert [e for e, _ in frames] == ["meta", "sources", "token", "done"]
    assert not engine.answer(Query("rozestavěnost stavby"), [{"role": "user", "content": "x"}])["cached"]
    assert Engine(spark, str(tmp_path / "none")).info()["status"] == "degraded"
    assert Engines(spark, str(tmp_path)).available() == [""]
    warmed = Engines(spark, str(tmp_path)).warm(["", "none", ""])
    assert set(warmed[""]) >= {"index", "embedder"} and warmed["none"].startswith("FileNotFoundError")
    again = engine.search(Query("rozestavěnost stavby", rerank=True))
    assert again[0]["rerank_score"] is not None
    q = spark.createDataFrame([("rozestavěnost etapy", "cs", 4, ["4.1"]), ("zzz qqq", "en", 1, None)], "q string, lang string, chapter int, sections array<string>")
    row = engine.evaluate(q)
    assert row["total"] == 2 and row["sec_total"] == 1 and "chapter: hit@1" in corpus.summary(row, 10)[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    scores = spark.createDataFrame([(1, f"d{i}", float(i)) for i in range(9)], "qid int, id string, score double")
    assert plan_of(search.best(scores, 3)).count("WindowGroupLimit") >= 2
    lists = scores.withColumn("rank", F.lit(0))
    assert plan_of(search.fuse(lists, lists, 3)).count("WindowGroupLimit") >= 1
    assert [r["rank"] for r in search.best(scores, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_ties_beyond_any_bound_go_by_id(spark):
    import random

    ids = [f"v{i:05}" for i in range(3000)]
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "id string, embedding array<double>")
    q = spark.createDataFrame([(7, [2.0, 4.0])], "qid int, embedding array<double>")
    assert [r.id for r in search.dense_search(df, q, 5, block=700).orderBy("rank").collect()] == [f"v{i:05}" for i in range(5)]


def test_hashed_words_are_one_embedding(spark):
    texts = ["", "Stavba  STAVBA\nplot", "žluť a"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(index.HashedWords().column("t").alias("v")).collect()
    for r, v in zip(got, index.HashedWords()(texts)):
        assert max(abs(a - float(b)) for a, b in zip(r.v, v)) < 1e-6


def test_rerankers(spark):
    hits = spark.createDataFrame([(1, "co je plot", "plot je zeď"), (1, "co je plot", "nic")], "qid int, q string, text string")
    scores = lambda scorer: [round(r.rerank_score, 3) for r in scorer(hits).collect()]
    assert scores(rerankers.overlap) == [0.667, 0.0]
    assert scores(rerankers.pairs(lambda q, t: [len(x) for x in t])) == [11.0, 3.0]
    assert scores(rerankers.yes_or_no(lambda q, t: [("Yes", -0.1), ("no", -9.0)] if "zeď" in t else [("?", -1.0)]))[1] == 0.5
    assert rerankers.served("m", ["m:latest"]) and rerankers.served("m:8b", ["m:8b"]) and not rerankers.served("m", ["m:8b"])

    def broken():
        raise OSError("away")

    some = rerankers.Registry({"a": (broken, None), "b": (lambda: True, rerankers.overlap)})
    assert some.available() == ["b"] and some.pick(None) is rerankers.overlap and some.pick(False) is None and some.pick(None, "none") is None
    with pytest.raises(RuntimeError):
        rerankers.Registry({"a": (broken, None)}).pick(True)
    with pytest.raises(ValueError):
        some.pick(None, "zzz")


def test_errors_are_in_the_stream():
    def tokens():
        yield "a"
        raise ValueError("gone")

    assert [e for e, _ in answers.read_frames("".join(answers.stream({}, [], tokens())))] == ["meta", "sources", "token", "error"]


def test_lexical_mask_comes_after_the_overfetch(spark):
    scores = spark.createDataFrame([(1, f"d{i:03}", 1000.0 - i) for i in range(200)], "qid int, id string, score double")
    allowed = spark.createDataFrame([(f"d{i:03}",) for i in range(155, 200)], "id string")
    got = search.bm25_search(scores, None, 40, allowed).collect()
    assert [g.id for g in got] == [f"d{i}" for i in range(155, 160)]


def test_greedy_dedupe_keeps_the_third(spark):
    tail = "y" * 150
    rows = [(1, 0, "a", "u", 1, "A" + tail), (1, 1, "b", "u", 2, tail + "B" + tail), (1, 2, "c", "u", 3, tail + "C"), (1, 3, "d", "w", 2, "D"), (1, 4, "e", "u", 4, "other")]
    hits = spark.createDataFrame(rows, "qid int, final_rank int, id string, page_url string, ordinal int, body string")
    assert [r.id for r in search.dedupe_neighbours(hits).orderBy("n").collect()] == ["a", "c", "d", "e"]


def test_fusion_and_rerank(spark):
    dense = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "qid int, id string, rank int")
    lexical = spark.createDataFrame([(1, "b", 0), (1, "c", 1)], "qid int, id string, rank int")
    got = search.fuse(dense, lexical, 10).orderBy("rank").collect()
    assert [g.id for g in got] == ["b", "a", "c"] and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-12 and got[2].dense_rank is None
    hits = spark.createDataFrame([(1, "a", 0, 0.1), (1, "b", 1, 0.9), (1, "c", 2, None)], "qid int, id string, rank int, rerank_score double")
    assert [r.id for r in search.rerank(hits, "rerank").orderBy("final_rank").collect()] == ["b", "a", "c"]
    assert [r.id for r in search.rerank(hits, "rrf").orderBy("final_rank").collect()] == ["b", "a", "c"]


def test_dense_search_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = search.dense_search(df, df.where("id < 7").select(F.col("id").alias("qid"), "embedding"), 5, block=3).orderBy("qid", "rank").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(7):
        assert [g.id for g in got if g.qid == q] == list(np.argsort(-(u @ u[q]), kind="stable")[:5])


def test_books(spark):
    text = lambda s: s + "\n" + "obsah stránky " * 10
    pages = spark.createDataFrame([("f", 1, text("úvod")), ("f", 2, text("2 Technologie")), ("f", 3, "3.3 Krátká"), ("f", 4, text("2.1 Základy\n2.2 Další")), ("f", 5, text("nic")), ("f", 6, text("3 Závěr knihy"))], "file string, n int, text string")
    got = {r.n: (r.chapter, r.section) for r in books.carry_headings(pages).collect()}
    assert got == {1: (None, None), 2: (2, None), 4: (2, "2.2"), 5: (2, "2.2"), 6: (3, None)}
    outline = spark.createDataFrame([("f", 0, 1, "1 Úvod", 1), ("f", 1, 1, "2 Technologie", 3), ("f", 2, 2, "2.1 Základy", 4)], "file string, pos int, level int, heading string, start int")
    got = {r.n: (r.chapter, r.section) for r in books.by_outline(pages, outline).collect()}
    assert [got[n] for n in (1, 2, 3, 4)] == [(1, None), (1, None), (2, None), (2, "2.1")]
    assert {r.chapter for r in books.by_outline(pages.withColumn("file", F.lit("d/07_f.pdf")), outline.withColumn("file", F.lit("d/07_f.pdf")).withColumn("level", F.lit(2))).collect()} == {7}
    assert [tuple(r) for r in books.empty_pages(pages).collect()] == [("f", 6, 1)]
    titles = spark.createDataFrame([("T", "M", "x/a_b.pdf"), (" ", "M", "x/a_b.pdf"), (None, "", "x/a_b.pdf")], "t string, m string, f string")
    assert [r[0] for r in titles.select(books.book_title(F.col("t"), F.col("m"), F.col("f"))).collect()] == ["T", "M", "a b"]
    parts = spark.createDataFrame([("x/03_moje-kniha.pdf",), ("kniha.pdf",)], "p string").select(books.file_parts(F.col("p")).alias("x")).collect()
    assert [tuple(r.x) for r in parts] == [(3, "moje kniha"), (None, "kniha")]
    made = books.page_records(books.carry_headings(pages), F.lit("Kniha")).orderBy("url").collect()
    assert made[0].url == "file://f#page=1" and made[0].title == "Kniha – p. 1" and made[1].title == "2 Technologie"


def test_page_files(spark, tmp_path):
    path = str(tmp_path / "pages")
    records.save_pages(corpus_pages(spark), path)
    assert records.load_pages(spark, path).count() == 3
    old = tmp_path / "old.json"
    row = {f.name: None for f in PAGE} | {"url": "u", "text": "t", "lang": "cs"}
    del row["book"]
    old.write_text(json.dumps(row, ensure_ascii=False) + "\n\n", encoding="utf-8")
    assert records.load_pages(spark, str(old)).first().book == ""
    with pytest.raises(FileNotFoundError):
        records.load_pages(spark, str(tmp_path / "none"))
    env = tmp_path / ".env"
    env.write_text("# c\nexport A='x y'\nB=\nC=z\n")
    got = {"C": "set"}
    assert records.load_env(str(env), got) == {"A": "x y"} and got["C"] == "set"


def test_crawl_and_graph(spark):
    site = {f"{BASE}/a.html": '<a href="b.html">', f"{BASE}/b.html": '<a href="a.html#x"><a href="c.html"><img src="p.gif">', f"{BASE}/c.html": ""}

    def fetch(url, site=site):
        return (200, "text/html", site[url].encode()) if url in site else (404, None, b"")

    rows = corpus.crawl([f"{BASE}/a.html"], fetch, spark, wait=0)
    got = {r.url.rsplit("/", 1)[1]: (r.status, r.depth) for r in rows.collect()}
    assert got == {"a.html": ("fetched", 0), "b.html": ("fetched", 1), "c.html": ("fetched", 2), "p.gif": ("skipped_non_text", 2)}
    kept = spark.createDataFrame([(f"{BASE}/a.html", bytearray(b"<a href=z.html><a href=b.html>"))], "url string, body binary")
    order = lambda **more: [(r.url.rsplit("/", 1)[1], r.status) for r in corpus.crawl([f"{BASE}/a.html"], fetch, spark, wait=0, mirror=kept, **more).orderBy("place").collect()]
    assert order() == [("a.html", "cached"), ("z.html", "http_404"), ("b.html", "fetched"), ("c.html", "fetched"), ("p.gif", "skipped_non_text")]
    assert order(limit=2) == [("a.html", "cached"), ("z.html", "http_404")]  # as they are seen, not by the alphabet
    paths = spark.createDataFrame([("https://x.y/a/b/",), ("https://x.y/a/c.html?q#f",), ("https://x.y/",)], "url string").select(corpus.mirror_path(F.col("url")).alias("p"))
    assert [r.p for r in paths.collect()] == ["a/b/index.html", "a/c.html", "index.html"]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "url string, to string")
    assert {(r.url, r.depth) for r in corpus.breadth_first(links, spark.createDataFrame([("a",)], "url string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_stream_of_pages(spark, tmp_path):
    records.save_pages(corpus_pages(spark), str(tmp_path / "in"))
    query = ingest.ingest(ingest.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    chunks = spark.read.parquet(str(tmp_path / "out/chunks"))
    assert chunks.count() == chunking.chunk_pages(corpus_pages(spark)).count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAGE)
    assert chunking.chunk_pages(none).count() == 0 and corpus.page_stats(none).count() == 0
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    assert search.dense_search(empty, empty.select(F.col("id").alias("qid"), "embedding"), 3).count() == 0
    hits = spark.createDataFrame([], "qid int, rank int, chapter int, section string")
    want = spark.createDataFrame([(1, 2, None)], "qid int, chapter int, sections array<string>")
    assert corpus.hit_rates(hits, want).first().asDict()["chapter_k"] == 0


def test_query_limits():
    with pytest.raises(ValueError):
        Query("")
    with pytest.raises(ValueError):
        Query("q", top_k=51)
    assert Query("q", edition="all").editions == ("full", "demo")
