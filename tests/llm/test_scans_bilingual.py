import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bilingual, scans

NOUNS = {"krov": "truss", "nosník": "beam", "střecha": "roof", "deska": "slab", "výkop": "excavation", "kotva": "anchor", "omítka": "plaster", "jeřáb": "crane", "stěna": "wall", "příčka": "partition", "podlaha": "floor", "sklad": "store"}
VERBS = {"podpírá": "supports", "měří": "measures", "zakrývá": "covers", "zpevňuje": "strengthens", "určuje": "determines", "chrání": "protects"}
ADVERBS = {"během zimy": "during the winter", "poblíž vchodu": "near the entrance", "podle výkresu": "according to the drawing", "po celé délce": "over the whole length"}
RNG = random.Random(3)


def sentence():
    a, v, b, d = RNG.choice(list(NOUNS)), RNG.choice(list(VERBS)), RNG.choice(list(NOUNS)), RNG.choice(list(ADVERBS))
    n = RNG.randint(2, 99)
    return f"{a} {v} {b} {d} do {n} dnů.".capitalize(), f"The {NOUNS[a]} {VERBS[v]} the {NOUNS[b]} {ADVERBS[d]} within {n} days."


PAGE = "page_id long, url string, lang string, edition string, section string, title string, text string, content_type string, book string"


def crawled(i, text, lang="cs", section="1.1", volume=1):
    return (i, f"https://x/f-{lang}/v{volume:04}/kap1/t.html", lang, "full", section, "Název", text, "text/html", "")


@pytest.fixture(scope="module")
def reader(spark):
    body = [" ".join(sentence()[0] for _ in range(14)) + "\n\n" + " ".join(sentence()[0] for _ in range(9)) for _ in range(150)]
    rows = [crawled(i, t, volume=i) for i, t in enumerate(body)]
    rows += [(5000 + i, f"file:///b.pdf#page={i}", "cs", "full", None, "Široký krov", "viz stavebně-technický rozbor a severo-jižní směr", "application/pdf", "Široký krov") for i in range(5)]
    return scans.train(spark.createDataFrame(rows, PAGE), 150)


def test_lines_of_a_scan(reader):
    text = "ŠIROKÝ KROV\n\nStřecha podpírá krov během zimy do 12 dnů. Nosník zpe-\nvňuje desku podle výkresu, viz stavebně-\ntechnický rozbor. Kotva zakrývá 0mítka po celé\ndélce do 7 dnů.\n\nJeřáb měří stěnu poblíž vchodu.\n— 13 —"
    got = reader.noisy(text, "Široký krov", "")
    assert (0, "header") in got and (8, "page_number") in got and (2, "hyphen") in got and (4, "char") in got
    assert (3, "hyphen") not in got
    fixed = reader.repaired(text, "Široký krov", "")
    assert "ŠIROKÝ" not in fixed and "13" not in fixed and "zpevňuje" in fixed and "omítka" in fixed and "stavebně-technický" in fixed


def test_editor_on_held_out_words(reader):
    words = [w for w in reader.vocabulary if len(w) > 4]
    rng = random.Random(8)
    made = [(w, scans.misread(w, rng)[0]) for w in words * 5 if scans.misread(w, rng)]
    hit = sum(reader.fix(bad) == w for w, bad in made)
    assert hit / len(made) > 0.8 and not any(reader.fix(w) for w in words)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_every_operation_on_fresh_misreadings(spark):
    """Fitted on the pages, tried on misreadings of its own words that it hasn't seen, per operation."""
    reader = scans.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    rng = random.Random(6)
    words = [w for w in sorted(reader.vocabulary) if len(w) > 4 and reader.vocabulary[w] > 3]
    got = scans.held_out(reader, rng.sample(words, 400), rng, 3)
    assert {"R", "T", "S"} <= set(got) and got["K"] == (400, 400), got
    assert all(hit / n > 0.8 for k, (hit, n) in got.items()), got
    assert not any(reader.fix(w) for w in ("B25", "12m", "xiv", "M16", "45kN", "SPAN"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_words_of_a_repaired_page(spark):
    """Sound pages made into scans with misread words, and repaired: how many of the words come back in order."""
    import difflib
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    reader, rng, n, hit = scans.train(pages), random.Random(4), 0, 0
    for r in pages.where(F.col("content_type") == "text/html").where(F.col("text").rlike("^[\\x00-\\x7f]*$")).select("text").distinct().orderBy("text").limit(50).collect():
        parts = [p.strip() for p in re.split(r"\s*\n\s*\n\s*", r.text) if len(p) > 40][:5]
        if not parts:
            continue
        lines, kinds, book, title = scans.made_page(parts, ["Name of a Book", "Chapter one: Concrete"], rng)
        for i, k in enumerate(kinds):
            words = lines[i].split(" ")
            if k == "body" and len(words) > 2 and rng.random() < 0.2:
                at = rng.randrange(1, len(words) - 1)
                got = scans.misread(words[at], rng)
                lines[i] = " ".join([*words[:at], got[0] if got else words[at], *words[at + 1 :]])
        want, got = " ".join(parts).split(), reader.repaired("\n".join(lines), book, title).split()
        n += len(want)
        hit += sum(b.size for b in difflib.SequenceMatcher(None, want, got, autojunk=False).get_matching_blocks())
    assert n > 1000 and hit / n > 0.98


def test_one_long_line_loses_no_page(reader):
    text = "ŠIROKÝ KROV\n\n" + "\n".join(["Střecha podpírá krov během zimy do dvanácti dnů.", "Kotva zakrývá 0mítka po celé"] * 8) + "\n" + "odstavec bez zalomení " * 6 + "\n— 13 —"
    got = reader.noisy(text, "Široký krov", "")
    assert (0, "header") in got and (3, "char") in got and (19, "page_number") in got
    assert reader.noisy("\n".join(["odstavec bez zalomení " * 20] * 3) + "\nkrátký", "", "") == []


def test_pages_that_are_no_scans(spark, reader):
    rows = [(1, None, ""), (2, "", ""), (3, "Dlouhý odstavec bez zalomení " * 20, "k"), (4, "a\nb", "k"), (5, "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "page_id long, text string, book string").selectExpr("*", "CAST(NULL AS string) AS title", "'application/pdf' AS content_type", "'c' AS kind", "0 AS line_no")
    assert scans.noisy_lines(df, reader).count() == 0
    assert {r.page_id: r.text for r in scans.repair(df, reader).collect()}[2] == ""
    assert scans.noisy_lines(df.limit(0), reader).count() == 0


def test_train_on_nothing(spark):
    none = spark.createDataFrame([], PAGE)
    assert scans.noisy_lines(none, scans.train(none)).count() == 0
    glossary = spark.createDataFrame([], "term_cs string, term_en string")
    assert bilingual.translations(none, glossary).count() == 0


def test_sentences():
    assert bilingual.sentences("One. Two! 3rd? no. „Q“ x.") == ["One.", "Two!", "3rd? no. „Q“ x."]
    assert bilingual.sentences("") == [""] and bilingual.sentences("A. ") == ["A. "]


def test_alignment(spark):
    rows, want = [], set()
    for v in range(60):
        pairs = [sentence() for _ in range(9)]
        left = [a for a, _ in pairs]
        right = [b for _, b in pairs]
        links = [(i, i) for i in range(9)]
        if v % 3 == 1:  # left out and put in
            right = right[:4] + [sentence()[1]] + right[5:]
            links = [(i, i) for i in range(9) if i != 4]
        if v % 3 == 2:  # moved, and joined
            right[1], right[2] = right[2], right[1]
            links[1], links[2] = (1, 2), (2, 1)
            right[7:9] = [right[7].rstrip(".") + ", and in addition, " + right[8][0].lower() + right[8][1:]]
            links[8] = (8, 7)
        rows += [crawled(2 * v, " ".join(left), volume=v), crawled(2 * v + 1, " ".join(right), "en", volume=v)]
        want |= {(2 * v, i, 2 * v + 1, j) for i, j in links}
    rows += [rows[0], crawled(900, None, volume=1), crawled(901, " ", "en", volume=2), crawled(902, "Sám.", section=None, volume=3), crawled(9999, rows[1][6], "en", volume=0)]
    df = spark.createDataFrame(rows, PAGE).withColumn("score", F.lit("clash"))
    glossary = spark.createDataFrame([("krov", "truss"), ("během zimy", "during the winter"), (None, None)], "term_cs string, term_en string")
    got = {(r.page_id_a, r.sent_a, r.page_id_b, r.sent_b) for r in bilingual.translations(df, glossary).collect()}
    copy = {g for g in got if g[2] == 9999}
    got -= copy
    assert len(got & want) / len(want) > 0.93 and len(got & want) / len(got) > 0.93
    assert copy == {(0, a, 9999, b) for p, a, _, b in got if p == 0}


@pytest.mark.parametrize("n", [10, 6000])
def test_first_part_of_a_compound_counts_at_every_size(n):
    class Joiner:
        def best(self, features, kinds):
            self.features = features
            return kinds[0]

    compounds = {f"w{i}-part-end" for i in range(n)}
    reader = scans.Reader({}, compounds, None, None, Joiner())
    for left, first in (("W3", True), ("w3-part", True), ("w", False), ("part", False)):
        reader.join(left, "-", "other", False)
        assert f"first={first},0" in reader.joiner.features


def made_side(rng, pairs):
    words, sizes = [], []
    for _ in range(pairs):
        texts = [rng.sample(range(2, 60), rng.randint(0, 7)) for _ in range(rng.randint(0, 9))]
        words.append(np.array([w for t in texts for w in t], np.int64).tobytes())
        sizes.append(np.array([len(t) for t in texts], np.int32).tobytes())
    return bilingual.Side(words, sizes)


@pytest.mark.parametrize("held", [1, 7, 10**6])
def test_retrieval_against_all_pairs(monkeypatch, held):
    """Shares of bags from lookups against a comparison of every word with every word."""
    monkeypatch.setattr(bilingual, "HELD", held)
    rng = random.Random(held)
    for _ in range(12):
        links = {(u, v): rng.random() for u in range(2, 60, 2) for v in rng.sample(range(2, 60, 2), 3)}
        u, v = (np.array([k[i] for k in links], np.int64) for i in (0, 1))
        weights = [{w: rng.uniform(0.3, 4) for w in rng.sample(range(2, 60, 2), 20)} for _ in range(2)]
        tables = bilingual.Tables(u, v, np.array(list(links.values())), *weights)
        a, b = made_side(rng, 6), made_side(rng, 6)
        key, ab, ba = bilingual.retrieve(a, b, tables, 0.0, 9.0)
        got = {(int(k // len(b.size)), int(k % len(b.size))): (x, y) for k, x, y in zip(key, ab, ba)} if len(b.size) else {}
        own = lambda side, i: side.word[side.first[i] : side.first[i] + side.size[i]].tolist()
        weigh = lambda w, side: 3.0 if w & 1 else weights[side].get(w, 1.5)
        link = lambda x, y: 1.0 if x == y and x & 1 else links.get((x, y), 0.0)
        for i in range(len(a.size)):
            for j in range(len(b.size)):
                x, y = own(a, i), own(b, j)
                share = sum(weigh(t, 0) * max(link(t, s) for s in y) for t in x) / sum(weigh(t, 0) for t in x)
                back = sum(weigh(s, 1) * max(link(t, s) for t in x) for s in y) / sum(weigh(s, 1) for s in y)
                if a.pair[i] != b.pair[j] or not share:
                    assert (i, j) not in got
                else:
                    assert np.allclose(got[i, j], (share, back), atol=1e-5)


def test_sections_are_joined_in_blocks(spark):
    rows = [(f"{g}{i}", "v1", "1.1", g, b"", b"") for g in ("cs", "en") for i in range(150)] + [("x", "v1", "1.2", "cs", b"", b""), ("y", "v2", "1.1", "en", b"", b"")]
    texts = spark.createDataFrame(rows, "text_id string, volume string, section string, lang string, words binary, sizes binary")
    got = [(r.left_id, r.right_id) for r in bilingual.counterparts(texts).collect()]
    assert len(got) == 150 * 150 == len(set(got)) and all(a.startswith("cs") and b.startswith("en") for a, b in got)


def test_one_form_of_many_rows():
    rows = ["plain", "s​kryté", "č", "", "ｗｉｄｅ", "ž" * 3]
    assert bilingual.consistent(rows) == ["plain", "skryté", "č", "", "wide", "ž" * 3] and bilingual.consistent([]) == []
