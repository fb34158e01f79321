import os
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import encodings, forms

CLEAN = [
    "Dřevěný krov zatěžuje širokou střechu podél severní strany, ačkoli náklady rostou.", "Později šikmá deska určuje úzký výkop při plném zatížení 40 °C.", "Kotva systému „Terstaral“ měří příčku na ploše 12 m².",
    "The wide roof supports the crane in dry weather, see the “Kemlu” system.", "Obvyklá směs utěsňuje těžkou spáru ve většině případů, což musí potvrdit dozor.", "Nejprve čerpadlo ovlivňuje schválený nosník po několik týdnů.",
]
CHAINS = [("utf-8", "cp1250"), ("utf-8", "cp1252"), ("cp1250", "cp1252"), ("cp1250", "cp852"), ("cp852", "cp1250"), ("iso8859_2", "cp1250"), ("utf-8", "latin_1"), ("utf-8", "cp852")]


def wrong(text, x, y):
    table = {b: c for c, b in encodings.ENCODE[y].items()}
    return "".join(table[b] for b in text.encode(x, "ignore"))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, CLEAN[i % len(CLEAN)] + "\n" + CLEAN[(i + 1) % len(CLEAN)], CLEAN[i % len(CLEAN)][:30]) for i in range(120)]
    rows += [(1000 + i, wrong(CLEAN[0] + " " + CLEAN[1], x, y), "Title") for i, (x, y) in enumerate(CHAINS)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "Ångströmova König São naïve ½ ± §", "Çelar Ña."), (2003, "Kde? Opravdu?", "ok"), (2004, "Sch�lené", "m?ří sm?s"), (1000, rows[120][1], "Title")]
    return spark.createDataFrame(rows, "page_id long, text string, title string").withColumn("field", F.lit("clash"))


@pytest.fixture(scope="module")
def fixer(pages):
    return encodings.train(pages)


def test_every_chain_is_found_and_given_back(pages, fixer):
    found = {(r.page_id, r.field) for r in encodings.garbled_fields(pages, fixer).distinct().collect()}
    assert {(1000 + i, "text") for i in range(len(CHAINS))} <= found
    assert {(2004, "text"), (2004, "title")} <= found
    assert len(found) == len(CHAINS) + 2, [(f, fixer.words(w), fixer.margin) for f in found - {(1000 + i, "text") for i in range(8)} for w in ["Ångströmova König São naïve ½ ± §", "Çelar Ña."]]
    for i, (x, y) in enumerate(CHAINS):
        if x == "utf-8" or y == "cp1252":
            assert fixer.restored(wrong(CLEAN[0] + " " + CLEAN[1], x, y)) == CLEAN[0] + " " + CLEAN[1], (x, y)


def test_clean_and_missing_values_stay(pages, fixer):
    out = {r.page_id: r for r in encodings.restore(pages, fixer).collect()}
    assert out[2000].text is None and out[2001].text == "" and out[2002].text == "Ångströmova König São naïve ½ ± §" and out[2000].field == "clash"
    assert all(out[i].text == CLEAN[i % len(CLEAN)] + "\n" + CLEAN[(i + 1) % len(CLEAN)] for i in range(120))


def test_two_steps(fixer):
    once = wrong(CLEAN[0], "utf-8", "cp1252")
    assert fixer.restored(wrong(once, "utf-8", "cp1250")) == CLEAN[0]


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, text string, title string")
    fixer = encodings.train(none)
    assert encodings.garbled_fields(none, fixer).count() == 0 and encodings.restore(none, fixer).count() == 0


def test_a_long_word_is_looked_at_in_parts(fixer):
    import re

    word = ".".join(CLEAN[0].replace(" ", ",") for _ in range(60))
    assert len(word) > 4000 and fixer.garbled(wrong(word, "utf-8", "cp1252")) and not fixer.garbled(word)
    for t in ("a" * 199 + "č", "č" * 1000, "x" * 201, word):
        parts = re.findall(encodings.SPLIT, t)
        assert "".join(parts) == t and max(map(len, parts)) <= encodings.LONGEST
    assert re.findall(encodings.SPLIT, "a" * 199 + "č b") == ["a" * 199 + "č", "b"]


@pytest.mark.parametrize("most", [1, 99, 100, 350, 400])
def test_most_frequent_fills_its_bound(spark, most):
    """Neither equal counts nor one large class leaves less than there is room for."""
    import warnings

    from scriptorium.llm.words import most_frequent

    same = spark.createDataFrame([(f"w{i}", 2) for i in range(400)], "word string, n long")
    mixed = spark.createDataFrame([(f"w{i}", 1 + i * i % 5000) for i in range(400)], "word string, n long")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got, other = most_frequent(same, most), most_frequent(mixed, most)
        assert len(got) == len(other) == most
        assert any("rows of counts" in str(w.message) for w in said) == (most < 400)
    least = min(r.n for r in other)
    assert {1 + i * i % 5000 for i in range(400) if 1 + i * i % 5000 > least * 1.03} <= {r.n for r in other}
    assert [tuple(r)[:2] for r in got] == [tuple(r)[:2] for r in most_frequent(same, most)]


def plain(text):
    """Consistent form by whole-string calls; the brute force."""
    out = []
    for c in text:
        if ord(c) in forms.INVISIBLE:
            continue
        out.append(" " if ord(c) in forms.SPACES else unicodedata.normalize("NFKC", c)[0] if 0xFF01 <= ord(c) < 0xFF5F else c)
    return unicodedata.normalize("NFC", "".join(out))


def unified(text):
    raw = text.encode()
    points, row, _ = forms.block(raw, __import__("numpy").array([len(raw)]))
    return forms.rewrite(points, row)[0].tobytes().decode("utf-32-le")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abčdé ３Ａｚ́̌​­﻿  \n.²½", max_size=40))
def test_forms_agree_with_whole_string_calls(text):
    assert unified(text) == plain(text)
    assert unified(unified(text)) == unified(text)


def test_look_alikes_by_word():
    assert unified("Тhе кran рevný") == "The кran pevný" or unified("Тhе рevný") == "The pevný"
    assert unified("опалубка а beton") == "опалубка а beton"
    assert unified("АХ-78493") == "AX-78493"
    assert unified("Δ λ φ m² ½ Ångström") == "Δ λ φ m² ½ Ångström"
    assert unified("ﬁ") == "fi" and unified("") == ""


def test_odd_rows_and_unify(spark):
    rows = [("a", "plain"), ("b", "s​kryté"), ("c", None), ("d", ""), ("e", "опалубка"), ("f", "ｗｉｄｅ " * 50_000), ("b", "s​kryté"), ("g", "č rtž")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("__text", F.lit(1)).drop("__text").withColumn("kind", F.lit("x"))
    assert sorted(r.id for r in forms.odd_rows(df).collect()) == ["b", "b", "f", "g"] or sorted({r.id for r in forms.odd_rows(df).collect()}) == ["b", "f"]
    got = {r.id: r.text for r in forms.unify(df).collect()}
    assert got["b"] == "skryté" and got["c"] is None and got["d"] == "" and got["f"] == "wide " * 50_000 and got["e"] == "опалубка"
    none = df.limit(0)
    assert forms.unify(none).count() == 0 and forms.odd_rows(none).count() == 0


def test_unified_covers_pages_and_chunks(spark, tmp_path):
    import hashlib

    from scriptorium.llm import queries

    spark.createDataFrame([(1, "pl​ain"), (2, None), (1, "pl​ain")], "page_id long, text string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([("c1", "Ｗide › x\n\nbody", "body"), ("c2", "ok", "ok")], "id string, text string, body string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r.rec, r.rec_key): (r.sha1, r.n_chars) for r in queries.p3_unified(spark, str(tmp_path)).collect()}
    want = {("page", "1"): "plain", ("page", "2"): None, ("chunk", "c1"): "Wide › x\n\nbody", ("chunk", "c2"): "ok"}
    assert got == {k: (t and hashlib.sha1(t.encode()).hexdigest(), t and len(t)) for k, t in want.items()}


DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_whole_texts_are_given_back(spark):
    """Sound Czech pages put through wrong decodings: how many come back whole."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    fixer = encodings.train(pages)
    texts = [r.text for r in pages.where(F.col("text").rlike(encodings.CLEAN) & (F.col("lang") == "cs") & (F.col("content_type") == "text/html")).select("text").distinct().orderBy("text").limit(60).collect()]
    assert len(texts) > 3 and not any(map(fixer.garbled, texts))
    for x, y in (*CHAINS, ("cp1250", "latin_1"), ("cp1250", "mac_roman"), ("iso8859_2", "latin_1"), ("cp852", "cp1252"), ("utf-8", "mac_roman")):
        want = [t.encode(x, "ignore").decode(x) for t in texts]
        back = [fixer.restored(wrong(t, x, y)) for t in texts]
        assert sum(a == b for a, b in zip(back, want)) >= 0.85 * len(texts), (x, y)
    half = texts[0] + "\n" + wrong(texts[1], "cp852", "cp1250") + "\n" + texts[2]
    assert fixer.restored(half).split("\n")[0] == texts[0].split("\n")[0] and fixer.restored(half).endswith(texts[2])


def test_chains_by_name():
    for x, y in CHAINS:
        assert encodings.read_through(f"{x if x != 'utf-8' else 'utf-8'}<{y}", wrong("šířka", x, y)) == "šířka"
    twice = wrong(wrong("šířka", "utf-8", "cp1252"), "utf-8", "cp1250")
    assert encodings.read_through("utf-8<cp1252<cp1250", twice) == "šířka" and encodings.read_through("utf-8<cp1250", "řeka") is None


def test_thresholds_come_from_all_words(spark):
    """Margins against all clean words by brute force, where the frequent ones alone give others; no n-gram is left out."""
    import inspect
    import random

    rng = random.Random(3)
    often = [f"kůň{a}{b}" for a in "abcdefghijklmnoprstuvyz" for b in "aábcčdďeéěfghiíjklmnňoóprřsštťuúůvyýzž"][:820]
    seldom = ["".join(rng.choices("áčďéěíňóřšťúůýžbdkmps", k=8)) for _ in range(900)] + ["".join(rng.choices("qwxzvkjh", k=7)) for _ in range(300)]
    rows = [(i, " ".join(often), "t") for i in range(4)] + [(10, " ".join(seldom), "t")]
    fixer = encodings.train(spark.createDataFrame(rows, "page_id long, text string, title string"))
    model = encodings.Repairer(fixer.model)
    words = {**{w: 4 for w in often}, **{w: 1 for w in seldom}}
    filled = sorted(model.fill("".join(c if c.isascii() else "?" for c in w)) / len(w) for w in words if not w.isascii())
    assert filled[len(filled) // 50] < -2.7 and abs(fixer.filled - filled[len(filled) // 50]) < 2e-3
    gains = lambda of: sorted(g for w, n in words.items() for g in of(model, w) for _ in range(n))
    alarms, caught = gains(encodings._alarms), sorted(g for w, n in words.items() if not w.isascii() for g in encodings._caught(model, w) for _ in range(n))
    want = max(6.0, min(alarms[int(len(alarms) * 0.98)] + 1.0, 0.8 * caught[len(caught) // 20]))
    assert abs(fixer.margin - want) < 2e-3
    assert fixer.model.counts == encodings.ngrams_of({**words, "t": 5}) and inspect.signature(encodings.train).parameters["ngrams"].default is None
