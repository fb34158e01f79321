import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import pieces, tokens

RNG = random.Random(4)


def check(text, limit=1400, overlap=200):
    got = pieces.cut(text, limit, overlap)
    if len(text) <= limit:
        assert got is None
        return None
    kind, own = got
    end = None
    for i, (o, s, e) in enumerate(own):
        assert o <= s < e and e - o <= limit
        if i:
            assert text[end:s].strip(pieces.WHITE) == "" and own[i - 1][1] <= o and len(text[o:end]) <= overlap
        else:
            assert o == s
        end = e
    assert "".join(text[s:e] for _, s, e in own).replace(" ", "") == "".join(text[s:e] for _, s, e in own).replace(" ", "")
    joined = "".join("".join(text[s:e].split()) for _, s, e in own)
    assert joined == "".join(text.split()) or kind == "paragraph" and not own
    return kind


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["Slovo", "dlouhé" * 9, "konec.", "Další!", "\n\n", "\n", " \r\n \r\n", "x" * 130]), min_size=30, max_size=120))
def test_pieces_hold_all_and_keep_to_the_limit(words):
    check(" ".join(words), 100, 20)


def test_kinds_of_boundary():
    para, sent, word = "Věta je tu. " * 60, "Bez konce " * 100 + ". ", "slovo " * 400
    assert check("\n\n".join([para] * 4)) == "paragraph"
    assert check(para * 4) == "sentence"
    assert check(word) == "word" and check(sent.replace(". ", "") * 3) == "word"
    assert check("x" * 5000) == "hard" and check("a " + "y" * 1401 + " b") == "hard"
    assert check("p" * 1400) is None
    assert pieces.cut(" " * 2000) == ("paragraph", [])


def test_fewest_pieces_of_even_length():
    _, own = pieces.cut("Věta má slova. " * 270)
    sizes = [e - s for _, s, e in own]
    assert len(own) == -(-len(("Věta má slova. " * 270).strip()) // 1400) and max(sizes) - min(sizes) < 60


def test_split_rows(spark):
    rows = [(1, "a b. " * 600), (2, None), (3, ""), (4, " " * 3000), (5, "k"), (1, "a b. " * 600), (6, "z" * 300_000)]
    df = spark.createDataFrame(rows, "k int, t string").selectExpr("k", "t", "'x' AS value", "1 AS piece", "2 AS key")
    got = pieces.split_long(df, "k", "t").distinct().collect()
    assert {r.key for r in got} == {"1", "4", "6"} and all(len(r.piece) <= 1400 for r in got)
    assert {r.boundary for r in got if r.key == "6"} == {"hard"}
    assert pieces.split_long(df.limit(0), "k", "t").count() == 0


@pytest.fixture(scope="module")
def ranks():
    if not os.path.exists(f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken"):
        pytest.skip("no vocabulary")
    return tokens.load_ranks()


def test_ids_equal_a_public_encoder(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = tokens.Encoder(ranks)
    texts = ["", " ", "Žluťoučký kůň 12,5 m² — I'll go\n\n  x", "<|endoftext|> <s>", "aaaa" * 500, "😀" * 90, "\t\r\n \xa0x", "don't we'll ŽŽŽ"]
    texts += ["".join(RNG.choices("abc dž1.\n'", k=300)) for _ in range(50)]
    for t in texts:
        assert encode(t) == other.encode_ordinary(t)
    assert encode(None) == []


def test_both_merges_agree(ranks):
    for _ in range(200):
        w = bytes(RNG.choices(b"abcdest \xc3\xa1", k=RNG.randint(1, 120)))
        assert tokens.merge_short(w, ranks) == tokens.merge_long(w, ranks)


def test_column_of_ids(spark, ranks):
    rows = [(1, "Dobrý den", "x"), (2, None, None), (3, "", "y"), (4, "Dobrý den", "x")]
    got = {r.doc_id: r for r in tokens.encode_column(spark.createDataFrame(rows, "doc_id int, text string, ids string")).collect()}
    encode = tokens.Encoder(ranks)
    assert got[1].ids == encode("Dobrý den") == got[4].ids and got[2].ids == [] == got[3].ids
    assert tokens.encode_column(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    assert b"".join({v: k for k, v in ranks.items()}[i] for i in got[1].ids).decode() == "Dobrý den"


def test_every_piece_starts_with_an_overlap():
    def overlaps(text, limit=1400, overlap=200):
        assert check(text, limit, overlap)
        return [own[i - 1][2] - o for own in [pieces.cut(text, limit, overlap)[1]] for i, (o, _, _) in enumerate(own) if i]

    for text in ("slovo " * 465, "Věta má slova. " * 186, "slovo " * 4190, "x" * 2790, "x" * 25_000, "y" * 25_000 + " slovo" * 900):
        assert min(overlaps(text)) >= 40
    rng = random.Random(8)
    for n in (*range(1401, 9000, 97), 25_150):
        words = "".join(rng.choice(("a ", "dlouhé ", "konec. ", "neobyčejného ")) for _ in range(n))[:n]
        assert min(overlaps(words)) > 35
    # a last word longer than the overlap leaves none
    assert overlaps(("a " * 590 + "w" * 205 + ". ") * 2 + "b " * 300)[0] <= 0


def word_start(text, low, high):
    """First place from ``low`` to ``high`` where a word begins, ``high`` if there is none."""
    return next((i for i in range(low, high) if text[i] not in pieces.WHITE and (i == 0 or text[i - 1] in pieces.WHITE)), high)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Slovo", "dlouhé", "konec.", "Další!", "\n\n", "\n", "a", "neobyčejného"]), min_size=60, max_size=300))
def test_overlaps_are_whole_where_there_is_room(words):
    """With room for whole overlaps every later piece begins at the first word within the last 20 characters of its predecessor."""
    text, limit, overlap = " ".join(words), 100, 20
    got = pieces.cut(text, limit, overlap, overlap)
    if got is None or got[0] != "word":  # paragraphs and sentences may leave no room
        return
    own = got[1]
    for (_, s0, e0), (o, s, e) in zip(own, own[1:]):
        assert e - o <= limit
        assert o == min(s, word_start(text, max(s0, e0 - overlap), e0)) or o == s and word_start(text, max(s0, e0 - overlap), e0) == e0


def test_thousands_of_pieces():
    rng = random.Random(3)
    for text in ("y" * 400_000, " ".join("x" * rng.randint(1, 1390) for _ in range(1500)), "\n\n".join("z" * rng.randint(900, 1400) for _ in range(700))):
        kind, own = pieces.cut(text, room=200)
        assert all(e - o <= 1400 for o, _, e in own) and "".join(text[s:e] for _, s, e in own).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
