import os
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import languages, mixing, tokens

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
needs_words = pytest.mark.skipif(not os.path.exists(f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken"), reason="no vocabulary")


@pytest.fixture(scope="module")
def network(spark):
    return languages.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/lang_samples.parquet"), 600)


@needs_data
def test_held_out_sentences(spark, network):
    """Fitted on half of the clean sentences and the documents, tested on the other half."""
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    half = languages.train(spark.read.parquet(f"{DATA}/documents.parquet"), samples.where("sample_id % 2 = 0"), 600)
    rest = samples.where("sample_id % 2 = 1").collect()
    s = half.sentences([languages.letters(r.text) for r in rest])
    assert np.mean([languages.LANGUAGES[i] == r.lang for i, r in zip(s.argmax(1), rest)]) >= 0.98


@needs_data
def test_segments(spark, network):
    cs, en = "Široký nosník podpírá střechu. Deska určuje úzký výkop při plném zatížení. ", "The wide beam supports the roof. The slab defines the narrow trench under full load. "
    rows = [
        (1, cs + en, "cs"), (2, cs, None), (3, cs, "cs-CZ"), (4, None, None), (5, "", "und"), (6, "12 | 3 % — ±", "en"), (7, en, "UND"), (8, cs + "The beam supports the roof. " + cs, "CS"), (9, "Široký nosník podpírá střechu", ""),
        (10, cs * 400, "en"), (11, "  \n\n ", None),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").selectExpr("*", "'x' AS label", "1 AS key")
    got = {}
    for r in languages.label_segments(df, network).collect():
        got.setdefault(r.key, []).append((r.seg_no, r.lang, r.label))
        assert 0 < r.confidence <= 1 and r.start < r.end
    assert sorted(got[1]) == [(0, "cs", "cs"), (1, "en", "cs")] and got[2] == [(0, "cs", "")] and got[3] == [(0, "cs", "cs")] and got[7] == [(0, "en", "")]
    assert got[8] == [(0, "cs", "cs")] and got[9] == [(0, "cs", "")] and got[10] == [(0, "cs", "en")] and not {4, 5, 6, 11} & set(got)
    assert languages.label_segments(df.limit(0), network).count() == 0


def test_words_and_windows_give_the_same_values():
    net = languages.Network()
    raws = [languages.letters(t) for t in ("Široký nosník podpírá střechu", "a", "slovo " * 30, "nejneobhospodařovávatelnějšího kvůli")]
    x, of = languages.windows(raws)
    whole = net.pooled(x)
    net.sentences(raws)
    at = 0
    for raw in raws:
        for own in languages.shares(raw.split()):
            values = np.maximum.reduce([net.rows[net.index[w]] for w in own])
            if len(b"".join(own)) + len(own) * (2 + len(languages.GAP)) + len(languages.GAP) <= languages.LENGTH:
                assert np.allclose(values, whole[at], atol=1e-5)
            at += 1


def test_windows_of_long_words_lose_nothing():
    rng = np.random.default_rng(1)
    net = languages.Network()
    raws = [b" ".join(bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in sizes) for sizes in ([400, 3], [30] * 9, [1] * 25, [157, 156, 1], [2000])]
    x, of = languages.windows(raws)
    assert x.shape[1] == languages.LENGTH and set(of.tolist()) == set(range(len(raws)))
    for i, raw in enumerate(raws):
        assert b"".join(bytes(r) for r in x[of == i]).replace(b"\0", b"").replace(b" ", b"") == raw.replace(b" ", b"")
    # what words give, alone and put together, is what their windows give
    z = net.pooled(x) @ net.out + net.bias
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    want = np.array([z[of == i].mean(0) for i in range(len(raws))])
    assert np.allclose(net.sentences(raws), want, atol=1e-5)


def test_path_has_no_single_sentence():
    rng = np.random.default_rng(0)
    for n in (2, 3, 4, 7, 30):
        for _ in range(50):
            p = languages.path(np.log(rng.dirichlet(np.ones(5) * 0.3, n) + 1e-9))
            runs = [len(list(g)) for _, g in __import__("itertools").groupby(p)]
            assert len(p) == n and min(runs) >= 2
    assert languages.path(np.zeros((0, 5))) == [] and len(languages.path(np.zeros((1, 5)))) == 1


def test_permutation_is_one():
    for n in (1, 2, 7, 64, 1000):
        k = np.arange(n)
        for key in (3, 99):
            assert sorted(mixing.permuted(k, np.full(n, n), np.full(n, key, np.uint64)).tolist()) == k.tolist()


@needs_words
def test_mix(spark):
    docs = [(i, f"Slovo číslo {i} a další text o stavbě. " * (1 + i % 7), "big" if i % 5 else "small") for i in range(400)] + [(900, None, "big"), (901, "", "small"), (902, "bez zdroje", None), (903, "jiné", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS n", "'x' AS raw")
    targets = spark.createDataFrame([("m", "big", 0.5, 2, 1.0), ("m", "small", 0.5, 2, 1.0), ("z", "none", 1.0, 3, 0.5)], "mix string, source string, target_share double, max_repeats int, size_factor double")
    encode = tokens.Encoder(tokens.load_ranks())
    size = Counter()
    for _, t, s in docs:
        size[s] += len(encode(t))
    full = mixing.mix(df, targets, 64)
    rows = full.collect()
    uses = Counter((r.mix, r.source, r.block) for r in rows)
    assert max(uses.values()) <= 2 and len({(r.mix, r.shard, r.slot) for r in rows}) == len(rows)
    by_block = {(r.source, r.block): r.ids for r in rows}
    assert all(len(v) == 64 for (s, b), v in by_block.items() if b < (size[s] - 1) // 64)
    small = [r for r in rows if r.source == "small"]
    assert 0.9 * min(2 * size["small"], sum(len(r.ids) for r in rows) / 2) <= sum(len(r.ids) for r in small) <= 2 * size["small"]
    again = mixing.mix(df, targets, 64).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    for r in mixing.shares(df, targets, 64, ("shares",)).collect():
        assert r.most_repeats <= r.max_repeats
        if r.mix == "m":
            assert abs(r.actual_share - r.target_share) < 0.1
        else:
            assert r.tokens == 0
    assert mixing.mix(df.limit(0), targets, 64).count() == 0 and mixing.mix(df, targets.limit(0), 64).count() == 0


@needs_words
def test_blocks_hold_every_token_once(spark):
    docs = [(i, "abc def " * (i % 40), "s") for i in range(300)]
    got = mixing.blocks(mixing.encoded(spark.createDataFrame(docs, "doc_id long, text string, source string")), 100).collect()
    encode = tokens.Encoder(tokens.load_ranks())
    assert Counter(i for r in got for i in np.frombuffer(r.raw, "<i4").tolist()) == Counter(i for _, t, _ in docs for i in encode(t))
    assert sorted(r.block for r in got) == list(range(len(got))) and all(r.n == 100 for r in got if r.block < len(got) - 1)


@needs_words
def test_decoding_gives_the_text_again(spark):
    rows = [(1, "Žluťoučký kůň 😀\n"), (2, ""), (3, None), (4, "<|endoftext|>")]
    df = tokens.encode_column(spark.createDataFrame(rows, "doc_id int, text string"))
    assert {r.doc_id: r.text for r in tokens.decode_column(df).collect()} == {k: t or "" for k, t in rows}
    assert tokens.decode_column(df.limit(0)).count() == 0


def test_running_total_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 10)
    df = spark.range(1000).selectExpr("id", "id % 3 AS g", "id % 7 AS n")
    rows = mixing.running_total(df, ["g"], ["id"], "n", "at").collect()
    for g in range(3):
        own = sorted((r.at, r.at + r.n) for r in rows if r.g == g)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_overdrawn_slots_go_to_sources_with_room(spark):
    for seed in (1, 2, 3):
        of = [("a", 0.5, 500, 1), ("b", 0.3, 900, 1), ("c", 0.2, 100, 2)]  # a and c are planned at their caps
        planned = [{"mix": "m", "source": s, "share": share, "blocks": blocks, "cap": blocks * repeats, "slots": 1000} for s, share, blocks, repeats in of]
        rows = mixing.slots(spark, planned, per_shard=64, seed=seed).collect()
        assert len(rows) == 1000 == len({(r.source, r.block, r.round) for r in rows}) == len({(r.shard, r.slot) for r in rows})
        assert all(sum(r.source == p["source"] for r in rows) <= p["cap"] for p in planned)
    assert mixing.handed_on([{"share": 0.5, "cap": 4}, {"share": 0.5, "cap": 5}], [9, 2]) == [0, 3]
