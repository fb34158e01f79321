import random

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import curves, parity

RNG = random.Random(9)
WORDS = [f"w{i}" for i in range(400)]


def texts():
    rows = []
    for g in range(25):
        base = RNG.choices(WORDS, k=RNG.choice((12, 60, 200, 700)))
        rows.append(base)
        for _ in range(3):
            edited = list(base)
            for _ in range(max(1, len(base) // RNG.choice((8, 12, 25)))):
                edited[RNG.randrange(len(edited))] = RNG.choice(WORDS)
            rows.append(edited)
        cut = len(base) // 2
        rows.append(base[cut:] + base[:cut])
        rows.append(base + RNG.choices(WORDS, k=len(base) // 3))
        rows.append(list(base))
    return [(i, " ".join(w).capitalize() + ".") for i, w in enumerate(rows)]


def jaccard_pairs(rows, least, words=3):
    sets = []
    for k, t in rows:
        w = parity.WORD.findall((t or "").lower())
        sets.append((k, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}))
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if x and y and len(x & y) >= least * len(x | y)}


def test_pairs_against_brute_force(spark):
    rows = texts()
    odd = [(900, None), (901, ""), (902, "two words"), (903, None), (904, "a b c"), (905, "A, b; c"), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "k long, t string").withColumn("size", F.lit("clash")).withColumn("id", F.lit(5))
    got = {(r.key_a, r.key_b) for r in parity.similar_pairs(df, "k", "t", 0.5, 3).distinct().collect()}
    want = jaccard_pairs(rows + odd[:-1], 0.5)
    assert not got - want and len(want - got) <= 0.01 * len(want) and (904, 905) in got


def test_exact_way_against_brute_force(spark):
    rng = random.Random(7)
    rows = texts() + [(2000 + i, " ".join(rng.choices("abcd", k=rng.randint(3, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t string")
    for similarity in (0.5, 0.8):
        got = {(r.key_a, r.key_b) for r in parity.similar_pairs(df, "k", "t", similarity, 3, exact=True).distinct().collect()}
        assert got == jaccard_pairs(rows, similarity)


def boilerplate(n, own=9):
    return [(i, "all rights reserved " + " ".join(f"u{i}x{j}" for j in range(own))) for i in range(n)]


def test_boilerplate_makes_no_candidates(spark, monkeypatch):
    """Short texts that share one shingle: candidates must not grow with the square of their number."""
    counts = []
    verify = parity._hamming
    monkeypatch.setattr(parity, "_hamming", lambda pairs, *a: (counts.append(pairs.count()), verify(pairs, *a))[1])
    for n in (500, 1000, 2000, 4000):
        df = spark.createDataFrame(boilerplate(n), "k long, t string")
        assert parity.similar_pairs(df, "k", "t", 0.5, 3).count() == 0
    assert max(counts) < 100, counts


def test_crowded_parts_lose_no_pair(spark, monkeypatch):
    """Parts with many members are joined by the exact way."""
    monkeypatch.setattr(parity, "MEMBERS", 6)
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, common + " " + " ".join(rng.choices(WORDS, k=rng.choice((5, 30, 80))))) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {(r.key_a, r.key_b) for r in parity.similar_pairs(df, "k", "t", 0.5, 3).distinct().collect()}
    want = jaccard_pairs(rows, 0.5)
    assert len(want) > 500 and not got - want and len(want - got) <= 1e-3 * len(want)


def test_tiny_sets(spark):
    rows = [(1, "a b c"), (2, "a b c d"), (3, "b c d"), (4, "x a b c"), (5, "a b c d e"), (6, "b c d e f"), (7, "A B C")]
    got = {(r.key_a, r.key_b) for r in parity.similar_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.5, 3).distinct().collect()}
    assert got == jaccard_pairs(rows, 0.5)


def test_groups_are_components(spark):
    rows = [r for r in texts() if len(r[1]) > 200][:60]
    df = spark.createDataFrame([*rows, (999, None), (998, "x y z")], "k long, t string")
    got = {r.key: r for r in parity.groups(df, "k", "t", 0.5, 3).collect()}
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in jaccard_pairs(rows, 0.5):
        parent[root(a)] = root(b)
    ours, truth = {}, {}
    for k, _ in rows:
        ours.setdefault(got[k].group_id, set()).add(k)
        truth.setdefault(root(k), set()).add(k)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, truth.values()))
    assert got[998].links == 0 and 999 not in got


def test_hamming_bounds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(50, 200)], rng.integers(0, 2**63, 60, dtype=np.uint64)]))
        s = parity.sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 24, 3)
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def test_no_rows(spark):
    none = spark.createDataFrame([], "k long, t string")
    assert parity.similar_pairs(none, "k", "t", 0.5, 3).count() == 0 and parity.groups(none, "k", "t", 0.5, 3).count() == 0
    assert curves.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((150, 32))
    x = (centres[rng.integers(0, 150, 3000)] + 0.25 * rng.standard_normal((3000, 32))) * rng.uniform(0.3, 30, (3000, 1))
    x[7] = x[8] * 2
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [None] + [1.0] * 31), (5003, []), (3, [float(v) for v in x[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    got = {(r.id, r.other) for r in curves.neighbours(df, window=64).where("id % 100 = 0").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in range(0, 3000, 100):
        s = u @ u[q]
        s[q] = -2
        want |= {(q, int(i)) for i in np.argsort(-s)[:10]}
    assert len(got & want) / len(want) >= 0.9 and not {i for i, _ in got} & {5000, 5001, 5002, 5003}
    assert not any(a == b for a, b in got)


def test_pieces_of_a_range_cut_no_window(monkeypatch):
    """Rows of two curves in batches of odd sizes, worked on piece by piece, against all at once."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, window, k = 700, 30, 5
    x = rng.standard_normal((2 * n, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    curve, ids, own = np.repeat([0, 1], n), rng.permutation(2 * n), rng.random(2 * n) > 0.1
    whole = pa.RecordBatch.from_arrays([pa.array(np.zeros(2 * n, np.int32)), pa.array(curve), pa.array(np.arange(2 * n)), pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(own)], names=["part", "curve", "key", "id", "v", "own"])
    rows = lambda out: sorted((i, o) for b in out for i, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    monkeypatch.setattr(curves, "BLOCK", 1)
    want = rows(curves.windows([whole], k, window, -2.0))
    monkeypatch.setattr(curves, "PIECE", 40)
    edges = np.unique(np.concatenate([[0, 2 * n], rng.integers(0, 2 * n, 60)]))
    assert rows(curves.windows([whole.slice(a, b - a) for a, b in zip(edges, edges[1:])], k, window, -2.0)) == want
    at = {(int(c), int(i)): p for p, (c, i) in enumerate(zip(curve, ids))}
    for i, o in want:
        c = 0 if (0, i) in at else 1
        assert abs(at[c, i] - at[c, o]) <= window and own[at[c, i]]
    assert len(want) == own.sum() * k
    least = 0.3
    full = {(i, o): s for b in curves.windows([whole], k, window, -2.0) for i, o, s in zip(*(b.column(j).to_pylist() for j in range(3)))}
    assert rows(curves.windows([whole], k, window, least)) == sorted(p for p, s in full.items() if s >= least)


def test_recall_against_the_exact_way(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((90, 24))
    x = centres[rng.integers(0, 90, 2500)] + 0.3 * rng.standard_normal((2500, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))] + [(9000, None)], "vec_id long, embedding array<float>")
    true = curves.exact(df, df.where("vec_id % 50 = 0"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 1200):
        s = np.round(u @ u[q], 5)
        s[q] = -2
        got = [r.other for r in true.where(f"id = {q}").orderBy("rank").collect()]
        assert np.allclose(s[got], s[np.lexsort((np.arange(len(s)), -s))[:10]], atol=2e-5)
    assert curves.recall(true, true) == 1.0 and curves.recall(true.where("rank <= 5"), true) == 0.5
    assert curves.recall(curves.neighbours(df, window=96), true) > 0.9


def test_hilbert_is_a_curve():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = curves.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.1])], "vec_id long, embedding array<float>")
    got = {(r.id, r.rank): (r.other, round(r.similarity, 5)) for r in curves.neighbours(df).collect()}
    assert got[1, 1] == (2, 1.0) and got[2, 1] == (1, 1.0) and got[4, 1][0] == 5 and len(got) == 8


def test_copies_take_no_room_and_go_by_id(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((400, 16))
    base[:40] = base[0] + 0.05 * rng.standard_normal((40, 16))  # near the large group, on its both sides
    base[40:80] = base[40] + 0.05 * rng.standard_normal((40, 16))
    x = np.concatenate([base, np.repeat(base[:1], 5000, 0), np.repeat(base[40:41], 50, 0)])
    x = x[rng.permutation(len(x))] * rng.uniform(0.3, 30, (len(x), 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in curves.neighbours(df, window=64).collect():
        got.setdefault(r.id, {})[r.rank] = r.other
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    copies = np.flatnonzero((np.round(u @ u.T, 5) == 1).sum(1) > 1)
    near = np.flatnonzero(((u @ u[copies].T).max(1) > 0.97) & ~np.isin(np.arange(len(x)), copies))
    assert len(copies) == 5052 and len(near) > 60 and len(got) == len(x)
    for q in [*copies[::50], *near]:
        s = u @ u[q]
        s[q] = -2
        ours, want = [got[q][k] for k in range(1, 11)], np.lexsort((np.arange(len(x)), -np.round(s, 5)))[:10]
        # float32 may round the fifth digit of unlike vectors the other way; copies have to be the same ones.
        assert np.allclose(s[ours], s[want], atol=1.1e-5) and [o for o in ours if o in copies] == [o for o in want if o in copies]


def test_worst_size_ratio_right_at_the_bound(spark):
    # A record that holds another one whole and as many shingles again: similarity is exactly a half.
    rng, rows = random.Random(3), []
    for n in (25, 45, 100, 200):
        for i in range(400):
            words = [f"x{rng.getrandbits(40)}" for _ in range(2 * n + 2)]
            rows += [(2 * len(rows), " ".join(words[: n + 2])), (2 * len(rows) + 1, " ".join(words))]
    pairs = {(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2])}
    got = parity.similar_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.5, 3).collect()
    assert {(r.key_a, r.key_b) for r in got} == pairs


def test_no_size_is_missed_at_the_bound():
    bands = parity.similar_classes.__defaults__
    bands = parity.Bands(0.5, bands[2], bands[3])
    assert max(bands.miss(a, b) for a in (*range(parity.TINY + 1, 200), *range(200, 4000, 37)) for b in {a, a * 5 // 4, a * 8 // 5, a * 19 // 10, 2 * a}) < 1e-4


def test_passes_meet_the_same_pairs(spark, monkeypatch):
    """Every part belongs to one pass, of about equal shares, and passes and slices give what all parts at once give."""
    rows = texts()
    df = spark.createDataFrame(rows, "k long, t string")
    sets = parity._sets(df, "k", "t", 3).where("hashes IS NOT NULL").withColumnRenamed("key", "k")
    bands = parity.Bands(0.5, 128, 2.35)
    digest = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)"))).first()
    whole, each = digest(parity._part_keys(sets, bands)), [digest(parity._part_keys(sets, bands, at, 8)) for at in range(8)]
    assert sum(x[0] for x in each) == whole[0] and sum(x[1] for x in each) == whole[1]
    assert max(x[0] for x in each) < 0.2 * whole[0]
    pairs = lambda: sorted(map(tuple, parity.similar_pairs(df, "k", "t", 0.5, 3).distinct().collect()))
    want = pairs()
    monkeypatch.setattr(parity, "PASS", 1000)
    assert pairs() == want and len(want) > 100


def test_files_of_a_step_go_with_it(spark, monkeypatch, tmp_path):
    """Beside one copy of the sets no more lies on disk than a step makes: shuffle files go after each, sets and parts at the end."""
    import os
    import time

    files = lambda: [f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f]
    rng = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=150))) for i in range(300)], "k long, t string")
    monkeypatch.setattr(parity, "PASS", 1000)
    old, left, cut, made = set(files()), [], parity.cut, []

    def watched(d, **how):
        out = cut(d, **how)
        made.append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:"))
        until = time.time() + 5
        rest = lambda: sum(os.path.getsize(f) for f in set(files()) - old if os.path.exists(f))
        while rest() > 20_000 and time.time() < until:  # counts and sums leave a few bytes
            time.sleep(0.05)
        left.append(rest())
        return out

    monkeypatch.setattr(parity, "cut", watched)
    parity.similar_classes(df, "k", "t", 0.5, 3)
    assert len(left) > 3 * parity.PASSES and max(left) <= 20_000, left
    assert not os.path.exists(made[0]) and sum(map(os.path.exists, made)) < len(made) - parity.PASSES
