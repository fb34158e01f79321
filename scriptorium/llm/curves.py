"""Most similar vectors for every vector, by shifted space-filling curves (problem 4).

Vectors are normalised, and those that are equal then (to GRID in each number) form a class, of which the member
with the smallest id stands for all; everything up to the last step runs over these distinct vectors, so copies
take no room in windows and lists. For each of several curves, vectors are projected onto a few random directions, shifted, cut
to a grid and placed along a Hilbert curve. Each curve's keys are range-partitioned and sorted in Spark; in
the sorted order every vector is compared with a window of its neighbours by matrix products, and the best
of a window are kept. The candidates of all curves merge, distinct, and the ``k`` best by cosine remain.
Ranges hold about ``RANGE`` rows whatever the size of the cluster. Rows at the edge of a range are also sent to
the range beside it, and a task that works through a range piece by piece carries both sides of a window over
from one piece to the next, so no window is cut short.

Windows find the close neighbours; where a vector has none, its ten best are hardly nearer than others and
many directions would be needed. So the lists are merged and reranked once more among themselves, ``rounds``
times: a vector's neighbours, and those that have it as one, are compared with each other, and a list takes
what is better than its last entry. A vector that very many have as a neighbour is split into blocks.
This search is approximate; ``exact`` compares a set of queries with all vectors in blocks, and says how much is found.
At last the classes of a list, and the vector's own class with similarity 1, are expanded to their smallest ids.

Results in special cases: null vectors, vectors with a null or non-finite number and all-zero ones take no
part; vectors of unlike length are no neighbours; repeated rows (equal id) count once; equal vectors are neighbours with similarity 1; ties go to the
smaller id; fewer than ``k`` others give fewer rows. Every usable vector is indexed and is a query.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import search
from scriptorium.session import cut, spread

CURVES, DIRECTIONS, BITS, WINDOW = 12, 6, 10, 384
#: Unit vectors that agree to this in each number are equal; copies scaled in float32 differ by about 1e-8.
GRID = 2.0**-20
BLOCK = 256
#: Rows of a range, about, and rows of a piece that a task works on at a time.
RANGE, PIECE = 50_000, 20_000


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each integer point (rows, dimensions) along the Hilbert curve, as one number below 2^(bits*dimensions)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def directions(dimension: int, curve: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions of a curve and its shift (as a share of the grid), from the curve's number alone."""
    rng = np.random.default_rng(977 + curve)
    q, _ = np.linalg.qr(rng.standard_normal((dimension, count)))
    return q.astype(np.float32), rng.random(count).astype(np.float32)


def place(x: np.ndarray, curve: int, count: int = DIRECTIONS, bits: int = BITS) -> np.ndarray:
    count = min(count, x.shape[1])
    base, shift = directions(x.shape[1], curve, count)
    # Unit vectors' projections lie within a few times 1/sqrt(d); the shift moves the grid, not the scale.
    scale = 4.0 / np.sqrt(x.shape[1])
    y = np.clip((x @ base) / (2 * scale) + 0.25 + 0.5 * shift, 0, 0.999999)
    return hilbert((y * (1 << bits)).astype(np.int64), bits)


def usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """id, v (unit length, as bytes of float32), digest (of v on the grid), once per id."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            ids, rows = batch.column(0), column.to_pylist() if column.null_count or not len(column) else None
            if rows is None:
                flat, offsets = column.flatten(), np.diff(column.offsets.to_numpy())
                even = len(set(offsets.tolist())) == 1 and not flat.null_count
                rows = flat.to_numpy().reshape(len(column), -1) if even else column.to_pylist()
            good, out, digests = [], [], []
            for i, r in enumerate(rows):
                if r is None or len(r) == 0 or any(z is None for z in r) if not isinstance(r, np.ndarray) else False:
                    continue
                v = np.asarray(r, np.float64)
                size = np.sqrt((v * v).sum())
                if np.isfinite(size) and size > 0:
                    good.append(i)
                    out.append((v / size).astype(np.float32).tobytes())
                    digests.append(blake2b(np.rint(v / size / GRID).astype(np.int32).tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good, pa.int64())).cast(pa.int64()), pa.array(out, pa.binary()), pa.array(digests, pa.binary())], names=["id", "v", "digest"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("e")).where(F.col("id").isNotNull() & F.col("e").isNotNull())
    return spread(rows).mapInArrow(run, "id long, v binary, digest binary").dropDuplicates(["id"])


def _keys(unit: DataFrame, curves: int) -> DataFrame:
    """curve, key, id: the place of every vector on every curve. Vectors of unlike length lie on curves of their own."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(1).to_pylist()
            by = {}
            for i, r in enumerate(raw):
                by.setdefault(len(r), []).append(i)
            for own in by.values():
                x = np.frombuffer(b"".join([raw[i] for i in own]), np.float32).reshape(len(own), -1)
                part = batch.take(pa.array(own))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c + 1000 * x.shape[1], np.int32)), pa.array(place(x, c)), part.column(0)], names=["curve", "key", "id"])

    return unit.mapInArrow(run, "curve int, key long, id long")


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a binary column, all of one length, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(len(column), -1)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` best of every row; what is equal to five digits goes by the smaller of ``ids``."""
    if score.shape[1] <= k:
        return np.tile(np.arange(score.shape[1]), (len(score), 1))
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(score, best, 1).min(1)
    tied = np.flatnonzero((score >= least[:, None] - 2e-5).sum(1) > k)
    if len(tied):
        near = np.round(score[tied].astype(np.float64), 5)
        best[tied] = np.lexsort((np.broadcast_to(ids, near.shape), -near), axis=1)[:, :k]
    return best


def compare(ids: np.ndarray, own: np.ndarray, x: np.ndarray, begin: int, end: int, k: int, window: int, least: float):
    """Batches (id, other, s) of the best of the windows of rows ``begin`` to ``end`` among rows in the order of a curve."""
    for a in range(begin, end, BLOCK):
        b = min(a + BLOCK, end)
        mine = np.flatnonzero(own[a:b]) + a
        if not len(mine):
            continue
        lo, hi = max(0, a - window), min(len(ids), b + window)
        s = x[mine] @ x[lo:hi].T
        s[np.arange(len(mine)), mine - lo] = -3
        if least > 0:  # few are as similar: those alone are ordered
            r, c = np.nonzero(s >= least)
            near = s[r, c]
            order = np.lexsort((ids[lo + c], -np.round(near.astype(np.float64), 5), r))
            r, c, near = r[order], c[order], near[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, c, near = r[kept], c[kept], near[kept]
        else:
            best = _top(s, ids[lo:hi], k)
            got = np.take_along_axis(s, best, 1)
            r, c = np.nonzero((got > -2.5) & (got >= least))
            c, near = best[r, c], got[r, c]
        yield pa.RecordBatch.from_arrays([pa.array(ids[mine[r]]), pa.array(ids[lo + c]), pa.array(near.astype(np.float32))], names=["id", "other", "s"])


def windows(batches, k: int, window: int, least: float):
    """The same for Arrow batches (part, curve, key, id, v, own) in order; a piece ends a window's width before what has come."""
    name, held, done = None, None, 0  # the rows held, of which the first ``done`` only serve as neighbours

    def end():
        return compare(*held, done, len(held[0]), k, window, least) if held is not None else ()

    for batch in batches:
        if not batch.num_rows:
            continue
        part, curve = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        change = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (curve[1:] != curve[:-1])) + 1).tolist(), len(part)]
        for a, b in zip(change, change[1:]):
            rows = batch.slice(a, b - a)
            new = [rows.column(3).to_numpy(zero_copy_only=False), rows.column(5).to_numpy(zero_copy_only=False), matrix(rows.column(4))]
            if (now := (part[a], curve[a])) != name:
                yield from end()
                name, held, done = now, new, 0
            else:
                held = [np.concatenate(c) for c in zip(held, new)]
            if len(held[0]) - done >= PIECE + window:
                stop = len(held[0]) - window
                yield from compare(*held, done, stop, k, window, least)
                held, done = [c[max(0, stop - window) :] for c in held], min(stop, window)
    yield from end()


def neighbours(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = 10, least: float = -2.0, curves: int = CURVES, window: int = WINDOW, rounds: int = 1, lists: int | None = None) -> DataFrame:
    """id, other, similarity, rank (from 1): the ``k`` most similar others of every usable vector.

    ``lists`` is the length of the lists while they are made (``k`` if not given); longer ones find more.
    ``least`` leaves out what is less similar from the start: the ten best of a vector that reach it are the
    same, but lists that it makes shorter lead the rounds to fewer vectors, so recall is that of the pairs asked for.
    """
    wanted, k = k, max(k, lists or k)
    everyone = cut(usable(vectors, key, embedding))
    unit = cut(everyone.groupBy("digest").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id")))
    members = everyone.select("digest", F.col("id").alias("member")).join(unit.select("digest", "id"), "digest").select("id", "member")
    unit = unit.select("id", "v")
    rows = _keys(unit, curves)
    parts = max(unit.sparkSession.sparkContext.defaultParallelism * 2, curves, -(-unit.count() * curves // RANGE))
    ranged = rows.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key", "id")
    # Sorted once and kept without the vectors; these are joined when the edges of the ranges are known.
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()))
    n = F.count("*").over(Window.partitionBy("part", "curve"))
    order = Window.partitionBy("part", "curve").orderBy("key", "id")
    edge = ranged.withColumn("at", F.row_number().over(order)).withColumn("n", n)
    first = edge.where(f"at <= {window} AND part > 0").select("curve", "key", "id", (F.col("part") - 1).alias("part"))
    last = edge.where(f"at > n - {window}").select("curve", "key", "id", (F.col("part") + 1).alias("part"))
    guests = first.unionByName(last).withColumn("own", F.lit(False))
    all_ = ranged.withColumn("own", F.lit(True)).unionByName(guests).join(unit, "id").select("part", "curve", "key", "id", "v", "own")
    # A range to a task, by its number: hashes of the numbers would put several into one.
    sorted_ = all_.repartitionById(parts, "part").sortWithinPartitions("part", "curve", "key", "id")
    found = sorted_.mapInArrow(lambda batches: windows(batches, k, window, least), "id long, other long, s float")
    # What one side finds, the other side gets as well; row by row, since a union would make the windows twice.
    pair = F.array(F.struct("id", "other", "s"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), "s"))
    near = _ranked(found.select(F.explode(pair).alias("pair")).select("pair.*"), k)
    for _ in range(rounds):
        near = cut(near)
        near = _ranked(near.select("id", "other", "s").unionByName(_exchange(near, unit, k, least, parts)), k)
    return _expanded(near, members, wanted)


def exact(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = 10) -> DataFrame:
    """id, other, similarity, rank of ``queries`` (some rows of ``vectors``) by comparison with all, in blocks of both.

    What the search is measured against; ties to five digits go to the smaller id, as there.
    """
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), embedding).dropDuplicates(["id"])
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("qid"), embedding).dropDuplicates(["qid"])
    # Of what is equal to five digits more may lie within the sixth, so some more than k are taken.
    met = search.dense_search(rows, asked, 4 * k + 1, embedding=embedding).where("id <> qid")
    order = Window.partitionBy("qid").orderBy(F.round("score", 5).desc(), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("qid").alias("id"), F.col("id").alias("other"), F.col("score").alias("similarity"), "rank")


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the neighbours in ``true`` that ``found`` has too; one as similar as the last true one counts."""
    last = true.groupBy("id").agg(F.min("similarity").alias("last"), F.count("*").alias("n"))
    hits = found.join(last, "id").groupBy("id", "n").agg(F.count_if(F.round("similarity", 5) >= F.round("last", 5)).alias("hit"))
    got = hits.agg(F.sum(F.least("hit", "n"))).first()[0] or 0
    return got / max(1, true.count())


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("id", "other").agg(F.max("s").alias("s"))
    # Products of one pair may differ in the last bits from block to block; equal vectors tie by id.
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("s", 5).desc(), "other"))
    return best.withColumn("rank", rank).where(f"rank <= {k}")


def _expanded(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """id, other, similarity, rank of all members, from the lists of their classes."""
    # One more than ``k``, since a member is no neighbour of its own.
    small = members.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("member"))).where(f"n <= {k + 1}").drop("n")
    own = small.select("id", F.col("member").alias("other"), F.lit(1.0).alias("s"))
    across = near.select(F.col("id").alias("class"), F.col("other").alias("id"), F.col("s").cast("double").alias("s")).join(small, "id").select(F.col("class").alias("id"), F.col("member").alias("other"), "s")
    order = Window.partitionBy("id").orderBy(F.round("s", 5).desc(), "other")
    best = own.unionByName(across).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k + 1}")
    lists = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "s"))).alias("list"))
    rows = members.join(lists, "id").select("member", F.posexplode(F.expr(f"slice(filter(list, x -> x.other <> member), 1, {k})")).alias("at", "x"))
    return rows.select(F.col("member").alias("id"), F.col("x.other").alias("other"), F.col("x.s").alias("similarity"), (F.col("at") + 1).alias("rank"))


#: Members of one block of a vector's surroundings.
AROUND = 64


def _exchange(near: DataFrame, unit: DataFrame, k: int, least: float, parts: int) -> DataFrame:
    """id, other, s of pairs with a common neighbour that one of them lacks."""
    full = F.count("*") >= k
    last = near.groupBy("id").agg(F.when(full, F.min("s")).otherwise(F.lit(least)).cast("float").alias("last"), F.when(full, F.max_by("other", "rank")).alias("end"))
    known = unit.join(last, "id", "left").select("id", "v", F.coalesce("last", F.lit(least).cast("float")).alias("last"), F.coalesce("end", F.lit(-(2**63))).alias("end"))
    hub = near.select(F.col("id").alias("hub"), F.col("other").alias("id")).unionByName(near.select(F.col("other").alias("hub"), "id")).distinct()
    size = hub.groupBy("hub").agg(F.ceil(F.count("*") / AROUND).cast("int").alias("blocks"))
    placed = hub.join(size, "hub").select("hub", "id", F.expr("pmod(xxhash64(id), blocks)").cast("int").alias("block"))
    rows = placed.join(known, "id").select("hub", "block", "id", "last", "end", "v").repartition(parts, "hub", "block").sortWithinPartitions("hub", "block")

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)] + [np.array(batch.column(5).to_pylist(), dtype=object)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            change = np.flatnonzero((part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1])) + 1
            stop = int(change[-1]) if len(change) else 0
            held = [c[stop:] for c in part]
            yield from meet([c[:stop] for c in part], change[:-1] if len(change) else change)
        if held is not None:
            yield from meet(held, np.zeros(0, np.int64))

    def meet(part, change):
        if not len(part[0]):
            return
        ids, last, end, raw = part[2:]
        out_a, out_b, out_s = [], [], []
        for a, b in zip([0, *change], [*change, len(ids)]):
            if b - a < 2 or len({len(r) for r in raw[a:b]}) > 1:
                continue
            x = np.frombuffer(b"".join(raw[a:b]), np.float32).reshape(b - a, -1)
            s = x @ x.T
            np.fill_diagonal(s, -3)
            i, j = np.nonzero(s > np.maximum(last[a:b, None] - 2e-5, least - 1e-6))
            # Better than the last entry, or equal to it to five digits and of a smaller id.
            new, old = np.round(s[i, j].astype(np.float64), 5), np.round(last[a + i].astype(np.float64), 5)
            better = (new > old) | (new == old) & (ids[a + j] < end[a + i]) | (end[a + i] == -(2**63))
            i, j = i[better], j[better]
            if len(i):
                out_a.append(ids[a + i])
                out_b.append(ids[a + j])
                out_s.append(s[i, j])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b, out_s)], names=["id", "other", "s"])

    return rows.mapInArrow(run, "id long, other long, s float")
