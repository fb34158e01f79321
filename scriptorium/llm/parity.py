"""Near-duplicate texts with small edits, by a parity-sketch join (problem 7).

A text is the set of its runs of three successive words. Texts with equal sets form a class, of which one
stands for all. For each size band that a class can meet a partner in, its shingles are XOR-ed into several
bit sketches, cut into 64-bit parts: every shingle flips one bit of one part. (Parts of fewer than LEAST_BITS
bits, in bands of small pairs of fewer than two, are not paired on: that they are equal says little.) The Hamming distance of two
sketches is never more than the symmetric difference of the sets, so a sketch of p parts has an equal part
in both texts whenever the sets differ in fewer than p shingles (the pigeonhole). Bands are made for pair
sizes (the sum of both sets), since that is what the similarity bound turns into a bound on the difference;
within a band the number of parts follows the size and enough sketches with seeds of their own are made for
``parts`` parts in all. Equal parts make candidates; a candidate stays if the Hamming distance of its whole
first sketches is within the bound of the difference, and the survivors are verified on the sets.

A part that more than ``MEMBERS`` classes share, as boilerplate makes them, doesn't pair: its members would meet all
with all. They are joined among themselves by an exact way instead, in which two sets of a similarity have a shingle
in common among the rarest ones of either (``rare_pairs``); a shingle of many texts is none of these unless there is
nothing rarer, so unlike texts with a common part don't meet. Sets of up to ``TINY`` shingles and their partners meet in this way as well.
With ``exact=True`` all classes do, and no pair is missed.

Below the pigeonhole's range a pair is met with a probability, from the parts of the bands that both texts are in.
Pairs of equal sizes share four bands, those of the worst size ratio only two, and the width of a part is chosen
for these: by the estimate in ``Bands.miss`` fewer than one pair in 10,000 is missed right at the bound of 0.5, of
any size and ratio, and far fewer above it or at nearer sizes.

Results in special cases: null and empty texts and texts of fewer than three words have an empty set and no
partner; repeated rows (equal key) count once; columns other than key and text are not read.

On disk lie one copy of the sets (48 bits a shingle), spread by class, and at any time the shuffle files of one step.
Parts are made and paired in up to ``PASSES`` passes, each over its share of every band's parts, and pairs are
verified in slices; the passes together meet just the pairs that all parts at once would.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut, drop, spread

WORD = re.compile(r"[^\W_]+")
#: Bits that a part must have to pair on; in bands of pairs of fewer shingles than 2 * SMALL one fewer.
LEAST_BITS, SMALL = 3, 40
#: Sets up to this size are joined by their rarest shingles alone: their pairs may have a single shingle in common.
TINY = 6
#: Members of a part beyond which it doesn't pair; a task makes at most half as many candidates a row.
MEMBERS = 1000
#: Passes over the parts, one for so many shingles of all sets and these at most: each leaves its share of the shuffle files.
PASSES, PASS = 5, 1_000_000
#: Slices that pairs are verified in at most; each moves half as many sets as there are classes, if these do.
SLICES = 64
#: A shingle is a number of so many bytes where it is stored.
BYTES = 6
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(texts: list[str | None], hashes: WordHash, words: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in one array, and the end of each text's part of it."""
    flat: list[int] = []
    ends = []
    for text in texts:
        if text:
            flat.extend(map(hashes.__getitem__, WORD.findall(text.lower())))
        ends.append(len(flat))
    h, ends_ = np.array(flat, np.uint64), np.array(ends, np.int64)
    if len(h) < words:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    n = len(h) - words + 1
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            key = mix(key + h[i : i + n], i)
    key &= np.uint64((1 << 8 * BYTES) - 1)
    row = np.searchsorted(ends_, np.arange(n), "right")
    inside = np.arange(n) + words <= ends_[np.minimum(row, len(ends_) - 1)]
    key, row = key[inside], row[inside]
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[keep], row[keep]
    return key, np.searchsorted(row, np.arange(len(texts)), "right")


def pack(keys: np.ndarray) -> np.ndarray:
    """The bytes of shingles, a row each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES])


def unpack(raw: bytes) -> np.ndarray:
    """Shingles of bytes as ``pack`` gives them."""
    packed = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    keys = np.zeros((len(packed), 8), np.uint8)
    keys[:, :BYTES] = packed
    return keys.view("<u8").ravel()


class Bands:
    """Which bands a set of a size meets partners in, and the shape of the sketches there."""

    def __init__(self, similarity: float, parts: int, width: float):
        self.similarity, self.parts, self.width = similarity, parts, width
        self.loss = (1 - similarity) / (1 + similarity)  # of the pair's size

    def level(self, pair: float) -> int:
        return round(2 * math.log2(pair))

    def of(self, size: int) -> range:
        # The bands of all pair sizes, and one of finer parts, for pairs whose sizes differ most.
        return range(self.level(size + max(1, math.ceil(size * self.similarity))), self.level(size + size / self.similarity) + 2)

    def shape(self, level: int) -> tuple[int, int]:
        """(parts of a sketch, number of sketches)."""
        each = max(2, round(2 ** (level / 2) * self.loss / self.width))
        return each, max(1, -(-self.parts // each))

    def share(self, level: int, at: int, passes: int):
        """(seed, first place, end): the parts of a level that belong to one of several passes."""
        each, count = self.shape(level)
        lo, hi = (each * count * i // passes for i in (at, at + 1))
        for seed in range(lo // each, -(-hi // each)):
            yield seed, max(0, lo - seed * each), min(each, hi - seed * each)

    def bits(self, level: int) -> int:
        """Bits that a part of a band must have to pair on."""
        return LEAST_BITS - 1 if level < self.level(2 * SMALL) else LEAST_BITS

    def miss(self, a: int, b: int) -> float:
        """Estimated chance that two sets of these sizes right at the bound have no part in common that pairs."""
        differ = self.loss * (a + b)
        log = 0.0
        for level in set(self.of(a)) & set(self.of(b)):
            each, count = self.shape(level)
            common = (a + b - differ) / 2 / each
            least = self.bits(level)
            enough = 1 - sum(math.exp(-common) * common**i / math.factorial(i) for i in range(least))
            log += each * count * math.log1p(-min(1 - 1e-12, (1 - 1 / each) ** differ * enough))
        return math.exp(log)


def sketch(keys: np.ndarray, row: np.ndarray, rows: int, each: int, seed: int, sums: bool = False, places: tuple[int, int] | None = None):
    """One sketch per row: ``each`` 64-bit words, in which every key has flipped one bit; with ``sums`` also the sum of each word's keys.

    ``places`` (first, end) gives these words of the sketch alone.
    """
    h = mix(keys, 100 + seed)
    part = (((h >> np.uint64(32)) * np.uint64(each)) >> np.uint64(32)).astype(np.int64)
    if places and places != (0, each):
        own = (part >= places[0]) & (part < places[1])
        h, row, part, each = h[own], row[own], part[own] - places[0], places[1] - places[0]
    at = row * each + part
    odd = np.bincount(at * 64 + (h & np.uint64(63)).astype(np.int64), minlength=rows * each * 64).astype(np.uint8) & 1
    words = np.packbits(odd).view(np.uint64).reshape(rows, each)
    if not sums:
        return words
    total = np.zeros(rows * each, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(total, at, h)
    return words, total.reshape(rows, each)


def _sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, id (digest of the set), size, hashes (null where a task has passed them on with a row before)."""
    schema = f"key {docs.schema[key].dataType.simpleString()}, id long, size int, hashes binary"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        hashes = WordHash()
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, ends = shingles(part.column(1).to_pylist(), hashes, words)
                starts = np.concatenate([[0], ends[:-1]])
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys, 7))])
                    digest = mix(total[ends] - total[starts], 8).view(np.int64)
                packed, raw = pack(keys), []
                if len(seen) > 500_000:
                    seen.clear()
                for a, b, d in zip(starts, ends, digest.tolist()):
                    raw.append(None if d in seen else packed[a:b].tobytes())
                    seen.add(d)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest), pa.array((ends - starts).astype(np.int32)), pa.array(raw, pa.binary())], names=["key", "id", "size", "hashes"])

    return spread(rows).mapInArrow(run, schema).where("size > 0")


def _part_keys(classes: DataFrame, bands: Bands, at_pass: int = 0, passes: int = 1) -> DataFrame:
    """part (hash of band, sketch, place, bits and sum), class id, size of one of the passes; parts of too few set bits are left out."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128 * passes):  # a pass has its share of the places, so it takes as many rows more
                part = batch.slice(at, 128 * passes)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                sizes = part.column(1).to_numpy(zero_copy_only=False)
                hashes = part.column(2).to_pylist()
                by_level: dict[int, list[int]] = {}
                for i, n in enumerate(sizes):
                    for level in bands.of(int(n)):
                        by_level.setdefault(level, []).append(i)
                out_k, out_i = [], []
                for level, own in by_level.items():
                    keys = unpack(b"".join([hashes[i] for i in own]))
                    row = np.repeat(np.arange(len(own)), sizes[own])
                    each = bands.shape(level)[0]
                    for seed, lo, hi in bands.share(level, at_pass, passes):
                        words, total = sketch(keys, row, len(own), each, level * 1000 + seed, sums=True, places=(lo, hi))
                        # Few bits of 64 are soon equal by chance; equal sums as well are not, unless the keys are.
                        with np.errstate(over="ignore"):
                            name = mix((words ^ total) + np.arange(lo, hi, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), level * 1000 + seed)
                        # One or two shingles alone are shared by texts that have nothing else in common.
                        r, c = np.nonzero(np.bitwise_count(words) >= bands.bits(level))
                        out_k.append(name[r, c])
                        out_i.append(np.asarray(own)[r])
                k = np.concatenate(out_k).view(np.int64) if out_k else np.zeros(0, np.int64)
                i = np.concatenate(out_i) if out_i else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(ids[i]), pa.array(sizes[i])], names=["part", "id", "size"])

    return classes.select("id", "size", "hashes").mapInArrow(run, "part long, id long, size int")


def _runs(parts: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of classes with an equal part whose sizes allow the similarity, distinct within a task; or a member of a part of too many and null."""
    # Rows of one part lie together; one sort key keeps the sort a radix sort.
    rows = parts.repartition("part").sortWithinPartitions("part")

    def pairs(part: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        n = len(part)
        step = 1
        open_ = np.arange(n - 1)
        while len(open_):
            open_ = open_[open_ + step < n]
            open_ = open_[part[open_] == part[open_ + step]]
            other = open_ + step
            ok = (np.minimum(sizes[open_], sizes[other]) >= similarity * np.maximum(sizes[open_], sizes[other]) - 1e-9) & (ids[open_] != ids[other])
            if ok.any():
                yield ids[open_[ok]], ids[other[ok]]
            step += 1

    def run(batches):
        held = None
        crowd = None  # part of too many members whose rows are passed on as they come
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush():
            a, b = (np.concatenate(x) for x in zip(*seen))
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((hi, lo))
            lo, hi = lo[order], hi[order]
            keep = np.ones(len(lo), bool)
            keep[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(lo[keep]), pa.array(hi[keep])], names=["a", "b"])

        def members(ids: np.ndarray):
            own = np.unique(ids)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            part = columns[0]
            if not len(part):
                continue
            start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            size = np.diff(np.append(start, len(part)))
            last = int(start[-1])  # the last run may go on
            many = np.repeat((size > MEMBERS) | (part[start] == crowd if crowd is not None else False), size)
            if many.any():
                yield members(columns[1][many])
            crowd = part[-1] if many[-1] else None
            done = ~many
            done[last:] = False
            held = [c[last:].copy() for c in columns] if not many[-1] else [c[:0] for c in columns]
            for a, b in pairs(*(c[done] for c in columns)):
                seen.append((a, b))
                waiting += len(a)
                if waiting > 1_000_000:
                    yield flush()
                    waiting = 0
        if held is not None and len(held[0]):
            for a, b in pairs(*held):  # MEMBERS rows at most
                seen.append((a, b))
        if seen:
            yield flush()

    return rows.mapInArrow(run, "a long, b long").distinct()


def rare_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """a, b: every pair of ``classes`` (id, size, hashes) that can reach the similarity, found by rare shingles.

    Of a set of n shingles, ordered from rare to frequent, all but the last ``ceil(similarity * n) - 1`` are its
    rarest; two sets that reach the similarity have one of these in common. Exact, whatever the sets.
    """

    def explode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = part.column(2).to_pylist()
                keys = unpack(b"".join(raw)).view(np.int64)
                row = np.repeat(np.arange(len(raw)), [len(r) // BYTES for r in raw])
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["shingle", "id", "size"])

    rows = classes.select("id", "size", "hashes").mapInArrow(explode, "shingle long, id long, size int")
    count = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")  # one alone joins nothing, and is the rarest
    order = Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "shingle")
    ranked = rows.join(count, "shingle", "left").withColumn("at", F.row_number().over(order))
    rare = cut(ranked.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).where("df IS NOT NULL").select("shingle", "id", "size"), tidy=True)
    x, y = rare.select("shingle", F.col("id").alias("a"), F.col("size").alias("m")), rare.select("shingle", F.col("id").alias("b"), F.col("size").alias("n"))
    return x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-9)).select("a", "b").distinct()


def _bits(classes: DataFrame) -> DataFrame:
    """id, size, bits: the whole sketch of every class."""

    def full(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = part.column(1).to_numpy(zero_copy_only=False)
                out = []
                for n, raw in zip(sizes, part.column(2).to_pylist()):
                    # widths are powers of two, so that a wide sketch folds onto a narrow one
                    each = 1 << max(3, math.ceil(math.log2(max(1, int(n)) / 12)))
                    h = mix(unpack(raw), 55)
                    odd = np.bincount((h & np.uint64(each * 64 - 1)).astype(np.int64), minlength=each * 64).astype(np.uint8) & 1
                    out.append(np.packbits(odd).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["id", "size", "bits"])

    return classes.select("id", "size", "hashes").mapInArrow(full, "id long, size int, bits binary")


def _hamming(pairs: DataFrame, bits: DataFrame, bands: Bands) -> DataFrame:
    """Pairs whose whole sketches differ in no more bits than the bound of the symmetric difference."""
    left = bits.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))
    right = bits.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))

    def run(batches):
        for batch in batches:
            a, b = batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()
            pair = batch.column("size_a").to_numpy(zero_copy_only=False) + batch.column("size_b").to_numpy(zero_copy_only=False)
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a, b)):
                if len(x) < len(y):
                    x, y = y, x
                v = int.from_bytes(x, "big")
                w = len(y) * 8
                if len(x) > len(y):  # fold
                    f, m = 0, (1 << w) - 1
                    while v:
                        f ^= v & m
                        v >>= w
                    v = f
                keep[i] = (v ^ int.from_bytes(y, "big")).bit_count() <= bands.loss * pair[i] + 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """a, b, similarity of the pairs that reach the bound, on the sets themselves."""
    left = classes.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("hashes").alias("y"))

    def run(batches):
        for batch in batches:
            same, total = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                u, v = unpack(x), unpack(y)
                common = len(np.intersect1d(u, v, assume_unique=True))
                same.append(common)
                total.append(len(u) + len(v) - common)
            j = np.array(same, float) / np.maximum(1, total)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j)], names=["a", "b", "similarity"])
            yield out.filter(pa.array(j >= similarity - 1e-12))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, similarity double")


def similar_classes(docs: DataFrame, key: str, text: str, similarity: float = 0.8, words: int = 5, parts: int = 128, width: float = 2.35, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members (key, id) of every class of equal sets, and pairs of classes (a, b, similarity) that reach the bound.

    ``parts`` is the number of sketch parts in a band and ``width`` the shingles by which a pair at the bound
    differs in a part on average; more parts find more of the pairs near the bound. ``exact`` takes every
    candidate from ``rare_pairs``: slower where shingles are frequent, and nothing is missed.
    """
    rows = _sets(docs, key, text, words)
    # A number of its own keeps the partitions as they are: joins by class then move the pairs alone, and not the sets.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = lambda df: df.repartition(n, "id")
    # The class id is its digest: two texts of equal sets have it in common wherever they lie. One row of each keeps the set.
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("hashes").isNull(), "key")) == 1
    sets = cut(place(rows).select("key", "id", "size", F.when(first, F.col("hashes")).alias("hashes")), tidy=True, placed=True)
    members = cut(sets.select("key", "id").distinct(), tidy=True)
    classes = sets.where("hashes IS NOT NULL").select("id", "size", "hashes")
    bits = cut(place(_bits(classes)), tidy=True, placed=True)
    bands = Bands(similarity, parts, width)
    near = []
    if exact:
        some = classes.select("id")
    else:
        total = classes.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
        passes, crowded = min(PASSES, 1 + total // PASS), []
        for at in range(passes):
            met = cut(_runs(_part_keys(classes.where(f"size > {TINY}"), bands, at, passes), similarity), tidy=True)
            crowded.append(cut(met.where("b IS NULL").select(F.col("a").alias("id")), tidy=True))
            near.append(cut(_hamming(met.where("b IS NOT NULL"), bits, bands), tidy=True))
            drop(met)
        # A set of TINY shingles has partners of up to TINY / similarity.
        if not classes.where(f"size <= {TINY}").isEmpty():
            crowded.append(classes.where(F.col("size") <= math.ceil(TINY / similarity)).select("id"))
        some = reduce(DataFrame.unionByName, crowded).distinct()
    if not some.isEmpty():
        near.append(cut(_hamming(rare_pairs(classes if exact else classes.join(some, "id", "left_semi"), similarity), bits, bands), tidy=True))
    pairs = cut(reduce(DataFrame.unionByName, near).distinct(), tidy=True) if near else docs.sparkSession.createDataFrame([], "a long, b long")
    slices = max(1, min(SLICES, -(-2 * pairs.count() // max(1, bits.count()))))
    slice_ = lambda i: pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == i)
    found = reduce(DataFrame.unionByName, [cut(_verify(slice_(i), classes, similarity), tidy=True) for i in range(slices)])
    drop(sets)
    return members, found


def similar_pairs(docs: DataFrame, key: str, text: str, similarity: float, words: int, **shape) -> DataFrame:
    """key_a, key_b (a < b): every pair of records that reaches the bound, members of one class included."""
    members, pairs = similar_classes(docs, key, text, similarity, words, **shape)
    x = members.select(F.col("id").alias("a"), F.col("key").alias("key_x"))
    y = members.select(F.col("id").alias("b"), F.col("key").alias("key_y"))
    across = pairs.join(x, "a").join(y, "b").select("key_x", "key_y")
    within = x.join(y, (F.col("a") == F.col("b")) & (F.col("key_x") < F.col("key_y"))).select("key_x", "key_y")
    return across.unionByName(within).select(F.least("key_x", "key_y").alias("key_a"), F.greatest("key_x", "key_y").alias("key_b"))


def groups(docs: DataFrame, key: str, text: str, similarity: float, words: int, **shape) -> DataFrame:
    """key, group_id, links: one row per record; a group is what links connect, its id the least class id in it.

    Labels are spread by alternating large-star and small-star steps over class pairs, each step written to
    the checkpoint folder, so nothing is gathered in one place and the number of steps is logarithmic.
    """
    members, pairs = similar_classes(docs, key, text, similarity, words, **shape)
    edges = cut(pairs.select("a", "b"))
    degree = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least.withColumn("m", F.least("m", "u")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        stars = cut(small.where("u <> v").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    label = stars.groupBy("u").agg(F.min("v").alias("group_id")).withColumnRenamed("u", "id")
    return members.join(label, "id", "left").join(degree, "id", "left").select("key", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
