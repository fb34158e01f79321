"""Mixes of sources with target shares of the total size in tokens (problem 9).

Every source's documents, in a pseudorandom order, are one stream of tokens, packed into blocks of ``BLOCK``
tokens (the last one shorter). A mix is made of output shards; each draws how many of its slots go to which
source from a multinomial of the target shares, by a generator seeded with mix and shard. The k-th slot of a
source takes the block that a pseudorandom permutation (a Feistel network, one per mix, source and round
through the source) puts in place k, and blocks are joined by source and index. A source is gone through
``max_repeats`` times at most, so no document is taken more often: slots that the shards together draw beyond
that go to the other sources with a share, in proportion to it, as far as those have room. A slot is left out only
when no source has room, so the mix has the planned number of slots wherever its sources hold as many.

Where a source, repeated as often as it may be, is too small for its share of the wanted size, one of the two
has to give. With ``keep="size"`` (the default) the source is used up and the others make up for it in
proportion to their shares, as far as their own caps allow; with ``keep="shares"`` the whole mix is made smaller
until the shares hold. The shares reached are reported either way.

Results in special cases: null and empty texts have no token and are in no block; a document without a source
and a source that a mix doesn't name are left out; a target without documents has a share of 0, or with
``keep="shares"`` makes the mix empty; equal texts are different documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut

from . import tokens

BLOCK, SLOTS, SEED = 512, 1024, 20250
#: Documents (or shards) of one bucket of a running total, about.
BUCKET = 2000


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each in the order of a hash of ``order``.

    In two levels: rows fall into ranges of the hash, totals of the ranges are summed, then the rows of each
    range. No task gets more than a range, whatever the size of a key's group.
    """
    ranges = max(16, df.count() // BUCKET)
    rows = df.withColumn("_hash", F.xxhash64(*order)).withColumn("_range", F.expr(f"shiftright(shiftrightunsigned(_hash, 32) * {ranges}, 32)"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, "_range").orderBy("_hash", *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(base, [*keys, "_range"]).withColumn(out, (F.col("_base") + F.col("_own")).cast("long")).drop("_hash", "_range", "_base", "_own")


def encoded(documents: DataFrame, folder: str = tokens.VOCABULARIES, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, source, n, raw: each document's tokens as little-endian 32-bit numbers, written once."""
    ids = tokens.encode_column(documents.select("doc_id", "source", "text").where("source IS NOT NULL"), folder=folder, name=name)

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            raw = [flat[a:b].astype("<i4").tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(raw, pa.binary())], names=["doc_id", "source", "n", "raw"])

    return cut(ids.mapInArrow(run, "doc_id long, source string, n long, raw binary").where("n > 0"))


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """source, block, n, raw: the packed blocks of every source."""
    at = running_total(docs.select("doc_id", "source", "n"), ["source"], ["doc_id"], "n", "start")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for source, start, raw in zip(*(batch.column(c).to_pylist() for c in ("source", "start", "raw"))):
                n, i = len(raw) // 4, 0
                while i < n:
                    block, place = divmod(start + i, size)
                    take = min(size - place, n - i)
                    for column, x in zip(out, (source, block, place, raw[4 * i : 4 * (i + take)])):
                        column.append(x)
                    i += take
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["source", "block", "place", "piece"])

    pieces = at.join(docs.select("doc_id", "raw"), "doc_id").select("source", "start", "raw").mapInArrow(run, "source string, block long, place int, piece binary")
    joined = pieces.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("p"))
    # The pieces of a block have at most ``size`` tokens together.
    raw = F.expr("aggregate(transform(p, x -> x.piece), cast('' as binary), (a, x) -> concat(a, x))")
    return joined.select("source", "block", raw.alias("raw")).withColumn("n", (F.length("raw") / 4).cast("int"))


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of index k (below n) by the permutation of [0, n) that ``key`` names; all arrays of one length."""
    bits = np.maximum(1, -(-np.ceil(np.log2(np.maximum(2, n))).astype(np.int64) // 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, open_ = k.astype(np.uint64), np.ones(len(k), bool)
    with np.errstate(over="ignore"):
        while open_.any():  # walk the cycle until the value is below n
            left, right = out[open_] >> bits[open_], out[open_] & mask[open_]
            for r in range(4):
                h = (right + key[open_]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r * 0x632BE59BD9B4E019 & (2**64 - 1))
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask[open_])
            out[open_] = left << bits[open_] | right
            open_ &= out >= n.astype(np.uint64)
    return out.astype(np.int64)


def plan(docs: DataFrame, targets: DataFrame, size: int = BLOCK, keep: str = "size") -> list[dict]:
    """Per mix and source: share, blocks, cap in slots, slots of the whole mix. Bounded by the targets' rows."""
    totals = docs.groupBy("source").agg(F.sum("n").alias("tokens"))
    own = targets.select("mix", "source", "target_share", "max_repeats", "size_factor").distinct()
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    rows = [r.asDict() for r in own.join(totals, "source", "left").orderBy("mix", "source").collect()]  # a row per target
    out = []
    for mix in dict.fromkeys(r["mix"] for r in rows):
        of = [r for r in rows if r["mix"] == mix]
        wanted = max(r["size_factor"] for r in of) * everything
        total = sum(r["target_share"] for r in of) or 1.0
        reach = wanted
        for r in of:
            r["tokens"] = r["tokens"] or 0
            r["share"] = r["target_share"] / total
            r["most"] = r["tokens"] * r["max_repeats"]
            if keep == "shares" and r["share"] > 0:
                reach = min(reach, r["most"] / r["share"])
        if keep == "size":
            reach = min(wanted, sum(r["most"] for r in of if r["share"] > 0))
            # Sources that can't give their part are used up; the rest of the size goes to the others.
            free, left = [r for r in of if r["share"] > 0], reach
            while free:
                part = sum(r["share"] for r in free)
                short = [r for r in free if r["most"] < left * r["share"] / part]
                if not short:
                    for r in free:
                        r["share"] = left * r["share"] / part / max(1, reach)
                    break
                for r in short:
                    r["share"], left = r["most"] / max(1, reach), left - r["most"]
                free = [r for r in free if r not in short]
            sum_ = sum(r["share"] for r in of) or 1.0
            for r in of:
                r["share"] /= sum_
        for r in of:
            r |= {"blocks": -(-r["tokens"] // size), "slots": int(reach // size), "wanted": int(wanted)}
            r["cap"] = r["blocks"] * r["max_repeats"]
        out += of
    return out


def handed_on(of: list[dict], drawn: list[int]) -> list[int]:
    """Slots that each source of a mix takes over from those that drew more than their cap."""
    left = sum(max(0, n - r["cap"]) for r, n in zip(of, drawn))
    room = [max(0, r["cap"] - n) if r["share"] > 0 else 0 for r, n in zip(of, drawn)]
    out = [0] * len(of)
    while left and sum(room):
        part, now = sum(r["share"] for r, m in zip(of, room) if m), left
        for i, r in enumerate(of):
            take = min(room[i], left, max(1, int(now * r["share"] / part)))
            out[i], room[i], left = out[i] + take, room[i] - take, left - take
    return out


def slots(spark, planned: list[dict], per_shard: int = SLOTS, seed: int = SEED) -> DataFrame:
    """mix, shard, slot, source, block, round: which block lies where."""
    mixes = {}
    for r in planned:
        mixes.setdefault(r["mix"], []).append(r)
    names = list(mixes)
    shards = None
    for i, m in enumerate(names):
        n = mixes[m][0]["slots"]
        df = spark.range(-(-n // per_shard)).select(F.lit(i).alias("m"), F.col("id").alias("shard"), F.least(F.lit(per_shard), F.lit(n) - F.col("id") * per_shard).cast("int").alias("width"))
        shards = df if shards is None else shards.unionByName(df)
    if shards is None:
        return spark.createDataFrame([], "mix string, shard long, slot int, source string, block long, round int")

    def draw(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for m, shard, width in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = np.random.default_rng([seed, m, shard]).multinomial(width, [r["share"] for r in mixes[names[m]]])
                for s, c in enumerate(counts):
                    if c:
                        for column, x in zip(out, (m, shard, s, int(c))):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())], names=["m", "shard", "s", "n"])

    drawn = cut(shards.mapInArrow(draw, "m int, shard long, s int, n long"))
    placed = running_total(drawn, ["m", "s"], ["m", "s", "shard"], "n", "first")

    # A row per target.
    drawn_ = {(r.m, r.s): r.n for r in drawn.groupBy("m", "s").agg(F.sum("n").alias("n")).collect()}
    totals = [[drawn_.get((m, s), 0) for s in range(len(mixes[name]))] for m, name in enumerate(names)]
    taken = [handed_on(mixes[name], totals[m]) for m, name in enumerate(names)]

    def beyond(batches):
        for batch in batches:
            m, shard, s, n, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "shard", "s", "n", "first"))
            cap = np.array([mixes[names[a]][b]["cap"] for a, b in zip(m, s)], np.int64)
            over = np.minimum(n, np.maximum(0, first + n - cap))
            yield pa.RecordBatch.from_arrays([pa.array(x[over > 0]) for x in (m, shard, s, over)], names=["m", "shard", "s", "n"])

    def again(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for m, shard, n, at in zip(*(batch.column(c).to_pylist() for c in ("m", "shard", "n", "at"))):
                begin = 0
                for s, k in enumerate(taken[m]):
                    a, b = max(at, begin), min(at + n, begin + k)
                    if a < b:
                        for column, x in zip(out, (m, shard, s, b - a, totals[m][s] + a - begin)):
                            column.append(x)
                    begin += k
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["m", "shard", "s", "n", "first"])

    placed = placed.select("m", "shard", "s", "n", "first")
    if any(map(sum, taken)):
        over = cut(placed.mapInArrow(beyond, "m int, shard long, s int, n long"))
        placed = placed.unionByName(running_total(over, ["m"], ["m", "s", "shard"], "n", "at").mapInArrow(again, "m int, shard long, s int, n long, first long"))

    def lay(batches):
        for batch in batches:
            m, shard, s, n, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "shard", "s", "n", "first"))
            if not len(m):
                continue
            row = np.repeat(np.arange(len(m)), n)
            k = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            of = [mixes[names[a]][b] for a, b in zip(m, s)]
            have, cap = np.array([r["blocks"] for r in of], np.int64)[row], np.array([r["cap"] for r in of], np.int64)[row]
            keep = k < cap
            row, k, have = row[keep], k[keep], have[keep]
            turn = k // have
            with np.errstate(over="ignore"):
                key = (m[row].astype(np.uint64) * np.uint64(1_000_003) + s[row].astype(np.uint64)) * np.uint64(1_000_033) + turn.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(seed)
            block = permuted(k % have, have, key)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in m[row]], pa.string()), pa.array(shard[row]), pa.array([of[i]["source"] for i in row], pa.string()), pa.array(block), pa.array(turn.astype(np.int32))], names=["mix", "shard", "source", "block", "round"])

    rows = placed.mapInArrow(lay, "mix string, shard long, source string, block long, round int")
    # Within a shard the sources lie in a pseudorandom order; a shard has ``per_shard`` rows at most.
    order = Window.partitionBy("mix", "shard").orderBy(F.xxhash64("mix", "shard", "source", "block", "round", F.lit(seed)), "source", "block", "round")
    return rows.withColumn("slot", F.row_number().over(order) - 1).select("mix", "shard", "slot", "source", "block", "round")


def taken(documents: DataFrame, targets: DataFrame, size: int = BLOCK, keep: str = "size", folder: str = tokens.VOCABULARIES) -> DataFrame:
    """mix, shard, slot, source, block, round: which block lies where, without its tokens."""
    return slots(documents.sparkSession, plan(encoded(documents, folder), targets, size, keep))


def mix(documents: DataFrame, targets: DataFrame, size: int = BLOCK, keep: str = "size", folder: str = tokens.VOCABULARIES) -> DataFrame:
    """mix, shard, slot, source, block, round, ids: the records of every mix."""
    docs = encoded(documents, folder)
    where = slots(documents.sparkSession, plan(docs, targets, size, keep))

    def run(batches):
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            flat = np.frombuffer(b"".join(raw), "<i4")
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
            keep = batch.select(["mix", "shard", "slot", "source", "block", "round"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*keep.schema.names, "ids"])

    full = where.join(blocks(docs, size), ["source", "block"]).select("mix", "shard", "slot", "source", "block", "round", "raw")
    return full.mapInArrow(run, "mix string, shard long, slot int, source string, block long, round int, ids array<int>")


def shares(documents: DataFrame, targets: DataFrame, size: int = BLOCK, keeps: tuple[str, ...] = ("size", "shares"), folder: str = tokens.VOCABULARIES) -> DataFrame:
    """Per way of keeping, mix and source: the share wanted and reached, tokens, and how often its documents are taken at most."""
    docs = encoded(documents, folder)
    spark, out = documents.sparkSession, None
    for keep in keeps:
        planned = plan(docs, targets, size, keep)
        info = spark.createDataFrame(
            [(r["mix"], r["source"], float(r["target_share"]), r["max_repeats"], r["blocks"], r["tokens"], r["wanted"]) for r in planned],
            "mix string, source string, target_share double, max_repeats int, blocks long, source_tokens long, wanted_tokens long",
        )
        used = slots(spark, planned).join(F.broadcast(info), ["mix", "source"])  # as many rows as the targets
        length = F.when(F.col("block") == F.col("blocks") - 1, F.col("source_tokens") - (F.col("blocks") - 1) * size).otherwise(F.lit(size))
        got = used.groupBy("mix", "source").agg(F.sum(length).alias("tokens"), F.max("round").alias("rounds"))
        rows = info.join(got, ["mix", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
        whole = Window.partitionBy("mix")
        rows = rows.select(
            F.lit(keep).alias("keep"), "mix", "source", "target_share", F.round(F.col("tokens") / F.greatest(F.lit(1), F.sum("tokens").over(whole)), 4).alias("actual_share"), "tokens", "source_tokens",
            "max_repeats", (F.coalesce("rounds", F.lit(-1)) + 1).alias("most_repeats"), F.sum("tokens").over(whole).alias("mix_tokens"), "wanted_tokens",
        )
        out = rows if out is None else out.unionByName(rows)
    return out
