"""BM25 of very many questions at once, exact and without a row for every question and document that share a term.

Documents are packed into blocks of postings and the distinct questions into blocks of term lists; every block of
questions meets every block of documents in one plan, and of each meeting the best of a question remain. Disk holds the
postings of the questions' terms and the best rows, whatever the number of meetings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as X
from scriptorium.model import LIMITS, Limits
from scriptorium.operators.search import T_arrow, best
from scriptorium.session import cut, spread

#: Documents of a block at most and those that a partition is made for; questions of a block at most.
BLOCK, FILL, QUESTIONS = 65_536, 50_000, 16_384
#: Blocks of documents that a task goes through with the same questions.
ROUND = 2
#: A term of so large a part of a block has its values there as a full row.
FULL = 1 / 16
#: Groups of documents whose largest scores bound the k-th best from below.
GROUPS = 1024


def _binary(lengths: np.ndarray, flat: np.ndarray) -> pa.Array:
    """A row of bytes for each of ``lengths``, cut from ``flat``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Number of items in each row of bytes, and all items."""
    rows = column.cast(pa.large_binary()).combine_chunks()
    rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows
    return pc.binary_length(rows).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize, np.frombuffer(b"".join(rows.to_pylist()), kind)


def _counted(docs: DataFrame, words: pa.Array, key: str, text: str) -> DataFrame:
    """key, dl, t, n: length of every document, the places of its terms among ``words`` and how often it has them."""

    def run(batches):
        for batch in batches:
            lists, size = batch.column(1), max(1, len(words))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), lengths)
            long = pc.greater(pc.utf8_length(flat), X.STEM)
            row_long = row[long.to_numpy(zero_copy_only=False)]
            code = lambda x: pc.fill_null(pc.index_in(x, value_set=words), -1).to_numpy(zero_copy_only=False)
            codes = np.concatenate([code(flat), code(pc.utf8_slice_codeunits(flat.filter(long), 0, X.STEM))]).astype(np.int64)
            rows = np.concatenate([row, row_long])
            own, times = np.unique((rows * size + codes)[codes >= 0], return_counts=True)
            each = np.bincount(own // size, minlength=batch.num_rows)
            dl = lengths + np.bincount(row_long, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int64()), _binary(each, (own % size).astype(np.int32)), _binary(each, times.astype(np.int32))], names=[key, "dl", "t", "n"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).select(key, X.words(text).alias("w")).mapInArrow(run, f"{key} {kind}, dl long, t binary, n binary")


def _document_blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    """ids, dl, terms, begin, at, tf, kind: ``rows`` in blocks in the order of their ids, with a list of places and counts for every term."""
    kind = rows.schema[key].dataType

    def packed(table: pa.Table) -> pa.RecordBatch:
        table = table.take(pc.sort_indices(table.column(0)))
        lengths, terms = _joined(table.column(2), np.int32)
        _, times = _joined(table.column(3), np.int32)
        order = np.argsort(terms, kind="stable")
        own, begin = np.unique(terms[order], return_index=True)
        at, tf = np.repeat(np.arange(table.num_rows, dtype=np.uint32), lengths)[order], times[order]
        tf = tf.astype(np.min_scalar_type(int(tf.max()) if len(tf) else 0))
        ids = table.column(0).combine_chunks()
        values = [ids.to_pylist()], [table.column(1).to_numpy().astype(np.float64).tobytes()], [own.tobytes()], [np.append(begin, len(at)).astype(np.int64).tobytes()], [at.tobytes()], [tf.tobytes()], [tf.dtype.str]
        kinds = pa.list_(T_arrow(kind)), *[pa.binary()] * 5, pa.string()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=["ids", "dl", "terms", "begin", "at", "tf", "kind"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, block))
                held = table.slice(block).to_batches()
                n -= block
        if n:
            yield packed(pa.Table.from_batches(held))

    names = T.StructType([T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("dl", "terms", "begin", "at", "tf")), T.StructField("kind", T.StringType())])
    return rows.mapInArrow(run, names)


def _statistics(blocks: DataFrame) -> dict[int, int]:
    """Documents with each term; at -1 the number of documents, at -2 the sum of their lengths."""

    def run(batches):
        for batch in batches:
            for dl, terms, begin in zip(*(batch.column(i).to_pylist() for i in range(3))):
                dl = np.frombuffer(dl)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(np.frombuffer(terms, np.int32), [-1, -2]).astype(np.int32)), pa.array(np.append(np.diff(np.frombuffer(begin, np.int64)), [len(dl), int(dl.sum())]).astype(np.int64))], names=["t", "n"])

    return dict(blocks.select("dl", "terms", "begin").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n")).collect())


def _question_blocks(kept: DataFrame, words: pa.Array, rank: np.ndarray, parts: int, most: int) -> DataFrame:
    """nos, size, ranks, times: the questions (no, bag) in blocks; those that begin with the same frequent terms lie together."""

    def ranked(batches):
        for batch in batches:
            lists = pc.split_pattern(batch.column(1), " ")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            own, times = np.unique(row * len(words) + rank[pc.index_in(lists.flatten(), value_set=words).to_numpy(zero_copy_only=False)], return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own // len(words), minlength=batch.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (own % len(words), times))], names=["no", "ranks", "times"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                yield pa.RecordBatch.from_arrays([pa.array([x.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for x in (part.column(0), pc.list_value_length(part.column(1)), part.column(1).flatten(), part.column(2).flatten())], names=["nos", "size", "ranks", "times"])

    rows = kept.select("no", "bag").mapInArrow(ranked, "no long, ranks array<int>, times array<int>")
    return rows.repartitionByRange(parts, "ranks").sortWithinPartitions("ranks").mapInArrow(run, "nos binary, size binary, ranks binary, times binary")


class _Held:
    """A block of documents, made ready for the questions of a block."""

    def __init__(self, dl, terms, begin, at, tf, rank: np.ndarray, idf: np.ndarray, used: np.ndarray, avgdl: float, limits: Limits):
        self.size, self.begin, self.at, self.tf = len(dl), begin, at, tf
        self.damp = limits.k1 * (1 - limits.b + limits.b * dl / avgdl)
        ranks, counts = rank[terms], np.diff(begin)
        self.parts = (np.repeat(idf[ranks], counts) * tf / (tf + self.damp[at])).astype(np.float32)
        place, row = np.full(len(rank), -1), np.full(len(rank), -1)
        place[ranks] = np.arange(len(ranks))
        full = np.flatnonzero((counts >= max(1, self.size * FULL)) & used[ranks])
        width = -(-self.size // GROUPS) * GROUPS
        row[ranks[full]] = np.arange(len(full))
        self.place, self.row, self.idf = place.tolist(), row.tolist(), idf.tolist()  # read one by one
        self.values, self.counts = np.zeros((len(full), width), np.float32), np.zeros((len(full), self.size), tf.dtype)
        for j, i in enumerate(full):
            own = self.postings(i)
            self.values[j, at[own]], self.counts[j, at[own]] = self.parts[own], tf[own]
        self.most = self.values.max(axis=1).tolist() if len(full) else []

    def postings(self, i: int) -> slice:
        return slice(self.begin[i], self.begin[i + 1])

    def exact(self, docs: np.ndarray, question: list) -> np.ndarray:
        """Scores of some documents in full precision, added up in one order in all blocks, so that equal documents are equal."""
        n, damp, out = np.empty((len(question), len(docs))), self.damp[docs], np.zeros(len(docs))
        rows = [self.row[r] for r, _ in question]
        n[:] = self.counts[np.array(rows)[:, None], docs] if len(self.counts) else 0
        for j, (r, _) in enumerate(question):
            if rows[j] < 0:
                own = self.postings(self.place[r])
                where = self.at[own]
                i = np.minimum(np.searchsorted(where, docs), len(where) - 1)
                n[j] = np.where(where[i] == docs, self.tf[own][i], 0)
        n *= np.array([[t * self.idf[r]] for r, t in question]) / (n + damp)
        for part in n:
            out += part
        return out


def _met(held: _Held, questions: list, top: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of a question, places of its best documents of the block and their scores; ``top`` has its k best scores so far.

    Full rows are added up in single precision, and questions that begin alike share the sums. What might be
    among the best, by the largest rounding error, is scored again in full precision.
    """
    depth = max((len(q) for q in questions), default=0)
    sums, work, part = np.empty((depth, held.values.shape[1]), np.float32), np.empty(held.values.shape[1], np.float32), np.empty(held.values.shape[1], np.float32)
    levels: list[np.ndarray] = []
    before: list = []
    for number, question in enumerate(questions):
        own = [x for x in question if held.place[x[0]] >= 0]
        if not own:
            continue
        full, rare = [x for x in own if held.row[x[0]] >= 0], [x for x in own if held.row[x[0]] < 0]
        error = 2.4e-7 * (len(own) + 2) * sum(t * held.idf[r] for r, t in own)
        bound = float(top[number, 0]) - error
        if rare and bound > sum(t * held.most[held.row[r]] for r, t in full) + error:
            docs = np.unique(np.concatenate([held.at[held.postings(held.place[r])] for r, _ in rare]))  # no other can be among the best
        else:
            same = 0
            while same < min(len(before), len(full)) and before[same] == full[same]:
                same += 1
            del levels[same:]
            for r, t in full[same:]:
                x = held.values[held.row[r]]
                x = x if t == 1 else np.multiply(x, np.float32(t), out=part)
                levels.append(np.add(levels[-1], x, out=sums[len(levels)]) if levels else np.add(x, np.float32(0), out=sums[0]) if t != 1 else x)
            before = full
            s = levels[-1] if levels else None
            if rare:
                if s is None:
                    work.fill(0)
                else:
                    np.copyto(work, s)
                s = work
                for r, t in rare:
                    where = held.postings(held.place[r])
                    s[held.at[where]] += np.float32(t) * held.parts[where]
            largest = s.reshape(-1, GROUPS).max(axis=0)
            bound = max(bound, float(np.partition(largest, GROUPS - k)[GROUPS - k]) - error, 1e-30)
            groups = np.flatnonzero(largest >= bound)
            nth, group = np.nonzero(s.reshape(-1, GROUPS)[:, groups] >= np.float32(bound))
            docs = np.sort(nth * GROUPS + groups[group])
        if not len(docs):
            continue
        scores = held.exact(docs, own)
        order = np.argsort(-np.round(scores, 9), kind="stable")[:k]  # places are in the order of the ids
        docs, scores = docs[order], scores[order]
        if top[number, 0] > -np.inf and scores[0] < top[number, 0] - 2e-9:
            continue
        top[number] = np.sort(np.concatenate([top[number], scores]))[-k:]
        good = scores >= top[number, 0] - 2e-9
        yield number, docs[good], scores[good]


def bm25_many(docs: DataFrame, questions: DataFrame, k: int, key: str = "id", text: str = "text", limits: Limits = LIMITS, block: int = BLOCK, fill: int = FILL, most: int = QUESTIONS) -> DataFrame:
    """qid, id, score, rank: the ``k`` best of all ``docs`` for each of the ``questions`` (qid, q), as ``search`` ranks them.

    Rows of ``docs`` that are equal count once. Questions of the same terms are scored once. The questions' words
    and their counts go through the driver and to every task; questions, documents and scores do not.
    """
    if k > GROUPS:
        raise ValueError(f"k is {GROUPS} at most")
    spark = docs.sparkSession
    tokens = questions.select("qid", X.tokenize("q").alias("t")).groupBy("qid").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("t"))), " ").alias("bag"))
    bags = tokens.where("bag <> ''")
    kept = cut(bags.select("bag").distinct().withColumn("no", F.monotonically_increasing_id()), tidy=True)
    words = pa.array(sorted(r[0] for r in kept.select(F.explode(F.split("bag", " "))).distinct().collect()), pa.string())
    counted = _counted(docs, words, key, text).repartition(max(1, -(-docs.count() // fill)), key).dropDuplicates()
    blocks = cut(_document_blocks(counted, key, block), tidy=True)
    df = _statistics(blocks)
    n, total = df.pop(-1, 0), df.pop(-2, 0)
    counts = np.zeros(len(words))
    counts[list(df)] = list(df.values())
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    idf = np.log(1 + (n - counts[order] + 0.5) / (counts[order] + 0.5))
    avgdl = total / n if total else 1.0
    asked, cores = kept.count(), spark.sparkContext.defaultParallelism
    parts = max(1, min(2 * cores, math.ceil(asked / 1000)), math.ceil(asked / most))
    sought = cut(_question_blocks(kept, words, rank, parts, most), tidy=True)
    kind = docs.schema[key].dataType

    def run(batches):
        now, questions, top, used = b"", [], np.empty((0, k)), None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                if (nos := batch.column("nos")[i].as_py()) != now:
                    now, ends = nos, np.cumsum(get("size", np.int32)).tolist()
                    pairs, used = list(zip(get("ranks", np.int32).tolist(), get("times", np.int32).tolist())), np.zeros(len(rank), bool)
                    used[get("ranks", np.int32)] = True
                    questions, top = [pairs[a:b] for a, b in zip([0, *ends], ends)], np.full((len(ends), k), -np.inf)
                held = _Held(get("dl", np.float64), get("terms", np.int32), get("begin", np.int64), get("at", np.uint32), get("tf", np.dtype(batch.column("kind")[i].as_py())), rank, idf, used, avgdl, limits)
                found = list(_met(held, questions, top, k))
                if found:
                    numbers, places, scores = zip(*found)
                    own = np.repeat(np.frombuffer(nos, np.int64)[list(numbers)], [len(x) for x in places])
                    yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("ids")[i].values.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], names=["no", "id", "score"])

    schema = T.StructType([T.StructField("no", T.LongType()), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    together = blocks.coalesce(max(1, math.ceil(blocks.rdd.getNumPartitions() / ROUND)))
    met = sought.hint("shuffle_replicate_nl").crossJoin(together).mapInArrow(run, schema)
    return bags.join(kept, "bag").select("qid", "no").join(best(met, k, by=("no",)), "no").drop("no")
