"""Search for a batch of questions as one plan.

Questions are rows (qid, ...). Candidate lists have a row per question and candidate; ranks count from 0;
ties go by the score rounded to nine digits, then by id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as X
from scriptorium.functions import vectors as V
from scriptorium.model import LIMITS, Limits
from scriptorium.session import cut, spread

#: Rows of one block of a dense search; the block's matrix is what a task holds.
QUERY_BLOCK = 4096
#: Parts that the postings of one term are split into when they meet the questions, so that a word of every document is no hot key.
SALT = 16
#: Rows that a side of a join may have to be broadcast, some 10 MB of question terms.
SMALL = 100_000


def mask(rows: DataFrame, lang: str | None = None, editions: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a language and of some editions; none given means all. Prunes partitions of the index."""
    if lang:
        rows = rows.where(F.col("lang") == lang)
    return rows.where(F.col("edition").isin(list(editions))) if editions else rows


def best(rows: DataFrame, k: int, score: str = "score", key: str = "id", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k best per question with their rank.

    The filter is on the bare row number, so that every task cuts its own rows to ``k`` before the shuffle.
    """
    order = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _blocks(rows: DataFrame, size: int, key: str) -> DataFrame:
    """keys, width, m: ``rows`` (key, v) of unit length, ``size`` to a row at most; rows of unlike length lie apart."""
    kind = rows.schema[key].dataType

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            begin, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            widths = np.diff(begin)
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                for at in range(0, len(own), size):
                    part = own[at : at + size]
                    x = flat[begin[part][:, None] + np.arange(width)]
                    n = np.linalg.norm(x, axis=1, keepdims=True)
                    good = np.isfinite(n[:, 0]) & (n[:, 0] > 0)
                    if good.any():
                        x = x[good] / (n[good] + V.EPSILON)
                        keys = batch.column(0).take(pa.array(part[good]))
                        yield pa.RecordBatch.from_arrays([pa.array([keys.to_pylist()], pa.list_(keys.type)), pa.array([width], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["keys", "width", "m"])

    return rows.mapInArrow(run, T.StructType([T.StructField("keys", T.ArrayType(kind)), T.StructField("width", T.IntegerType()), T.StructField("m", T.BinaryType())]))


def _kept(s: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best of every row; what is equal to nine digits goes by the smaller ``place``."""
    if s.shape[1] <= k:
        return np.nonzero(np.isfinite(s))
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, column = np.nonzero(s >= edge[:, None] - 2e-9)
    order = np.lexsort((place[column], -np.round(s[row, column], 9), row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", embedding: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """qid, id, score (cosine), rank: exact, by matrix products of blocks.

    Vectors and ``queries`` (qid, embedding) are packed into matrices of ``block`` rows at most, and every
    block of queries meets every block of vectors in one plan: nothing passes through the driver, and a task
    holds two blocks whatever the number of rows. Of each meeting the k best per query remain, ties by id, and
    a window takes the k best of all. Null and all-zero vectors and null keys take no part, nor do vectors of another length.
    """
    usable = lambda df, c: df.select(F.col(c), F.col(embedding).cast("array<double>").alias("v")).where(F.col(c).isNotNull()).where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    kind = vectors.schema[key].dataType
    schema = T.StructType([queries.schema["qid"], T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    # AQE sizes the partitions of the queries: a few make one block and not one per task.
    asked = cut(_blocks(usable(queries, "qid").hint("rebalance"), block, "qid")).select(F.col("keys").alias("qids"), F.col("width").alias("w"), F.col("m").alias("q"))
    held = _blocks(spread(usable(vectors, key)), block, key)

    def run(batches):
        kinds = [T_arrow(f.dataType) for f in schema]
        for batch in batches:
            for qids, q, keys, m in zip(*(batch.column(i).to_pylist() for i in range(4))):
                q, x = np.frombuffer(q).reshape(len(qids), -1), np.frombuffer(m).reshape(len(keys), -1)
                place = np.empty(len(keys), np.int64)
                place[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
                s = q @ x.T
                row, column = _kept(s, place, k)
                ids = pa.array(keys, kinds[1]).take(pa.array(column))
                yield pa.RecordBatch.from_arrays([pa.array(qids, kinds[0]).take(pa.array(row)), ids, pa.array(s[row, column])], names=["qid", "id", "score"])

    met = held.crossJoin(asked).where("width = w").select("qids", "q", "keys", "m")
    return best(met.mapInArrow(run, schema), k)


def T_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def question_terms(questions: DataFrame, text: str = "q") -> DataFrame:
    """qid, term, times: a repeated word counts each time."""
    return questions.select("qid", F.explode(X.tokenize(text)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))


def small(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """``rows``, computed once, and whether they are ``most`` at most."""
    kept = cut(rows)
    return kept, kept.limit(most + 1).count() <= most


def bm25_scores(post: DataFrame, lengths: DataFrame, stats: DataFrame, terms: DataFrame, key: str = "id", limits: Limits = LIMITS, df: DataFrame | None = None, salt: int = SALT, most: int = SMALL) -> DataFrame:
    """qid, id, score of every document that shares a term with the question.

    idf and mean length are those of the whole corpus, whatever is masked later. ``df`` (term, df) is the
    index's table of document counts; without it they are counted from the postings. Postings that carry dl
    need no join with ``lengths``. The questions' terms are counted: up to ``most`` go to the postings, which
    then stay where they are; more are met by a shuffle in which a term's postings are salted.
    """
    counts = df if df is not None else post.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = F.col("n").cast("double"), F.col("avgdl")
    asked, few = small(terms, most)
    counted = F.broadcast(asked).join(counts, "term") if few else asked.join(counts, "term")
    weighed = counted.crossJoin(F.broadcast(stats))  # one row
    weighed = weighed.select("qid", "term", "avgdl", (F.col("times") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    tf = F.col("tf").cast("double")
    part = F.col("w") * tf / (tf + limits.k1 * (1 - limits.b + limits.b * F.col("dl") / avgdl))
    if few:
        met = post.join(F.broadcast(weighed), "term")  # as many rows as the terms
    else:
        weighed = weighed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        met = weighed.join(post.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salt)).cast("int")), ["term", "_salt"])
    full = met if "dl" in post.columns else met.join(lengths, key)
    return full.groupBy("qid", F.col(key).alias("id")).agg(F.sum(part).alias("score"))


def bm25_search(scores: DataFrame, n_docs: int | None, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k best; with ``allowed`` (id) the mask comes after an over-fetched list of max(4k, 50), so fewer may be left."""
    if allowed is None:
        return best(scores.where("score > 0"), k)
    fetched = best(scores, max(4 * k, 50)).where("score > 0").drop("rank")
    return best(fetched.join(allowed.select("id"), "id", "left_semi"), k)


def fuse(dense: DataFrame, lexical: DataFrame, pool: int, limits: Limits = LIMITS) -> DataFrame:
    """qid, id, dense_rank, bm25_rank, score, rank: reciprocal-rank fusion of both lists, the best ``pool``.

    Ties fall to the dense rank, then to the lexical one.
    """
    both = dense.select("qid", "id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("bm25_rank")).unionByName(lexical.select("qid", "id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("bm25_rank")))
    one = both.groupBy("qid", "id").agg(F.max("dense_rank").alias("dense_rank"), F.max("bm25_rank").alias("bm25_rank"))
    one = one.withColumn("score", V.rrf_term("dense_rank", limits.rrf_k) + V.rrf_term("bm25_rank", limits.rrf_k))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool).withColumn("rank", F.col("rank") - 1)


def rerank(hits: DataFrame, fusion: str = "rrf", limits: Limits = LIMITS) -> DataFrame:
    """``hits`` (qid, id, rank, rerank_score, ...) in a new order: final_rank.

    'rrf' fuses the reranker's order with the retrieval's; anything else is the reranker's order alone. A
    missing score counts as 0 and ties keep the retrieval order.
    """
    score = F.coalesce("rerank_score", F.lit(0.0))
    by_score = Window.partitionBy("qid").orderBy(F.round(score, 9).desc(), "rank")
    rows = hits.withColumn("rerank_rank", F.row_number().over(by_score) - 1)
    if fusion != "rrf":
        return rows.withColumn("final_rank", F.col("rerank_rank"))
    fused = V.rrf_term("rerank_rank", limits.rrf_k) + V.rrf_term("rank", limits.rrf_k)
    return rows.withColumn("final_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round(fused, 9).desc(), "rerank_rank")) - 1)


def overlap_score(question: Column | str, body: Column | str) -> Column:
    """Deterministic stand-in for a reranking model: share of the question's distinct words in the body."""
    q = F.array_distinct(X.tokenize(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, X.tokenize(body))) / F.size(q)).otherwise(F.lit(0.0))


def dedupe_neighbours(hits: DataFrame, rank: str = "final_rank", limits: Limits = LIMITS) -> DataFrame:
    """``hits`` (qid, rank, id, page_url, ordinal, body) without those whose text a kept neighbour shares.

    Greedy in rank order: a hit goes if a kept hit of its page lies one ordinal away and either body holds the
    other's tail. A question's hits are few (top_k at most), so the fold is over a short array.
    """
    item = F.struct(F.col(rank).alias("rank"), "id", "page_url", "ordinal", "body")
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("hits"))
    tail = lambda x: F.right(x["body"], F.lit(limits.tail_chars))
    near = lambda k, x: (k["page_url"] == x["page_url"]) & (F.abs(k["ordinal"] - x["ordinal"]) == 1) & (F.contains(x["body"], tail(k)) | F.contains(k["body"], tail(x)))
    empty = F.slice("hits", 1, 0)
    kept = F.aggregate("hits", empty, lambda acc, x: F.when(F.exists(acc, lambda k: near(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select("qid", F.posexplode(kept).alias("n", "hit")).select("qid", (F.col("n") + 1).alias("n"), "hit.*")


def hybrid(
    questions: DataFrame, chunks: DataFrame, post: DataFrame, lengths: DataFrame, stats: DataFrame, vectors: DataFrame, query_vectors: DataFrame, lang: str | None = None, editions: tuple[str, ...] = (),
    top_k: int = 10, scorer: Callable[[DataFrame], DataFrame] | None = None, fusion: str = "rrf", limits: Limits = LIMITS, df: DataFrame | None = None, allowed: DataFrame | None = None,
) -> DataFrame:
    """qid, n, id, ...: dense and lexical candidates, fused, optionally reranked, cut and without neighbours.

    The dense side is masked before its candidates are taken, the lexical one after. ``scorer`` gives the pool
    (qid, id, q, text, ...) a rerank_score; without it the retrieval order stays. The cut to ``top_k`` comes
    before the neighbours go, so fewer may be left. ``df`` and ``allowed`` (id) if they are known already.
    """
    masked = bool(lang or editions)
    if masked and allowed is None:
        allowed = mask(chunks, lang, editions).select("id").distinct()
    dense = dense_search(vectors.join(allowed, "id", "left_semi") if masked else vectors, query_vectors, limits.dense_k)
    scores = bm25_scores(post, lengths, stats, question_terms(questions), limits=limits, df=df)
    lexical = bm25_search(scores, None, limits.bm25_k, allowed if masked else None)
    pool = fuse(dense, lexical, max(top_k, limits.pool) if scorer else top_k, limits)
    full = pool.join(chunks.dropDuplicates(["id"]), "id")
    if scorer:
        full = rerank(scorer(full.join(questions.select("qid", "q"), "qid")), fusion, limits)
    else:
        full = full.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_rank", F.col("rank"))
    top = full.where(F.col("final_rank") < top_k)
    kept = dedupe_neighbours(top, limits=limits).select("qid", "id", "n")
    return kept.join(top, ["qid", "id"])
