"""Lexical and vector index as ordinary tables.

Layout: chunks (partitioned by language and edition), postings (term, id, tf, dl) ranged by term, doc_len (id, dl),
term_stats (term, df), corpus_stats (one row) and vectors (id, embedding). Rows are joined by id, never by position.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions import vectors as V
from scriptorium.session import spread


def token_rows(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, tokens: the token array of every document, computed once per document."""
    return spread(docs.select(F.col(key), F.col(text))).select(F.col(key), X.tokenize(text).alias("tokens"))


def term_rows(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, term: a row per token. Words and their forms are taken apart as rows, which is compiled, and not as arrays of arrays."""
    words = spread(docs.select(F.col(key), F.col(text))).select(key, F.explode(X.words(text)).alias("_word"))
    return words.select(key, F.explode(X.forms(F.col("_word"))).alias("term"))


def postings(docs: DataFrame, key: str = "id", text: str = "text", only: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """term, key, tf. ``only`` (term) restricts it to some terms before anything is counted; ``lengths`` (key, dl) adds the document's length.

    A document lies in one task, whose partial counts are complete: the shuffle moves one row per document
    and distinct term.
    """
    rows = term_rows(docs, key, text)
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    counts = rows.groupBy("term", key).agg(F.count("*").alias("tf"))
    return counts if lengths is None else counts.join(lengths, key)


def doc_len(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, dl: tokens of every document, those without one included."""
    words = spread(docs.select(F.col(key), F.col(text))).select(key, X.words(text).alias("w"))
    return words.select(key, (F.size("w") + F.size(F.filter("w", lambda w: F.length(w) > X.STEM))).cast("long").alias("dl"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


@dataclass
class Tables:
    """The lexical index of some documents."""

    postings: DataFrame
    doc_len: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame


def tables(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], key: str = "id", text: str = "text") -> Tables:
    """Postings and statistics of ``docs`` (a key once), each written by ``keep``."""
    lengths = keep(doc_len(docs, key, text))
    post = keep(postings(docs, key, text, lengths=lengths))
    return Tables(post, lengths, keep(term_stats(post)), keep(corpus_stats(lengths)))


class HashedWords:
    """Deterministic stand-in for an embedding model: a 64-place bag of words by the last bits of md5, of unit length.

    Words are what ASCII white space parts in the lower-cased text, in both forms.
    """

    name, dim = "hashed:bow64", 64

    def column(self, text: Column | str) -> Column:
        """The vector as a column expression, in the JVM."""
        words = F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"[ \t\r\n\x0b\f]+"), lambda w: w != "")
        place = F.transform(words, lambda t: F.conv(F.substring(F.md5(t), 31, 2), 16, 10).cast("int") % self.dim)
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)).cast("double"))
        return V.l2_normalise(counts)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^ \t\r\n\x0b\f]+", t.lower()):
                out[i, int(hashlib.md5(w.encode()).hexdigest()[-2:], 16) % self.dim] += 1
        return (out / (np.linalg.norm(out, axis=1, keepdims=True) + V.EPSILON)).astype(np.float32)


def embed(docs: DataFrame, embedder, key: str = "id", text: str = "text", batch: int = 16) -> DataFrame:
    """key, embedding: ``embedder`` is called with ``batch`` texts at a time; what it gives is brought to unit length again."""

    def run(batches):
        for rows in batches:
            texts, out = rows.column(1).to_pylist(), []
            for at in range(0, len(texts), batch):
                for v in np.asarray(embedder([t or "" for t in texts[at : at + batch]]), np.float64):
                    out.append((v / (np.linalg.norm(v) + V.EPSILON)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.list_(pa.float32()))], names=[key, "embedding"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, embedding array<float>")


def prompt_text(text: Column, model: str, query: bool, instruction: str = "Find passages that answer the question") -> Column:
    """Prefixes that model families expect."""
    name = model.lower()
    if "e5" in name:
        return F.concat(F.lit("query: " if query else "passage: "), text)
    if "qwen3-embedding" in name and query:
        return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text)
    return text


def build(chunks: DataFrame, embedder, path: str, books: list[str] | None = None) -> None:
    """Writes the whole index below ``path``; an index that is there is replaced."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").partitionBy("lang", "edition").parquet(f"{path}/chunks")
    kept = spark.read.parquet(f"{path}/chunks")
    doc_len(kept).write.mode("overwrite").parquet(f"{path}/doc_len")
    post = postings(kept, lengths=spark.read.parquet(f"{path}/doc_len"))
    post.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    term_stats(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/term_stats")
    corpus_stats(spark.read.parquet(f"{path}/doc_len")).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    embed(kept, embedder).write.mode("overwrite").parquet(f"{path}/vectors")
    backend, _, model = embedder.name.partition(":")
    meta = {"embed_backend": backend, "embed_model": model, "n_chunks": kept.count(), "dim": embedder.dim} | ({"books": sorted(books)} if books else {})
    if "://" not in path:
        Path(path, "meta.json").write_text(json.dumps(meta, ensure_ascii=False), encoding="utf-8")
    else:
        spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


class Index:
    """Tables of a built index."""

    def __init__(self, spark: SparkSession, path: str):
        if "://" not in path and not Path(path, "meta.json").exists():
            raise FileNotFoundError(f"no index in {path}")
        self.path = path
        for name in ("chunks", "postings", "doc_len", "term_stats", "corpus_stats", "vectors"):
            setattr(self, name, spark.read.parquet(f"{path}/{name}"))
        raw = Path(path, "meta.json").read_text(encoding="utf-8") if "://" not in path else spark.read.text(f"{path}/meta").first()[0]
        self.meta = json.loads(raw)
