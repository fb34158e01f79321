"""Queries of the training-data operators, one module entry per query; SQL is in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import table

from . import bilingual, curves, encodings, forms, languages, mixing, parity, pieces, scans, tokens
from .sql import SQL


# --- 1 wrong encodings
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return encodings.garbled_fields(pages, encodings.train(pages)).distinct()


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled values only, with the text given back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "title", "text")
    fixed = encodings.restore(pages, encodings.train(pages))
    old = pages.select("page_id", F.xxhash64("title", "text").alias("_old"))
    rows = fixed.withColumn("_new", F.xxhash64("title", "text")).join(old.distinct(), "page_id")
    return rows.where("_new <> _old").select("page_id", "title", "text").distinct()


# --- 2 scans
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return scans.noisy_lines(pages, scans.train(pages)).distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return scans.repair(pages, scans.train(pages)).distinct()


# --- 3 look-alikes
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, chunks = table(spark, sf_dir, "pages"), table(spark, sf_dir, "chunks")
    garbled = encodings.garbled_fields(pages, encodings.train(pages)).select("page_id").distinct()
    bad = pages.select("page_id", "url").join(garbled, "page_id", "left_semi")
    odd_pages = forms.odd_rows(pages.select("page_id", "text")).distinct().join(bad, "page_id", "left_anti")
    odd_chunks = forms.odd_rows(chunks.select("id", "page_url", "text")).distinct().join(bad, F.col("page_url") == F.col("url"), "left_anti")
    return odd_pages.select(F.lit("page").alias("rec"), F.col("page_id").cast("string").alias("rec_key")).unionByName(odd_chunks.select(F.lit("chunk").alias("rec"), F.col("id").alias("rec_key"))).distinct()


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and length of the text of every page and chunk in its consistent form."""
    out = None
    for rec, name, key in (("page", "pages", "page_id"), ("chunk", "chunks", "id")):
        rows = forms.unify(table(spark, sf_dir, name).select(F.col(key).cast("string").alias("rec_key"), "text"))
        rows = rows.select(F.lit(rec).alias("rec"), "rec_key", F.sha1("text").alias("sha1"), F.length("text").alias("n_chars"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


# --- 4 most similar vectors
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = curves.neighbours(table(spark, sf_dir, "chunk_vectors"), least=0.85)
    return near.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar of every usable vector."""
    return curves.neighbours(table(spark, sf_dir, "chunk_vectors"), rounds=2, lists=18).select("id", "other", F.round("similarity", 4).alias("similarity"), "rank")


# --- 5 oversized items
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for rec, name, key, text in (("page", "pages", "page_id", "text"), ("chunk", "chunks", "id", "body")):
        rows = pieces.split_long(table(spark, sf_dir, name), key, text, bodies=False).where("piece_no = 0")
        rows = rows.select(F.lit(rec).alias("rec"), F.col("key").alias("rec_key"), "boundary")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of pages and chunks with whole overlaps: as many pieces as that takes."""
    out = None
    for rec, name, key, text in (("page", "pages", "page_id", "text"), ("chunk", "chunks", "id", "body")):
        rows = pieces.split_long(table(spark, sf_dir, name), key, text, room=pieces.OVERLAP)
        rows = rows.select(F.lit(rec).alias("rec"), F.col("key").alias("rec_key"), "piece_no", "start", "own_start", "end", "piece")
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces: place in the text, what each shares with its predecessor, and the text itself."""
    return _pieces(spark, sf_dir).distinct()


def p5_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record: digest of what its pieces hold beside overlaps and white space, and whether all keep to the limit and overlap."""
    own = F.substring("piece", F.col("own_start") - F.col("start") + 1, pieces.LIMIT)
    overlap = F.lag("end").over(Window.partitionBy("rec", "rec_key").orderBy("piece_no")) - F.col("start")
    rows = _pieces(spark, sf_dir).distinct().withColumns({"own": F.regexp_replace(own, "[ \\t\\r\\n]+", ""), "overlap": F.coalesce(overlap, F.lit(0))})
    each = rows.groupBy("rec", "rec_key").agg(
        F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")).alias("digest"),
        (F.max(F.length("piece")) <= pieces.LIMIT).alias("within"), (F.max("overlap") <= pieces.OVERLAP).alias("overlaps"),
    )
    return each


# --- 6 bilingual sentences
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = bilingual.translations(pages, table(spark, sf_dir, "glossary"), encodings.train(pages))
    return out.select("page_id_a", "sent_a", "page_id_b", "sent_b").distinct()


# --- 7 near-duplicates
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = parity.similar_pairs(table(spark, sf_dir, "pages"), "page_id", "text", similarity=0.5, words=3)
    return pairs.select(F.col("key_a").alias("page_id_a"), F.col("key_b").alias("page_id_b")).distinct()


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every page record, and how many different texts its text is linked to."""
    out = parity.groups(table(spark, sf_dir, "pages"), "page_id", "text", similarity=0.5, words=3)
    return out.select(F.col("key").alias("page_id"), "group_id", "links")


# --- 8 encoding
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every text as its ids give it back."""
    return tokens.decode_column(p8_ids(spark, sf_dir)).select("doc_id", F.sha1("text").alias("digest"))


# --- 9 mixes
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source, whether no block is taken oftener than it may be, and none twice in a round; targets without blocks as well."""
    targets = table(spark, sf_dir, "mix_targets").select("mix", "source", "max_repeats").distinct()
    uses = mixing.taken(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).groupBy("mix", "source", "block").agg(F.count("*").alias("uses"), F.count_distinct("round").alias("rounds"))
    most = uses.groupBy("mix", "source").agg(F.max("uses").alias("most"), F.max(F.col("uses") - F.col("rounds")).alias("twice"))
    rows = targets.join(most, ["mix", "source"], "left")
    return rows.select("mix", "source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within"), F.coalesce("twice", F.lit(0)).alias("twice"))


# --- 10 languages
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = languages.label_segments(documents, languages.train(documents, table(spark, sf_dir, "lang_samples")))
    cases = rows.where("n_segments > 1 OR label <> lang")
    return cases.select(F.col("key").alias("doc_id"), "seg_no", "lang")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document, with a confidence."""
    documents = table(spark, sf_dir, "documents")
    rows = languages.label_segments(documents, languages.train(documents, table(spark, sf_dir, "lang_samples")))
    return rows.select(F.col("key").alias("doc_id"), "seg_no", "start", "end", "lang", F.round("confidence", 3).alias("confidence"))


__all__ = ["QUERIES", "SQL"]

QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_repaired, p3_found, p3_unified, p4_found, p4_neighbours, p5_found, p5_pieces, p5_covered, p6_found, p7_found, p7_groups, p8_ids, p8_decoded, p9_mix, p9_shares, p9_kept, p10_found, p10_segments)}

