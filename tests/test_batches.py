"""Very many questions at once against the search that joins postings."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import batches, index, search
from scriptorium.plans import queries
from scriptorium.session import cut

FREQUENT = ["stěna", "izolace", "a", "beton", "okno", "reinforced"]


def corpus(n=400):
    pick = random.Random(3)
    names = [f"jméno{i}x" for i in range(60)]
    texts = [" ".join(pick.choices(FREQUENT, k=pick.randrange(12)) + pick.choices(names, k=pick.randrange(3))) for _ in range(n)]
    texts[7:40] = [texts[6]] * 33  # ties beyond the ten that are kept
    asked = [" ".join(pick.choices(FREQUENT, k=pick.randrange(4)) + pick.choices(names, k=pick.randrange(3))) for _ in range(150)]
    return [(f"{i * 7919 % 10007:05d}", None if i % 50 == 49 else t) for i, t in enumerate(texts)], [*enumerate(asked), (900, None), (901, "nikde"), (902, "Okno okno a okno"), (903, texts[6]), (1, "beton")]


@pytest.mark.parametrize("sizes", [(65_536, 50_000, 16_384), (64, 90, 16)])
def test_many_questions_as_with_joined_postings(spark, sizes):
    docs, asked = corpus()
    docs, asked = spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(asked, "qid long, q string")
    t = index.tables(docs.fillna(""), cut)  # a null text counts as an empty one, as in SQL
    want = search.bm25_search(search.bm25_scores(t.postings, t.doc_len, t.corpus_stats, search.question_terms(asked), df=t.term_stats), None, 10)
    block, fill, most = sizes
    got = batches.bm25_many(docs.union(docs.limit(30)), asked, 10, block=block, fill=fill, most=most)
    rows = lambda x: sorted(x.select("qid", "rank", "id", F.round("score", 9)).collect())
    assert rows(got) == rows(want) and len(rows(want)) > 1000


def test_no_questions_no_documents(spark):
    docs, asked = spark.createDataFrame([("a", "okno")], "id string, text string"), spark.createDataFrame([(1, "okno")], "qid long, q string")
    assert batches.bm25_many(docs.limit(0), asked, 10).count() == 0 and batches.bm25_many(docs, asked.limit(0), 10).count() == 0
    assert [tuple(r) for r in batches.bm25_many(docs, asked, 10).select("qid", "id", "rank").collect()] == [(1, "a", 0)]


def chapters(spark, path, step):
    """Tables of four pages, whose numbers are multiples of ``step``, and the result that they give."""
    pages = [(step, "Stěna", 1, "1.1"), (2 * step, "Okno", 2, None), (3 * step, "Beton", 3, "3.1"), (4 * step, "Izolace", None, None)]
    chunks = [("a", "stěna stěna", 1, "1.1"), ("b", "okno", 1, "1.2"), ("c", "okno střecha dveře", 2, "2.1"), ("d", "izolace", 3, "3.1")]
    spark.createDataFrame(pages, "page_id long, title string, chapter int, section string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(chunks, "id string, text string, chapter int, section string").write.parquet(f"{path}/chunks.parquet")
    return 3, 1, 2, 2, 1, 1


def test_hit_rates_without_the_index_of_all_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "index_", None)
    want = chapters(spark, tmp_path, 100)
    assert tuple(queries.hit_at_k_chapter(spark, str(tmp_path)).first()) == want


def test_hit_rates_of_every_page(spark, tmp_path):
    want = chapters(spark, tmp_path, 1)
    assert tuple(queries.hit_at_k_chapter(spark, str(tmp_path)).first()) == want
