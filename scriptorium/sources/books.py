"""PDF books: page texts to page records. Reading a PDF itself sits behind an interface."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.model import LIMITS

#: (file bytes) to its page texts, its outline as (level, heading, page) and its title; a real one needs a PDF library.
PdfReader = Callable[[bytes], tuple[list[str], list[tuple[int, str, int]], str | None]]


def read_pdfs(files: DataFrame, reader: PdfReader) -> DataFrame:
    """file, n, raw, outline, meta_title of every page of ``files`` (a binaryFile scan)."""
    schema = "file string, n int, raw string, outline array<struct<level:int,heading:string,start:int>>, meta_title string"

    def run(batches: Iterable[pa.RecordBatch]):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                texts, outline, title = reader(content)
                marks = [{"level": a, "heading": b.strip(), "start": p} for a, b, p in outline if p >= 1]
                rows += [(path, n, t, marks, title) for n, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["file", "n", "raw", "outline", "meta_title"])

    def frames(batches):
        for pdf in batches:
            yield from run([pa.RecordBatch.from_pandas(pdf, preserve_index=False)])

    return files.select("path", "content").mapInPandas(frames, schema)


def file_parts(path: Column) -> Column:
    """struct(chapter, title) of a file name like '03_name-of-book.pdf'."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    rest = F.regexp_extract(stem, r"^(\d{1,2})?[_\-\s]*(.+?)$", 2)
    return F.struct(F.nullif(F.regexp_extract(stem, r"^(\d{1,2})?[_\-\s]*(.+?)$", 1), F.lit("")).cast("int").alias("chapter"), X.strip(F.regexp_replace(rest, r"[_\-]+", " ")).alias("title"))


def needs_ocr(text: Column, mode: str = "auto") -> Column:
    if mode != "auto":
        return F.lit(mode == "always")
    return (X.strip(text) == "") | (X.broken_ratio(text) > LIMITS.broken_ratio)


def chosen_text(layer: DataFrame, ocr: DataFrame, mode: str = "auto") -> DataFrame:
    """Text layer or recognised text per page: a left join on (file, n), so a page without OCR keeps its layer."""
    both = layer.join(ocr.select("file", "n", F.col("text").alias("_ocr")), ["file", "n"], "left")
    return both.withColumn("text", F.when(needs_ocr(F.col("raw"), mode) & F.col("_ocr").isNotNull(), F.col("_ocr")).otherwise(X.clean_pdf_text("raw"))).drop("_ocr")


def ocr_misses(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages that the recognition cache, keyed by file hash, resolution and page, doesn't hold."""
    return pages.join(cache, ["file_sha", "dpi", "n"], "left_anti")


def with_ocr_cached(cache_path: str, made: DataFrame) -> None:
    """Appends recognised pages (file_sha, dpi, n, text) to the cache table that ``ocr_misses`` looks in."""
    made.select("file_sha", "dpi", "n", "text").write.mode("append").partitionBy("dpi").parquet(cache_path)


def empty_pages(pages: DataFrame) -> DataFrame:
    """file, pages, empty: how many pages of each file have too little text to be records."""
    return pages.groupBy("file").agg(F.count("*").alias("pages"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) < LIMITS.min_chars).alias("empty"))


def book_title(given: Column, meta: Column, path: Column) -> Column:
    """The name that is given, else the file's own, else one from the file's name."""
    some = lambda x: F.nullif(X.strip(x), F.lit(""))
    return F.coalesce(some(given), some(meta), file_parts(path)["title"])


def by_outline(pages: DataFrame, outline: DataFrame, file_chapter: Column | None = None) -> DataFrame:
    """``pages`` (file, n) with heading, section and chapter of the last bookmark by outline order that starts at or before them.

    The chapter is the position among the bookmarks of level 1; in a file without such a bookmark it is ``file_chapter``
    (as ``file_parts`` reads it from the name, if not given). An outline belongs to one file, so the join
    is on the file and each page keeps the best of its outline's bookmarks by a partial aggregate.
    """
    order = Window.partitionBy("file").orderBy("pos")
    marks = outline.withColumn("number", F.sum((F.col("level") == 1).cast("int")).over(order)).withColumn("top", F.col("level") == 1)
    joined = pages.select("file", "n").distinct().join(marks, "file").where("start <= n")
    last = joined.groupBy("file", "n").agg(F.max_by("heading", "pos").alias("heading"), F.max(F.when(F.col("top"), F.col("number"))).alias("chapter"))
    tops = marks.groupBy("file").agg(F.max("top").alias("_tops"))
    rows = pages.join(last, ["file", "n"], "left").join(tops, "file", "left")
    named = file_parts(F.col("file"))["chapter"] if file_chapter is None else file_chapter
    rows = rows.withColumn("chapter", F.when(F.coalesce("_tops", F.lit(False)), F.col("chapter")).otherwise(named)).drop("_tops")
    return rows.withColumn("section", X.section_number("heading", anchored=True))


def carry_headings(pages: DataFrame, file_chapter: Column | None = None) -> DataFrame:
    """``pages`` (file, n, text) with the last numbered heading so far: heading, chapter, section.

    Pages below the length floor are left out first and carry nothing. The three fields go on together, since
    a whole-number heading takes the section away. Per page only its last heading is kept before the window.
    """
    long = pages.where(F.length("text") >= LIMITS.min_chars)
    h = X.headings_in("text")
    last = F.when(F.size(h) > 0, F.element_at(h, -1))
    number = last["number"]
    mark = F.when(
        last.isNotNull(),
        F.struct(last["line"].alias("heading"), F.substring_index(number, ".", 1).cast("int").alias("chapter"), F.when(number.contains("."), number).alias("section")),
    )
    # The window moves page keys and headings, not texts.
    keys = long.select("file", "n", mark.alias("mark"))
    so_far = F.last("mark", ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    marks = keys.withColumn("mark", so_far).select("file", "n", F.col("mark.heading").alias("heading"), F.coalesce(F.col("mark.chapter"), file_chapter if file_chapter is not None else F.lit(None).cast("int")).alias("chapter"), F.col("mark.section").alias("section"))
    return long.join(marks, ["file", "n"])


def reading_order(lines: DataFrame) -> DataFrame:
    """page, text of OCR lines (page, text, x0, y0, x1, y1): columns left to right, then down, with paragraphs.

    Two columns if both halves hold three lines or more and none is wider than 0.55. A paragraph starts at an
    indent of more than 0.015 over the median margin or a gap of more than 0.8 of the median height.
    """
    page = Window.partitionBy("page")
    rows = lines.withColumn("right", ((F.col("x0") + F.col("x1")) / 2 >= 0.5).cast("int"))
    two = (F.least(F.sum("right").over(page), F.sum(1 - F.col("right")).over(page)) >= 3) & (F.max(F.col("x1") - F.col("x0")).over(page) < 0.55)
    rows = rows.withColumn("col", F.when(two, F.col("right")).otherwise(0))
    stats = rows.groupBy("page", "col").agg(F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)).alias("pitch"), F.percentile("x0", F.lit(0.5)).alias("margin"))
    order = Window.partitionBy("page", "col").orderBy("y0", "x0", "text")
    rows = rows.join(stats, ["page", "col"])
    breaks = (F.col("x0") > F.col("margin") + 0.015) | (F.col("y0") - F.lag("y1").over(order) > 0.8 * F.col("pitch"))
    rows = rows.withColumn("brk", (F.coalesce(breaks, F.lit(False)) & (F.row_number().over(order) > 1)).cast("int"))
    rows = rows.withColumn("par", F.sum("brk").over(order)).withColumn("seq", F.row_number().over(order))
    pars = rows.groupBy("page", "col", "par").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("t"))
    whole = pars.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "par", "t"))), lambda x: x["t"]), "\n\n").alias("t"))
    return whole.select("page", X.rejoin_hyphens("t").alias("text"))


def flip(y0: Column, height: Column) -> Column:
    """Top edge of a box whose origin was at the bottom."""
    return 1.0 - y0 - height


def page_records(pages: DataFrame, title: Column, lang: str | None = None) -> DataFrame:
    """Page records of ``pages`` (file, n, text, heading, chapter, section) below the name ``title``.

    The language is that of the first twenty pages of a file that have any text.
    """
    sample = pages.where(F.col("n") <= 20).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("s"))
    langs = sample.select("file", (F.lit(lang) if lang else X.guess_lang("s")).alias("lang"))
    rows = pages.where(F.length("text") >= LIMITS.min_chars).withColumn("book", title).join(langs, "file", "left").withColumn("lang", F.coalesce("lang", F.lit(lang) if lang else X.guess_lang(F.lit(""))))
    none = F.array().cast("array<string>")
    return rows.select(
        F.concat(F.lit("file://"), F.col("file"), F.lit("#page="), F.col("n").cast("string")).alias("url"), F.regexp_extract("file", r"([^/]*)$", 1).alias("path"), F.lit("pdf").alias("edition_key"), "lang",
        F.lit("full").alias("edition"), "chapter", "section", F.coalesce("heading", F.concat("book", F.lit(" – p. "), F.col("n").cast("string"))).alias("title"), "text",
        none.alias("headings"), none.alias("images"), none.alias("links"), F.lit("application/pdf").alias("content_type"), F.lit(0.0).alias("fetched_at"), "book",
    )
