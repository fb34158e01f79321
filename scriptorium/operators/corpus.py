"""Statistics, link graph, crawl outcomes, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import urls as U
from scriptorium.session import cut


def page_stats(pages: DataFrame, length: Column | None = None) -> DataFrame:
    """Pages and characters per language and edition; ``length`` if it is known already."""
    return pages.groupBy("lang", "edition").agg(F.count("*").alias("pages"), F.sum(F.length("text") if length is None else length).alias("chars"))


def chapter_counts(pages: DataFrame, lang: str = "cs", edition: str = "full") -> DataFrame:
    return pages.where((F.col("lang") == lang) & (F.col("edition") == edition)).groupBy("chapter").agg(F.count("*").alias("pages")).orderBy(F.col("chapter").asc_nulls_last())


def books(pages: DataFrame) -> DataFrame:
    return pages.where("book <> ''").select("book").distinct().orderBy("book")


def outcomes(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"))


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by``, n, median: exact medians of ``value``, as a benchmark reports its timings."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.median(value).alias("median"))


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key in an order that has no ties but repeated rows.

    A partial aggregate of the least row, so a hot key is reduced in every task before anything moves.
    """
    rest = [c for c in rows.columns if c not in order and c != key]
    least = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return least.select(key, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]]).select(*rows.columns)


def edges(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.explode("links").alias("to")).where("to <> url").distinct()


def breadth_first(links: DataFrame, seeds: DataFrame, most: int = 64) -> DataFrame:
    """url, depth: distance of everything that ``seeds`` (url) reach; each level is written before the next."""
    seen = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    links = cut(links.select("url", "to"))
    for depth in range(1, most + 1):
        new = frontier.join(links, "url").select(F.col("to").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def crawl(seeds: list[str], fetch, spark, scope: str = U.SCOPE, limit: int | None = None, attempts: int = 4, wait: float = 1.0, mirror: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """url, status, content_type, body, depth, place of a scoped breadth-first crawl.

    ``fetch`` (url) -> (status, content_type, bytes) does the network; a level of the frontier is fetched by
    all tasks, with retries after ``wait``, twice that and so on. What ``mirror`` (url, body) holds is not
    fetched ("cached"). Links are followed where they are in scope and look like text; the seeds are taken as
    they are. ``place`` numbers URLs as they are seen: level by level, within one by the place of the page
    that names them first and their place on it. ``limit`` counts every URL that was seen, in that order.
    """
    import pyarrow as pa

    from scriptorium.sources.html import decode, normalise

    def run(batches):
        import re
        import time

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for url, place, kept in zip(*(batch.column(i).to_pylist() for i in range(3))):
                status, kind, body = "skipped_non_text", None, None
                if kept is not None:
                    status, kind, body = "cached", "text/html", kept
                elif re.search(r"(?i)(\.html?|\.txt|/)$", url):
                    for turn in range(attempts):
                        try:
                            code, kind, body = fetch(url)
                            status = "fetched" if code == 200 else f"http_{code}"
                            body = body if code == 200 else None
                            break
                        except OSError:
                            status = "error"
                            if turn + 1 < attempts:
                                time.sleep(wait * 2**turn)
                found = re.findall(U.LINK, decode(body, kind)) if body else []
                links = list(dict.fromkeys(x for raw in found if (x := normalise(url, raw, scope))))
                for column, x in zip(out, (url, place, status, kind, body, links)):
                    column.append(x)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["url", "place", "status", "content_type", "body", "links"])

    schema = "url string, place long, status string, content_type string, body binary, links array<string>"
    first = list(dict.fromkeys(seeds))[:limit]
    seen = cut(spark.createDataFrame([(s, i) for i, s in enumerate(first)], "url string, place long"))
    frontier, out, depth, count = seen, None, 0, len(first)
    while not frontier.isEmpty() and (most is None or depth < most):
        own = frontier.join(mirror.select("url", "body"), "url", "left") if mirror is not None else frontier.withColumn("body", F.lit(None).cast("binary"))
        # Fetching waits on the network: several tasks to a core, by the size of the cluster.
        tasks = 4 * spark.sparkContext.defaultParallelism
        got = cut(own.select("url", "place", "body").repartition(tasks).mapInArrow(run, schema).withColumn("depth", F.lit(depth)))
        out = got if out is None else out.unionByName(got)
        named = got.select("place", F.posexplode("links").alias("nth", "url")).groupBy("url").agg(F.min(F.struct("place", "nth")).alias("at"))
        new = _numbered(named.join(seen, "url", "left_anti"), count)
        frontier = cut(new.where(F.col("place") < limit) if limit else new)
        count += frontier.count()
        seen = cut(seen.unionByName(frontier))
        depth += 1
    return out.drop("links") if out is not None else spark.createDataFrame([], "url string, place long, status string, content_type string, body binary, depth int")


def _numbered(rows: DataFrame, begin: int) -> DataFrame:
    """url, place: ``rows`` (url, at) in the order of ``at``, numbered from ``begin`` over ranges, not in one task."""
    ranged = cut(rows.repartitionByRange("at").sortWithinPartitions("at").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row per range
    own = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    return ranged.withColumn("own", own).join(F.broadcast(base), "part").select("url", (F.col("base") + F.col("own") + (begin - 1)).cast("long").alias("place"))


def mirror_path(url: Column, folder: str = r"^https?://[^/]*/") -> Column:
    """Where a mirror keeps a URL: its path below ``folder``, a directory's page as index.html."""
    path = F.regexp_replace(F.substring_index(F.substring_index(url, "#", 1), "?", 1), folder, "")
    return F.when(path.endswith("/") | (path == ""), F.concat(path, F.lit("index.html"))).otherwise(path)


def write_mirror(crawled: DataFrame, path: str) -> None:
    """Appends what a crawl fetched to the mirror table (url, path, body), which ``crawl`` reads first the next time."""
    rows = crawled.where("status = 'fetched'").select("url", mirror_path(F.col("url")).alias("path"), "body")
    rows.write.mode("append").parquet(path)


def hit_rates(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """One row of hit@1, hit@k by chapter and hit@1, hit@3 by section.

    ``ranked``: qid, rank, chapter, section; ``expected``: qid, chapter, sections (may be null: not scored by
    section). A question without hits is a miss.
    """
    want = expected.select("qid", F.col("chapter").alias("want"), "sections")
    rows = want.join(ranked.where(F.col("rank") < k), "qid", "left")
    ok = F.coalesce(F.col("chapter") == F.col("want"), F.lit(False))
    sec = F.coalesce(F.array_contains("sections", F.coalesce("section", F.lit("-"))), F.lit(False))
    each = rows.groupBy("qid").agg(
        F.max((ok & (F.col("rank") == 0)).cast("int")).alias("c1"), F.max(ok.cast("int")).alias("ck"), F.max((sec & (F.col("rank") == 0)).cast("int")).alias("s1"),
        F.max((sec & (F.col("rank") < 3)).cast("int")).alias("s3"), F.max(F.col("sections").isNotNull().cast("int")).alias("has"),
    )
    return each.agg(
        F.count("*").alias("total"), F.coalesce(F.sum("c1"), F.lit(0)).alias("chapter_1"), F.coalesce(F.sum("ck"), F.lit(0)).alias("chapter_k"), F.coalesce(F.sum("has"), F.lit(0)).alias("sec_total"),
        F.coalesce(F.sum("s1"), F.lit(0)).alias("sec_1"), F.coalesce(F.sum("s3"), F.lit(0)).alias("sec_3"),
    )


def summary(row, k: int) -> list[str]:
    """Lines that report a row of ``hit_rates``."""
    # The wording of the report.
    share = lambda n, of: f"{n}/{of} ({n / of:.0%})" if of else f"{n}/0"
    lines = [f"chapter: hit@1 = {share(row['chapter_1'], row['total'])}   hit@{k} = {share(row['chapter_k'], row['total'])}"]
    if row["sec_total"]:
        lines.append(f"section: hit@1 = {share(row['sec_1'], row['sec_total'])}   hit@3 = {share(row['sec_3'], row['sec_total'])}")
    return lines
