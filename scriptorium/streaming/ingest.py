"""Incremental ingest as a stream. An extension: batch indexing replaces an index, this one adds to it.

Page records that appear in a folder are chunked and appended with their postings; a checkpoint folder makes
each file count once, and ids make repeated rows harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.model import PAGE
from scriptorium.operators import chunking, index


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Page records of the JSON files that appear in ``folder``."""
    open_ = T.StructType([T.StructField(f.name, f.dataType, True) for f in PAGE])
    rows = spark.readStream.schema(open_).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return rows.withColumns({"book": F.coalesce("book", F.lit("")), "content_type": F.coalesce("content_type", F.lit("text/html"))})


def ingest(pages: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Starts the query; with ``once`` it ends when everything that is there has been read."""

    def add(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure replaces what it wrote.
        chunks = chunking.chunk_pages(batch).dropDuplicates(["id"])
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        kept = batch.sparkSession.read.parquet(f"{path}/chunks/batch={number}")
        index.postings(kept).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        index.doc_len(kept).write.mode("overwrite").parquet(f"{path}/doc_len/batch={number}")

    out = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 minute")).start()


def outcome_windows(log: DataFrame, late: str = "3 days", width: str = "1 day") -> DataFrame:
    """Fetches per day and status of a stream of the crawl log, with late rows within the watermark."""
    return log.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", width), "status").agg(F.count("*").alias("n"))
