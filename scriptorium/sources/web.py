"""Fetching over HTTP for a crawl; tests and offline use pass a function of their own."""

from __future__ import annotations

import urllib.error
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame

from .html import decode


def fetch(url: str, timeout: float = 30.0, agent: str = "scriptorium") -> tuple[int, str, bytes]:
    """Status, content type and body; a connection that fails raises OSError, which the crawl retries."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as got:  # noqa: S310
            return got.status, got.headers.get_content_type(), got.read()
    except urllib.error.HTTPError as e:
        return e.code, "", b""


def documents(crawled: DataFrame) -> DataFrame:
    """url, html, path of everything that a crawl got, decoded."""

    def run(batches):
        for batch in batches:
            texts = [decode(b, k) for b, k in zip(batch.column("body").to_pylist(), batch.column("content_type").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(texts, pa.string()), batch.column("path")], names=["url", "html", "path"])

    from scriptorium.operators.corpus import mirror_path

    rows = crawled.where("body IS NOT NULL").withColumn("path", mirror_path(crawled["url"]))
    return rows.select("url", "body", "content_type", "path").mapInArrow(run, "url string, html string, path string")
