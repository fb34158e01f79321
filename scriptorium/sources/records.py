"""Record files: pages, chunks, questions; and the folders of corpora."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.model import CHUNK, PAGE, QUESTION


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; a line that isn't a record is an error, a blank one is skipped."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(f"{path} not found")
    open_ = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return spark.read.schema(open_).option("mode", "FAILFAST").json(path)


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records; files written before a field existed take its default."""
    pages = _json(spark, path, PAGE)
    return pages.withColumns({"book": F.coalesce("book", F.lit("")), "content_type": F.coalesce("content_type", F.lit("text/html")), "fetched_at": F.coalesce("fetched_at", F.lit(0.0))})


def save_pages(pages: DataFrame, path: str) -> None:
    """Overwrites; characters are written as they are."""
    pages.select(*PAGE.fieldNames()).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, CHUNK)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions; the sections are optional."""
    return _json(spark, path, QUESTION)


def load_env(path: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines set what isn't set yet; comments, 'export' and quotes are understood, an empty value counts as unset."""
    env = os.environ if env is None else env
    if not os.path.isfile(path):
        return {}
    done = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        line = line.strip().removeprefix("export ").strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        value = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
        if value and key not in env:
            env[key] = done[key] = value
    return done


def corpora(root: str) -> list[str]:
    """Names of the corpora with an index; the default one ('') first, the others sorted."""
    has = lambda d: (d / "index" / "meta").exists() or (d / "index" / "meta.json").exists()
    base = Path(root)
    named = sorted(d.name for d in (base / "corpora").iterdir() if has(d)) if (base / "corpora").is_dir() else []
    return [""] * has(base) + named


def corpus_row(root: str, name: str) -> dict:
    """What is known of a corpus without reading its index; {} if unreadable."""
    folder = Path(root) if not name else Path(root) / "corpora" / name
    try:
        return json.loads((folder / "index" / "meta.json").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
