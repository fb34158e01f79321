"""Prompts, source rows, citations, conversations and the event protocol of streamed answers."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import markup
from scriptorium.model import LIMITS, Limits

RULES = (
    "Use nothing but the numbered passages below the question's turn. Where they don't answer it, say that and name the chapter that may. "
    "Give the number of the passage in square brackets after each fact, and write in the question's language."
)


def system_prompt(books: Iterable[str] = (), shelf: str = "the textbook") -> str:
    names = "; ".join(books)
    return f"You help students with {names or shelf}.\n\n{RULES}"


def passage(n: Column, lang: Column, chapter: Column, section: Column, title: Column, body: Column, limits: Limits = LIMITS) -> Column:
    """'[n] (lang, chapter c, section s) title' and the body, cut to the limit (none if it is 0 or less)."""
    place = F.concat(F.coalesce(F.concat(F.lit("chapter "), chapter.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(", section "), F.nullif(section, F.lit(""))), F.lit("")))
    shown = F.substring(body, 1, limits.source_chars) if limits.source_chars > 0 else body
    return F.concat(F.lit("["), n.cast("string"), F.lit("] ("), lang, F.lit(", "), place, F.lit(") "), title, F.lit("\n"), shown)


def user_turns(hits: DataFrame, questions: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """qid, prompt: the numbered passages of each question, then the question."""
    c = F.col
    parts = hits.select("qid", "n", passage(c("n"), c("lang"), c("chapter"), c("section"), c("title"), c("body"), limits).alias("p"))
    joined = parts.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]), "\n\n---\n\n").alias("p"))
    rows = questions.select("qid", "q").join(joined, "qid", "left")
    return rows.select("qid", F.concat(F.lit("Source passages:\n\n"), F.coalesce("p", F.lit("")), F.lit("\n\n===\n\nQuestion: "), F.col("q")).alias("prompt"))


def source_rows(hits: DataFrame) -> DataFrame:
    """qid and the numbered source row of every hit."""
    rerank = F.bround("rerank_score", 3) if "rerank_score" in hits.columns else F.lit(None).cast("double")
    return hits.select("qid", "n", "title", "chapter", "section", F.col("page_url").alias("url"), "lang", F.lit(None).cast("string").alias("book"), rerank.alias("rerank"), F.bround("score", 4).alias("score"))


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, pos, n, url of every cited number of an answer; numbers without a source have no url."""
    marks = F.regexp_extract_all("answer", F.lit(r"\[(\d+(?:[,;] ?\d+)*)\]"), F.lit(1))
    rows = answers.select("qid", F.posexplode(F.flatten(F.transform(marks, lambda m: F.split(m, "[,;] ?"))))).select("qid", "pos", F.col("col").cast("int").alias("n"))
    return rows.join(sources.select("qid", "n", "url"), ["qid", "n"], "left")


def rendered(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, html: each answer (qid, answer) as HTML, with links to its ``sources`` (qid, n, url, title)."""
    listed = sources.groupBy("qid").agg(F.collect_list(F.struct("n", "url", "title")).alias("sources"))  # few to an answer
    rows = answers.select("qid", "answer").join(listed, "qid", "left")

    def run(batches):
        for batch in batches:
            made = [markup.html(t, {x["n"]: x for x in own or ()}) if t is not None else None for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["qid", "html"])

    return rows.mapInArrow(run, T.StructType([answers.schema["qid"], T.StructField("html", T.StringType())]))


def last_turns(turns: DataFrame, keep: int = LIMITS.history) -> DataFrame:
    """The last messages of every conversation (conv_id, turn, ...), which WindowGroupLimit cuts before the shuffle."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def answer_json(answers: DataFrame) -> DataFrame:
    """qid, json: the answer as a document; nulls are written."""
    timings = F.transform_values("timings", lambda _, v: F.bround(v, 2))
    doc = F.struct("question", "answer", "backend", "lang", "sources", timings.alias("timings"), "cached")
    return answers.select("qid", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def frame(event: Column, data: Column) -> Column:
    return F.format_string("event: %s\ndata: %s\n\n", event, data)


def sse(event: str, data: object) -> str:
    return f"event: {event}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"


def stream(meta: dict, sources: list[dict], tokens: Iterable[str], timings: dict[str, float] | None = None) -> Iterator[str]:
    """Frames in order: meta, sources, tokens, done; a failure ends them with an error instead.

    ``timings`` is read when the tokens have ended, so who makes the tokens may fill it.
    """
    yield sse("meta", meta)
    yield sse("sources", sources)
    try:
        for t in tokens:
            yield sse("token", {"t": t})
    except Exception as e:  # it is reported in the stream
        yield sse("error", {"error": f"{type(e).__name__}: {e}"})
        return
    yield sse("done", {"timings": {k: round(v, 2) for k, v in (timings or {}).items()}, "cached": bool(meta.get("cached"))})


def read_frames(text: str) -> list[tuple[str, str]]:
    """(event, data) of a stream of frames; comments are skipped."""
    out = []
    for block in text.split("\n\n"):
        event, data = "message", []
        for line in block.split("\n"):
            if line.startswith("event:"):
                event = line[6:].strip()
            elif line.startswith("data:"):
                data.append(line[5:].removeprefix(" "))
        if data:
            out.append((event, "\n".join(data)))
    return out


def frames(events: DataFrame) -> DataFrame:
    """``events`` (qid, seq, event, data) with the frame as text."""
    return events.withColumn("frame", frame(F.col("event"), F.col("data")))


def frame_parts(text: Column | str) -> Column:
    """Frames of a stream as (event, data) structs, in the JVM."""
    blocks = F.filter(F.split(F.col(text) if isinstance(text, str) else text, "\n\n"), lambda b: b.contains("data:"))
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"(?m)^event: ?(.*)$", 1).alias("event"), F.regexp_extract(b, r"(?m)^data: ?(.*)$", 1).alias("data")))
