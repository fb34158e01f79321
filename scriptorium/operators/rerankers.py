"""Rerankers: each gives a pool of hits (q, text, ...) a rerank_score, in one plan for all questions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import vectors as V

from .search import overlap_score

#: (questions, texts) to scores; a cross-encoder.
PairScorer = Callable[[list[str], list[str]], Iterable[float | None]]
#: (question, text) to the (token, log-probability) alternatives of a model's first token.
YesNoModel = Callable[[str, str], list[tuple[str, float]]]
Reranker = Callable[[DataFrame], DataFrame]


def overlap(hits: DataFrame) -> DataFrame:
    """Deterministic stand-in for a model, in the JVM."""
    return hits.withColumn("rerank_score", overlap_score("q", "text"))


def _with_column(hits: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, make) -> DataFrame:
    schema = T.StructType([*hits.schema.fields, T.StructField(name, kind)])

    def run(batches):
        for batch in batches:
            made = make(batch.column("q").to_pylist(), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*batch.schema.names, name])

    return hits.mapInArrow(run, schema)


def pairs(scorer: PairScorer) -> Reranker:
    """A model that scores (question, text) pairs, called once per Arrow batch."""
    make = lambda q, t: [None if v is None else float(v) for v in scorer(q, t)]
    return lambda hits: _with_column(hits, "rerank_score", T.DoubleType(), pa.float64(), make)


def yes_or_no(model: YesNoModel) -> Reranker:
    """A model asked whether the text answers the question: the probability of yes among its alternatives."""
    item = T.StructType([T.StructField("token", T.StringType()), T.StructField("logprob", T.DoubleType())])
    arrow = pa.list_(pa.struct([("token", pa.string()), ("logprob", pa.float64())]))
    make = lambda q, t: [[{"token": a, "logprob": float(b)} for a, b in model(x, y)] for x, y in zip(q, t)]

    def score(hits: DataFrame) -> DataFrame:
        rows = _with_column(hits, "_alternatives", T.ArrayType(item), arrow, make)
        return rows.withColumn("rerank_score", V.yes_chance(F.col("_alternatives"))).drop("_alternatives")

    return score


def served(model: str, names: Iterable[str]) -> bool:
    """Whether a model server that lists ``names`` has the model; a name without a tag stands for its latest."""
    return not {model, f"{model}:latest"}.isdisjoint(names)


class Registry:
    """Rerankers by name, in order of preference; each with a probe that says whether it can be used now."""

    def __init__(self, known: dict[str, tuple[Callable[[], bool], Reranker]] | None = None):
        self.known = {"overlap": (lambda: True, overlap)} if known is None else known

    def available(self) -> list[str]:
        return [name for name, (probe, _) in self.known.items() if _safe(probe)]

    def pick(self, wanted: bool | None, name: str = "auto") -> Reranker | None:
        """None for no reranking. ``wanted`` None takes whichever is there, True insists on one."""
        if wanted is False or name == "none":
            got = None
        elif name == "auto":
            got = next(iter(self.available()), None)
        else:
            if name not in self.known:
                raise ValueError(f"no reranker is called {name!r}")
            got = name
        if got is None:
            if wanted:
                raise RuntimeError("a reranker was asked for and none is available")
            return None
        return self.known[got][1]


def _safe(probe: Callable[[], bool]) -> bool:
    try:
        return bool(probe())
    except Exception:  # a probe that fails says no
        return False
