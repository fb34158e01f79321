"""Record types of the engine. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
STRINGS = T.ArrayType(S, False)

PAGE = _struct(
    ("url", S, False), ("path", S, False), ("edition_key", S, False), ("lang", S, False), ("edition", S, False), ("chapter", I, True), ("section", S, True), ("title", S, False), ("text", S, False),
    ("headings", STRINGS, False), ("images", STRINGS, False), ("links", STRINGS, False), ("content_type", S, False), ("fetched_at", D, False), ("book", S, False),
)
CHUNK = _struct(
    ("id", S, False), ("page_url", S, False), ("lang", S, False), ("edition", S, False), ("chapter", I, True), ("section", S, True), ("title", S, False), ("ordinal", I, False), ("text", S, False),
    ("body", S, False), ("images", STRINGS, False),
)
#: score is the retrieval score, which reranking leaves as it is; ranks count from 0.
HIT = _struct(("chunk", CHUNK, False), ("score", D, False), ("dense_rank", I, True), ("bm25_rank", I, True), ("rerank_score", D, True))
#: book is kept for readers of the row and always null, since chunks have none.
SOURCE = _struct(("n", I, False), ("title", S, False), ("chapter", I, True), ("section", S, True), ("url", S, False), ("lang", S, False), ("book", S, True), ("rerank", D, True), ("score", D, False))
ANSWER = _struct(("question", S, False), ("answer", S, False), ("backend", S, False), ("lang", S, False), ("sources", T.ArrayType(SOURCE, False), False), ("timings", T.MapType(S, D), False), ("cached", T.BooleanType(), False))
QUESTION = _struct(("q", S, False), ("lang", S, True), ("chapter", I, True), ("sections", STRINGS, True))
LINE = _struct(("text", S, False), ("x0", D, False), ("y0", D, False), ("x1", D, False), ("y1", D, False))
BOOKMARK = _struct(("level", I, False), ("heading", S, False), ("start", I, False))
TURN = _struct(("conv_id", L, False), ("turn", I, False), ("role", S, False), ("content", S, False))
EDITION = _struct(("edition_key", S, False), ("lang", S, False), ("edition", S, False))


@dataclass(frozen=True)
class Limits:
    """Numbers that decide results."""

    chunk_chars: int = 1400
    overlap_chars: int = 200
    min_chars: int = 80
    rrf_k: int = 60
    dense_k: int = 40
    bm25_k: int = 40
    pool: int = 12
    top_k: int = 10
    tail_chars: int = 150
    source_chars: int = 1000
    history: int = 8
    broken_ratio: float = 0.005
    k1: float = 1.5
    b: float = 0.75
    #: Breadcrumb of pages without a book, by language.
    shelf: dict = field(default_factory=lambda: {"cs": "Učebnice", "en": "Textbook"}, hash=False)


LIMITS = Limits()
EDITIONS = ("full", "demo")
#: Folder of an edition, its language and its kind.
EDITION_ROWS = [("online-priprava", "cs", "full"), ("online-priprava-en", "en", "full"), ("online-priprava-demo", "cs", "demo"), ("online-priprava-en-demo", "en", "demo")]
MOST_HITS = 50


@dataclass(frozen=True)
class Query:
    """One question; equal queries give equal hits, so it serves as a cache key."""

    question: str
    top_k: int = 10
    lang: str | None = None
    edition: str = "full"
    rerank: bool | None = None

    def __post_init__(self) -> None:
        if not 1 <= len(self.question) <= 4000:
            raise ValueError("a question has 1 to 4000 characters")
        if not 1 <= self.top_k <= MOST_HITS:
            raise ValueError(f"top_k is 1 to {MOST_HITS}")

    @property
    def editions(self) -> tuple[str, ...]:
        return EDITIONS if self.edition == "all" else (self.edition,)
