"""Splitting of oversized texts at natural boundaries (problem 5).

A text over the limit is cut at the coarsest kind of boundary that leaves nothing over the limit: blank
lines, else also sentence ends, else all white space, else anywhere. The number of pieces starts at the least
that can hold the text; targets lie at equal distances, each is snapped to the strongest permitted boundary
near it, and a piece is added whenever a limit fails. From the second on, a piece starts with an overlap: the
end of its predecessor, from a word's start (from anywhere within a word that was cut), up to ``overlap``
characters. ``room`` of these (or the predecessor's last word, where that is longer) count towards the limit while
targets are placed: a number of pieces at which they don't fit fails, as long as a boundary would leave them
room. Only where none does is the overlap shorter, or none after a last word longer than ``overlap``. With
``room`` as much as ``overlap`` overlaps are whole, at the price of more pieces.

Results in special cases: null, empty and blank texts and texts within the limit give no piece; repeated rows
give their pieces once per row here, and the queries keep one. Lengths count characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import spread

LIMIT, OVERLAP = 1400, 200
KINDS = ("paragraph", "sentence", "word", "hard")
WHITE = " \t\r\n"
BLANK_LINE = re.compile(r"[ \t\r]*\n[ \t\r\n]*\n[ \t\r\n]*")
SPACE = re.compile(r"[ \t\r\n]+")


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Ends of what lies before a run of white space, starts of what lies after it, and the run's strength (0 is strongest)."""
    ends, starts, strength = [], [], []
    for m in SPACE.finditer(text):
        a, b = m.span()
        if a == 0 or b == len(text):
            continue
        run = m[0]
        blank = run.count("\n") > 1 and BLANK_LINE.search(run)
        ends.append(a)
        starts.append(b)
        strength.append(0 if blank else 1 if text[a - 1] in ".!?" else 2)
    return ends, starts, strength


def longest(first: int, last: int, ends: list[int], starts: list[int], strength: list[int], level: int) -> int:
    """Length of the longest piece when ``first``..``last`` is cut at every boundary of ``level`` or stronger."""
    most, begin = 0, first
    for e, s, k in zip(ends, starts, strength):
        if k <= level:
            if e - begin > most:
                most = e - begin
            begin = s
    return max(most, last - begin)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, room: int | None = None) -> tuple[str, list[tuple[int, int, int]]] | None:
    """Kind of boundary and the pieces (start of the overlap, start of the own part, end); None if within the limit.

    ``room`` is a quarter of the overlap if not given.
    """
    room = overlap // 4 if room is None else min(room, overlap)
    if len(text) <= limit:
        return None
    first = len(text) - len(text.lstrip(WHITE))
    last = len(text.rstrip(WHITE))
    if last <= first:
        return "paragraph", []
    ends, starts, strength = boundaries(text)
    level = next((k for k in range(3) if longest(first, last, ends, starts, strength, k) <= limit), 3)
    if level == 3:  # white space serves nowhere: words over the limit get boundaries of their own
        begin, extra = first, []
        for e, s in [*zip(ends, starts), (last, last)]:
            n = -(-(e - begin) // limit) if e - begin <= limit else -(-(e - begin) // max(1, limit - overlap))
            extra += [begin + (e - begin) * i // n for i in range(1, n)]
            begin = s
        points = sorted([*zip(ends, starts, strength), *((x, x, 3) for x in extra)])
    else:
        points = [p for p in zip(ends, starts, strength) if p[2] <= level]
    kept = [p[0] for p in points]

    def reach(own: list[tuple[int, int]], begin: int, low: int) -> int:
        """Furthest end of the own part at ``begin`` that leaves room for an overlap, if a boundary does."""
        if not own:
            return begin + limit
        before, end = own[-1]
        word = end - max(before, *(text.rfind(c, before, end) + 1 for c in WHITE))
        need = max(room, word) if word <= overlap else room if level == 3 else 0
        far = end + limit - need
        return far if far > begin and (last <= far or bisect_right(kept, far, low) > low) else begin + limit

    def place(count: int) -> list[tuple[int, int]] | None:
        """Own parts for ``count`` pieces, or None if one is over what it may reach."""
        step, begin, low, own = (last - first) / count, first, 0, []
        for i in range(1, count):
            target, slack = first + i * step, step * 0.2
            high = bisect_right(kept, reach(own, begin, low), low)
            if high <= low:
                return None
            a, b = bisect_left(kept, target - slack, low, high), bisect_right(kept, target + slack, low, high)
            near = range(a, b) if a < b else range(max(low, min(a, high) - 1), min(high, max(b, low) + 1))
            best = min(near, key=lambda j: ((points[j][2] if a < b else 0), abs(kept[j] - target)))
            own.append((begin, points[best][0]))
            begin, low = points[best][1], best + 1
        own.append((begin, last))
        return own if last <= reach(own[:-1], begin, low) else None

    # One piece more for every failure, then ever larger steps for texts of thousands of pieces; a cut at every
    # boundary is the last of them.
    count, own = -(-(last - first) // limit), None
    while own is None and count <= len(points):
        own = place(count)
        count += max(1, count // 50)
    if own is None:
        begins, stops = [first, *(p[1] for p in points)], [*kept, last]
        own = list(zip(begins, stops))
    out = []
    for i, (s, e) in enumerate(own):
        o = s
        if i:
            before = own[i - 1]
            lowest = max(before[0], e - limit, before[1] - overlap)
            if lowest < before[1]:
                o = lowest
                if o > before[0] and text[o - 1] not in WHITE:  # not within a word
                    m = SPACE.search(text, o, before[1])
                    o = m.end() if m else s if level < 3 else o
                while o < before[1] and text[o] in WHITE:
                    o += 1
                if o >= before[1]:
                    o = s
        out.append((o, s, e))
    return KINDS[level], out


def split_long(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, bodies: bool = True, room: int | None = None) -> DataFrame:
    """Pieces of every ``text`` of ``df`` over ``limit``: key, piece_no, boundary, start, own_start, end and, with ``bodies``, piece.

    One pass without a shuffle; short texts never leave the JVM. Other columns of ``df`` are not read.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("value")).where(F.length("value") > limit)
    schema = "key string, piece_no int, boundary string, start int, own_start int, end int" + (", piece string" if bodies else "")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[] for _ in range(7 if bodies else 6)]
                for k, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    kind, own = cut(value, limit, overlap, room) or ("", [])
                    for n, (o, s, e) in enumerate(own or ([(0, 0, 0)] if kind else [])):
                        for column, x in zip(out, (k, n, kind, o, s, e, *([value[o:e]] if bodies else []))):
                            column.append(x)
                i32, text_ = pa.int32(), pa.string()
                types = (text_, i32, text_, i32, i32, i32, text_)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["key", "piece_no", "boundary", "start", "own_start", "end", "piece"][: len(out)])

    return spread(rows).mapInArrow(run, schema)
