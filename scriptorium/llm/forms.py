"""One consistent form for text that looks the same (problem 3).

Arrow text is copied to one array of code points for many rows at a time. A table gives each code point a
class and a replacement; deleted and expanded characters move the rest by offsets (a cumulative sum of
output widths); marks are then composed with the letters before them, pair by pair over the whole array.
No step calls a string function per row.

What changes: full-width forms, compatibility ligatures, combining accents (composed), invisible characters
(dropped), odd spaces (an ordinary one), Cyrillic and Greek letters that look Latin where they stand in
place of Latin ones. What stays: superscripts, fractions, symbols of formulas, whole foreign words.

A word of look-alikes alone counts as Latin unless a neighbouring word holds letters of that script that
look like no Latin letter. Null stays null, empty stays empty; repeated rows give equal results.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.session import spread

# Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ", "ABESIJKMHOPCTYXaesijopcyxdhqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"))
INVISIBLE = [0x00AD, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF]
# Combining accents; marks for symbols (from U+20D0) belong to formulas and stay.
MARKS = [*range(0x0300, 0x0370), *range(0x1AB0, 0x1AC9), *range(0x1DC0, 0x1E00), *range(0xFE20, 0xFE30)]
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

WIDE, MARK, HIDDEN, BLANK = 1, 2, 4, 8
LATIN, ALIKE, FOREIGN, WORD = 1, 2, 4, 8
SIZE = 0x30000
#: Code points worked on at a time; bounds a worker's memory.
BLOCK = 1_500_000


@functools.cache
def tables() -> dict[str, np.ndarray]:
    kind, letter = np.zeros(SIZE, np.uint8), np.zeros(SIZE, np.uint8)
    to = np.arange(SIZE, dtype=np.uint32)
    width = np.ones(SIZE, np.uint8)
    for c in [*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7)]:
        kind[c], to[c] = WIDE, ord(unicodedata.normalize("NFKC", chr(c))[0])
    for c in MARKS:
        kind[c] = MARK
    for c in INVISIBLE:
        kind[c], width[c] = HIDDEN, 0
    for c in SPACES:
        kind[c], to[c] = BLANK, 0x20
    for c in range(SIZE):
        if unicodedata.category(chr(c))[0] == "L":
            name = unicodedata.name(chr(c), "")
            letter[c] = WORD | (LATIN if name.startswith(("LATIN", "FULLWIDTH LATIN")) else FOREIGN if name.startswith(("CYRILLIC", "GREEK")) else 0)
    alike = np.arange(SIZE, dtype=np.uint32)
    for a, b in (CYRILLIC | GREEK).items():
        letter[ord(a)], alike[ord(a)] = WORD | ALIKE, ord(b)
    for c in (*MARKS, *INVISIBLE):  # they don't part a word
        letter[c] = WORD
    # Expansions: ligatures, as (first, second, third).
    more = np.zeros((SIZE, 3), np.uint32)
    for c in [*range(0xFB00, 0xFB07), 0x0132, 0x0133]:
        parts = [ord(x) for x in unicodedata.normalize("NFKC", chr(c))]
        more[c, : len(parts)], width[c] = parts, len(parts)
    pairs = {}
    for c in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(c))
        for cut in range(1, len(d)):
            base = unicodedata.normalize("NFC", d[:cut])
            if len(base) == 1 and len(d) == cut + 1 and unicodedata.normalize("NFC", chr(c)) == chr(c):
                pairs[ord(base) << 20 | ord(d[cut])] = c
    keys = np.array(sorted(pairs), np.uint64)
    return {"kind": kind, "letter": letter, "to": to, "width": width, "alike": alike, "more": more, "keys": keys, "made": np.array([pairs[int(k)] for k in keys], np.uint32)}


def words_in_place(points: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """True at each look-alike that stands in place of a Latin letter."""
    flags = t["letter"][points]
    inside = (flags & WORD) > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(starts)
    if not len(first) or not (flags & ALIKE).any():
        return np.zeros(len(points), bool)
    word = np.cumsum(starts) - 1
    has = np.bitwise_or.reduceat(np.where(inside, flags, 0), first)
    latin, foreign, like = (has & LATIN) > 0, (has & FOREIGN) > 0, (has & ALIKE) > 0
    beside = np.zeros(len(first), bool)
    same = row[first[1:]] == row[first[:-1]]
    beside[1:] |= foreign[:-1] & same
    beside[:-1] |= foreign[1:] & same
    in_place = like & (latin & True | ~foreign & ~beside)
    in_place &= ~(foreign & ~latin)
    return inside & ((flags & ALIKE) > 0) & in_place[np.maximum(word, 0)]


def compose(points: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marks joined to the letters before them, wherever a single code point exists."""
    while len(points) > 1:
        marks = np.flatnonzero(t["kind"][np.minimum(points[1:], SIZE - 1)] == MARK) + 1
        marks = marks[row[marks] == row[marks - 1]]
        if not len(marks):
            break
        key = points[marks - 1].astype(np.uint64) << np.uint64(20) | points[marks].astype(np.uint64)
        at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = t["keys"][at] == key
        marks, made = marks[hit], t["made"][at[hit]]
        if not len(marks):
            break
        points[marks - 1] = made
        keep = np.ones(len(points), bool)
        keep[marks] = False
        points, row = points[keep], row[keep]
    return points, row


def block(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, their row, and per row whether it holds something to change; ``lengths`` in bytes."""
    t = tables()
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.frombuffer(text, np.uint8)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edge = np.concatenate([[0], np.cumsum(lengths)])
    row = np.repeat(np.arange(len(lengths)), np.diff(lead[edge]))
    low = np.minimum(points, SIZE - 1)
    kind = t["kind"][low]
    swap = words_in_place(low, row, t)
    found = np.zeros(len(lengths), bool)
    found[row[(kind > 0) | swap]] = True
    return points, row, found


def rewrite(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of a block."""
    t = tables()
    low = np.minimum(points, SIZE - 1)
    swap = words_in_place(low, row, t)
    width = t["width"][low]
    out = np.where(points < SIZE, t["to"][low], points)
    out = np.where(swap, t["alike"][low], out)
    where = np.cumsum(width) - width
    total = int(width.sum())
    new, new_row = np.zeros(total, np.uint32), np.zeros(total, row.dtype)
    one = width == 1
    new[where[one]], new_row[where[one]] = out[one], row[one]
    for i in range(3):
        wide = (width > 1) & (width > i)
        new[where[wide] + i], new_row[where[wide] + i] = t["more"][low[wide], i], row[wide]
    return compose(new, new_row, t)


def column_blocks(column: pa.Array):
    """The rows of an Arrow string column in blocks: (rows, bytes, lengths in bytes)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, "right")) - 1)
        stop = min(stop, len(column))
        yield slice(start, stop), (data.slice(int(offsets[start]), int(offsets[stop] - offsets[start])).to_pybytes() if data else b""), np.diff(offsets[start : stop + 1])
        start = stop


def odd_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose ``text`` holds something that the consistent form changes, without the text."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in keep])
    # Texts of plain ASCII can't be cases; the JVM drops them before anything is copied.
    rows = df.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(*keep, F.col(text).alias("__text"))

    def run(batches):
        for batch in batches:
            found = [block(data, lengths)[2] for _, data, lengths in column_blocks(batch.column("__text"))]
            yield batch.select(keep).filter(pa.array(np.concatenate(found) if found else np.zeros(0, bool)))

    return spread(rows).mapInArrow(run, schema)


def unify(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` in its consistent form; all other columns as they are."""
    schema = df.schema

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            source = batch.column(i)
            out = []
            for rows, data, lengths in column_blocks(source):
                points, row, _ = block(data, lengths)
                points, row = rewrite(points, row)
                raw = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
                lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                ends = np.searchsorted(row, np.arange(len(lengths)), "right")
                at = np.concatenate([lead, [len(raw)]])
                offsets = np.concatenate([[0], at[ends]]).astype(np.int64)
                out.append(pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]))
            new = pa.concat_arrays(out).cast(pa.string()) if out else pa.array([], pa.string())
            if source.null_count:
                new = pa.compute.if_else(source.is_null(), pa.scalar(None, pa.string()), new)
            yield batch.set_column(i, pa.field(text, pa.string()), new)

    return spread(df).mapInArrow(run, schema)
