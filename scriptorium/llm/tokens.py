"""Encoding with a public byte-level BPE vocabulary (problem 8).

Each short word is encoded on a contiguous array of ranks: part boundaries and the rank of every adjacent
pair lie side by side, the minimum is found by a scan, its right boundary is deleted and the two ranks
beside it are computed again. Long words, where repeated scans would be quadratic, use a heap over the same
parts; both give the same ids.

Results in special cases: an empty text and a null text give an empty list; strings that look like special
tokens are ordinary text. Only ``text`` is read, other columns pass through untouched.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.session import spread

#: Folder of the public vocabularies; a parameter of every function that reads one.
VOCABULARIES = "/opt/tokenizers"
#: Words of more bytes than this are merged with a heap.
SHORT_WORD = 64
#: Words kept in a worker's memory before the store is emptied.
CACHE_WORDS = 300_000
#: The pattern that splits text before the merges, published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 30


def load_ranks(folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """Rank of each token of the vocabulary file ``name``.tiktoken."""
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``word`` by scans over contiguous boundaries and ranks."""
    bounds = list(range(len(word) + 1))
    get = ranks.get
    # near[i]: rank of the pair that joins part i and part i + 1
    near = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == NONE:
            break
        i = near.index(least)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[bounds[i] : bounds[i + 2]], NONE)
        if i:
            near[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long word: the leftmost pair of least rank comes from a heap."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or not alive[j] or end[j] != stop:
            continue  # one of the parts has changed since
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p : end[i]])) is not None:
            heapq.heappush(heap, (r, p, end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Words(dict):
    """Ids by word, filled as words come up."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        if raw in self.ranks:
            ids = (self.ranks[raw],)
        else:
            ids = tuple((merge_short if len(raw) <= SHORT_WORD else merge_long)(raw, self.ranks))
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(raw) <= 4 * SHORT_WORD:
            self[word] = ids
        return ids


class Encoder:
    """Text to ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.words = Words(ranks)
        self.split = regex.compile(PATTERN).findall

    def __call__(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text)))) if text else []


def encode_column(df: DataFrame, text: str = "text", ids: str = "ids", folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> DataFrame:
    """``df`` with the column ``ids`` (list of int) in place of ``text``.

    The vocabulary (about 1 MB whatever the data) is read by the driver and broadcast. A column of ``df``
    that is named like ``ids`` is replaced.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(folder, name))
    keep = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        encode = Encoder(ranks.value)
        for batch in batches:
            values, offsets = array("i"), array("i", [0])
            column = batch.column(text)
            for start in range(0, len(column), 256):
                for value in column.slice(start, 256).to_pylist():
                    if value:
                        values.extend(chain.from_iterable(map(encode.words.__getitem__, encode.split(value))))
                    offsets.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(values) if len(values) else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, ids])

    return spread(df.select(*keep, F.col(text).cast("string").alias(text))).mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str = "ids", text: str = "text", folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> DataFrame:
    """``df`` with the text that the column ``ids`` stands for in place of it; bytes that are no text become U+FFFD, null stays null."""
    spark = df.sparkSession
    words = spark.sparkContext.broadcast({i: t for t, i in load_ranks(folder, name).items()})
    keep = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(text, T.StringType())])

    def run(batches):
        token = words.value.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if v is None else b"".join(map(token, v)).decode("utf-8", "replace") for v in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text])

    return df.select(*keep, ids).mapInArrow(run, schema)
