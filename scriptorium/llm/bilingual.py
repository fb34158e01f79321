"""Sentences of bilingual documents that translate one another (problem 6).

Word tables are learned from the documents themselves, over all of them. The first pass pairs the sentences
that share numbers, names and glossary terms and are each other's best; from the words of these pairs come
association weights, with which the next passes pair again, better each time. In a pass each sentence
becomes a weighted bag of words of the other language, which is looked up in the inverted index of the other
text, (word) to (sentences); what a lookup finds gives both directions, the share of the left sentence's bag
that the right one holds and the other way round. Matches that are best both ways are kept, and grow into
their neighbours where a sentence is split in two or joined with the next one.

Lookups run over whole Arrow batches at once, as sorts and searches of arrays of (text pair, word): scores are
kept for pairs of sentences that share a word, never for all. A text is read into word ids once, whatever the
number of its counterparts; a (volume, section) with very many texts is joined in blocks of ``BLOCK`` left texts.

The tables are models, of at most ``entries`` word pairs and ``partners`` for a word (a warning says when the
first bound is hit); they are broadcast.

Results in special cases: documents with a null key part, null or blank text have no counterpart; repeated
rows (equal id) count once; equal texts under several ids are aligned once and give their rows for every id.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut, spread

from . import forms
from .words import most_frequent_table

TOKEN = re.compile(r"[A-Z]{2}-\d+|\d+(?:[.,]\d+)?|[^\W\d_]+")
#: Defaults of the size of the tables.
ENTRIES, PARTNERS = 2_000_000, 15
#: Left texts of one (volume, section) that are joined together, and lookups that are held at a time.
BLOCK, HELD = 64, 4_000_000
#: Scores at which sentences match (while learning, in the end) and at which a neighbour joins a match.
LEARN, MATCH, GROW = 0.40, 0.55, 0.50
#: Order is a hint, not a rule: what a match at the other end of the text loses.
HINT = 0.08


def sentences(text: str) -> list[str]:
    """A sentence ends at . ! or ? before white space and then a capital letter or a digit."""
    out, at = [], 0
    for m in re.finditer(r"(?<=[.!?])[ \t\r\n]+", text):
        if m.end() < len(text) and (text[m.end()].isupper() or text[m.end()].isdigit()):
            out.append(text[at : m.start()])
            at = m.end()
    out.append(text[at:])
    return out


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    w = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    return w if len(w) < 5 else w[:4] if len(w) == 5 else w[:5]


@functools.lru_cache(300_000)
def _forms(token: str) -> tuple[str, ...]:
    """What a token within a sentence stands for."""
    if token[0].isdigit() or "-" in token:
        return ("#" + token.replace(",", "."),)
    return ("@" + token.lower(), stem(token)) if token[0].isupper() and len(token) > 3 else (stem(token),)


def tokens(sentence: str) -> list[str]:
    """Stems; numbers and codes begin with '#', words that may be names with '@' as well as by their stem.

    At the beginning of a sentence a capital letter says nothing.
    """
    found = TOKEN.findall(sentence)
    early = sum(m.start() < 3 for m in islice(TOKEN.finditer(sentence), 3))
    begin = [_forms(t)[-1] for t in found[:early]]
    return list(dict.fromkeys([*begin, *chain.from_iterable(map(_forms, found[early:]))]))


class Tables:
    """Weights of word pairs (left, right) and of single words, by word ids in sorted arrays."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, left: dict[int, float], right: dict[int, float]):
        order = np.lexsort((v, u))
        self.u, self.v, self.w = u[order], v[order], w[order].astype(np.float32)
        self.left, self.right = _sorted(left), _sorted(right)


def _sorted(weights: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(sorted(weights), np.int64)
    return keys, np.array([weights[k] for k in keys.tolist()], np.float32)


def word_id(token: str) -> int:
    """63 bits of a hash; the last bit says that the token is a number, code or name, which needs no table."""
    import xxhash

    return xxhash.xxh64_intdigest(token) >> 1 & ~1 | (token[0] in "#@")


class Side:
    """The sentences of one language of many text pairs, end to end; those without a word are left out."""

    def __init__(self, words: list[bytes], sizes: list[bytes]):
        n = [np.frombuffer(x, np.int32) for x in sizes]
        size = np.concatenate(n) if n else np.zeros(0, np.int32)
        count = np.array([len(x) for x in n], np.int64)
        pair, place = _ramp(count)
        kept = size > 0
        self.word = np.frombuffer(b"".join(words), np.int64)
        #: Per sentence: its text pair, its number in the text, words, and place among those with words.
        self.pair, self.number, self.size = pair[kept], place[kept], size[kept].astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.sentence = np.repeat(np.arange(len(self.size)), self.size)
        begin = np.searchsorted(self.pair, self.pair)
        self.place = (np.arange(len(self.pair)) - begin) / np.maximum(1, np.searchsorted(self.pair, self.pair, "right") - begin)


def _ramp(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): (0, 0, 1, 1, 1) and (0, 1, 0, 1, 2)."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _weights(side: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> np.ndarray:
    """Words without a partner are as good as stop words; before anything is learned all but the seeds weigh little."""
    keys, values = side
    out = np.full(len(words), 1.5 if len(keys) else 0.2, np.float32)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        hit = keys[at] == words
        out[hit] = values[at[hit]]
    out[words & 1 == 1] = 3.0
    return out


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(key, return_inverse=True)
    return keys, np.bincount(inverse, value, len(keys)).astype(np.float64)  # of nothing it gives whole numbers


def _greatest(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.maximum.reduceat(value, first) if len(first) else value


def retrieve(a: Side, b: Side, tables: Tables, least: float, grow: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key (left sentence * right sentences + right sentence), ab, ba: the bags' shares for sentences that share a word.

    What reaches neither ``least`` as a score nor ``grow`` as a share is left out.
    """
    n = max(1, len(b.size))
    wa, wb = _weights(tables.left, a.word), _weights(tables.right, b.word)
    whole_a, whole_b = np.bincount(a.sentence, wa, len(a.size)), np.bincount(b.sentence, wb, len(b.size))
    # The inverted index of the right side: (text pair, word) in order, and where its tokens are.
    names, name = np.unique(b.word, return_inverse=True)
    index = b.pair[b.sentence] * len(names) + name if len(names) else np.zeros(0, np.int64)
    order = np.argsort(index, kind="stable")
    index = index[order]
    # The bags of the left side: partners of each token, or the token itself.
    begin, end = np.searchsorted(tables.u, a.word), np.searchsorted(tables.u, a.word, "right")
    of, nth = _ramp(end - begin)
    marked = np.flatnonzero(a.word & 1)
    token = np.concatenate([of, marked])
    wanted = np.concatenate([tables.v[begin[of] + nth], a.word[marked]])
    weight = np.concatenate([tables.w[begin[of] + nth], np.ones(len(marked), np.float32)])
    at = np.searchsorted(names, wanted)
    known = at < len(names)
    known[known] = names[at[known]] == wanted[known]
    token, at, weight = token[known], at[known], weight[known]
    sorted_ = np.argsort(token, kind="stable")
    token, at, weight = token[sorted_], at[sorted_], weight[sorted_]
    look = a.pair[a.sentence[token]] * len(names) + at
    first, last = np.searchsorted(index, look), np.searchsorted(index, look, "right")
    # Whole left sentences at a time, so that what is held is bounded.
    block = (np.cumsum(np.bincount(a.sentence[token], last - first, len(a.size))) // HELD)[a.sentence[token]]
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(token)] if len(token) else [0]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for x, y in zip(edges, edges[1:]):
        hit, nth = _ramp(last[x:y] - first[x:y])
        hit += x
        i, j, w = token[hit], order[first[hit] + nth], weight[hit]
        # of each left token the best in each right sentence, and of each right token the best in each left sentence
        key, best = _greatest(i * n + b.sentence[j], w)
        keys, ab = _sums(a.sentence[key // n] * n + key % n, best * wa[key // n])
        m = max(1, len(a.size))
        key, best = _greatest(j * m + a.sentence[i], w)
        other, ba = _sums(key % m * n + b.sentence[key // m], best * wb[key // m])
        ab /= np.maximum(1e-6, whole_a[keys // n])
        ba /= np.maximum(1e-6, whole_b[other % n])
        good = (np.sqrt(ab * ba) >= least) | (ab >= grow) | (ba >= grow)  # both have the same keys
        out.append((keys[good], ab[good], ba[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def align(a: Side, b: Side, tables: Tables, match: float, grow: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right sentences that match, with their scores; without ``grow`` only those that are best both ways."""
    n = max(1, len(b.size))
    key, ab, ba = retrieve(a, b, tables, match - HINT, 9.0 if grow is None else grow)
    i, j, score = key // n, key % n, np.sqrt(ab * ba)
    hint = score - HINT * np.abs(a.place[i] - b.place[j])

    def best(of: np.ndarray, other: np.ndarray) -> np.ndarray:
        order = np.lexsort((other, -hint, of))
        out = np.zeros(len(of), bool)
        out[order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]] = True
        return out

    if not len(key):
        return i, j, score
    kept = np.flatnonzero(best(i, j) & best(j, i) & (score >= match))
    found = [(i[kept], j[kept], score[kept])]
    if grow is not None:
        for own, other, share, side in ((i, j, ab, a), (j, i, ba, b)):
            most = np.zeros(len(side.size))
            np.maximum.at(most, own, share)
            # a neighbour of a matched sentence whose words the sentence on the other side holds as well
            near = (own[kept][:, None] + np.array([-1, 1])).ravel()
            at = np.repeat(other[kept], 2)
            source = np.repeat(own[kept], 2)
            inside = (near >= 0) & (near < len(side.size))
            near, at, source = near[inside], at[inside], source[inside]
            same = side.pair[near] == side.pair[source]
            near, at = near[same], at[same]
            wanted = near * n + at if side is a else at * n + near
            where = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            good = (key[where] == wanted) & (share[where] >= np.maximum(grow, most[near] - 0.15)) & ~np.isin(near, own[kept])
            near, where = near[good], where[good]
            _, first = np.unique(near, return_index=True)  # one match for a neighbour, that of the earlier sentence
            found.append((i[where[first]], j[where[first]], share[where[first]]))
    return tuple(np.concatenate(c) for c in zip(*found))


def consistent(rows: list[str]) -> list[str]:
    """``rows`` in one form of characters, looked through together; few need a change."""
    out, odd = list(rows), [i for i, s in enumerate(rows) if not s.isascii()]
    raw = [rows[i].encode("utf-8", "replace") for i in odd]
    points, row, found = forms.block(b"".join(raw), np.array([len(r) for r in raw], np.int64))
    for k in np.flatnonzero(found):
        a, b = np.searchsorted(row, [k, k + 1])
        out[odd[k]] = forms.rewrite(points[a:b], row[a:b])[0].tobytes().decode("utf-32-le", "surrogatepass")
    return out


def bags(pages: DataFrame, fixer=None, left: str = "cs", right: str = "en") -> tuple[DataFrame, DataFrame]:
    """Texts as word ids (text_id, volume, section, lang, words, sizes of sentences) and members (text_id, page_id).

    ``fixer`` restores garbled words first.
    """
    own = pages.where("content_type = 'text/html' AND edition = 'full' AND section IS NOT NULL AND coalesce(book, '') = ''").where(F.col("lang").isin(left, right) & F.col("text").rlike("\\S"))
    own = own.withColumn("volume", F.regexp_extract("url", "/(v[0-9]+)/", 1)).where("volume <> ''")
    own = own.select("page_id", "volume", "section", "lang", "text", F.sha1(F.concat_ws("\u0001", "volume", "section", "lang", "text")).alias("text_id"))
    shared = pages.sparkSession.sparkContext.broadcast(fixer)

    def run(batches):
        fix = shared.value
        ids: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                own = [sentences(t) for t in part.column(4).to_pylist()]
                if fix is not None:
                    own = [[fix.restored(s) for s in o] if fix.suspect(t) else o for t, o in zip(part.column(4).to_pylist(), own)]
                flat = consistent([s for o in own for s in o])
                words, sizes, n = [], [], 0
                for o in own:
                    rows = [tokens(s) for s in flat[n : n + len(o)]]
                    n += len(o)
                    for t in {t for r in rows for t in r} - ids.keys():
                        ids[t] = word_id(t)
                    words.append(np.array([ids[t] for r in rows for t in r], np.int64).tobytes())
                    sizes.append(np.array([len(r) for r in rows], np.int32).tobytes())
                if len(ids) > 300_000:
                    ids.clear()
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], names=["text_id", "volume", "section", "lang", "words", "sizes"])

    # Only texts that have a counterpart are read.
    both = own.select("volume", "section", "lang").distinct().groupBy("volume", "section").agg(F.count("*").alias("langs")).where("langs = 2")
    own = own.join(both.select("volume", "section"), ["volume", "section"], "left_semi")
    texts = own.select("text_id", "volume", "section", "lang", "text").dropDuplicates(["text_id"])
    return cut(spread(texts).mapInArrow(run, "text_id string, volume string, section string, lang string, words binary, sizes binary")), own.select("text_id", "page_id").distinct()


def counterparts(texts: DataFrame, left: str = "cs", right: str = "en") -> DataFrame:
    """left_id, a, a_sizes, right_id, b, b_sizes: every left text with every right one of its volume and section.

    Each is a result of its own, so all have to meet; a section of many texts is split into blocks of left ones.
    """
    blocks = texts.where(F.col("lang") == left).groupBy("volume", "section").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = texts.join(blocks, ["volume", "section"])
    a = placed.where(F.col("lang") == left).select("volume", "section", F.expr("pmod(xxhash64(text_id), blocks)").cast("int").alias("block"), F.col("text_id").alias("left_id"), F.col("words").alias("a"), F.col("sizes").alias("a_sizes"))
    b = placed.where(F.col("lang") == right).select("volume", "section", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("text_id").alias("right_id"), F.col("words").alias("b"), F.col("sizes").alias("b_sizes"))
    return a.join(b, ["volume", "section", "block"]).select("left_id", "a", "a_sizes", "right_id", "b", "b_sizes")


def _sides(batches):
    """Left and right ids, and both sides, of the rows of Arrow batches, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            yield part.column(0), part.column(3), Side(part.column(1).to_pylist(), part.column(2).to_pylist()), Side(part.column(4).to_pylist(), part.column(5).to_pylist())


def _learn(rows: DataFrame, tables: Tables, match: float, entries: int, partners: int) -> Tables:
    """New tables from the sentence pairs that the old ones give."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        for _, _, a, b in _sides(batches):
            i, j, _ = align(a, b, shared.value, match, None)
            # all words of the left sentence with all of the right one, and each word once for itself
            sizes = a.size[i] * b.size[j]
            of, nth = _ramp(sizes)
            u, v = a.word[a.first[i][of] + nth // b.size[j][of]], b.word[b.first[j][of] + nth % b.size[j][of]]
            l_of, l_nth = _ramp(a.size[i])
            r_of, r_nth = _ramp(b.size[j])
            left, right = a.word[a.first[i][l_of] + l_nth], b.word[b.first[j][r_of] + r_nth]
            u, v = np.concatenate([u, left, np.zeros_like(right)]), np.concatenate([v, np.zeros_like(left), right])
            plain = (u | v) & 1 == 0
            pairs, n = np.unique(np.stack([u[plain], v[plain]], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], names=["u", "v", "n"])

    n = cut(rows.mapInArrow(run, "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n")))
    left, right = n.where("v = 0").select("u", F.col("n").alias("n_u")), n.where("u = 0").select("v", F.col("n").alias("n_v"))
    both = n.where("u <> 0 AND v <> 0 AND n > 1").join(left, "u").join(right, "v").withColumn("w", F.col("n") / F.sqrt(F.col("n_u") * F.col("n_v").cast("double"))).where("w >= 0.15")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("w"), "v"))
    got = most_frequent_table(both.withColumn("r", rank).where(F.col("r") <= partners).select("u", "v", "n", "w", "n_u", "n_v"), entries, key=("u", "v"))
    u, v, _, w, n_u, n_v = (c.to_numpy() for c in got.columns)
    top = max([1, *n_u[:1], *(n_u.max(), n_v.max())] if len(u) else [1])
    # The best partner of a word counts in full, others by their share of it.
    weigh = lambda k, m: dict(zip(k.tolist(), (0.3 + np.log((top + 1) / m)).tolist()))
    return Tables(u, v, np.minimum(1.0, 1.6 * w), weigh(u, n_u), weigh(v, n_v))


def seeds(glossary: DataFrame, most: int = 100_000) -> Tables:
    """Tables of the glossary alone, a fixed table; one of more than ``most`` rows is an error."""
    pairs: dict[tuple[int, int], float] = {}
    rows = glossary.select("term_cs", "term_en").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a glossary of more than {most} rows")
    for r in rows:
        x, y = tokens(r.term_cs or ""), tokens(r.term_en or "")
        for u in x:
            for v in y:
                if len(u) > 2 and len(v) > 2:
                    pairs[word_id(u), word_id(v)] = 1.0 / max(1, len(y) - 1)
    u, v = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    return Tables(u, v, np.array(list(pairs.values()), np.float32), {k: 1.0 for k, _ in pairs}, {k: 1.0 for _, k in pairs})


def translations(pages: DataFrame, glossary: DataFrame, fixer=None, passes: int = 3, entries: int = ENTRIES, partners: int = PARTNERS) -> DataFrame:
    """page_id_a, sent_a, page_id_b, sent_b (a is the smaller id), score."""
    texts, members = bags(pages, fixer)
    rows = cut(counterparts(texts))
    tables = seeds(glossary)
    for k in range(passes):
        tables = _learn(rows, tables, 0.2 if k == 0 else LEARN, entries, partners)
    shared = pages.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        for left, right, a, b in _sides(batches):
            i, j, s = align(a, b, shared.value, MATCH, GROW)
            numbers = [pa.array(side.number[k].astype(np.int32)) for side, k in ((a, i), (b, j))]
            yield pa.RecordBatch.from_arrays([left.take(pa.array(a.pair[i])), numbers[0], right.take(pa.array(a.pair[i])), numbers[1], pa.array(s.astype(np.float64))], names=["left_id", "i", "right_id", "j", "score"])

    found = rows.mapInArrow(run, "left_id string, i int, right_id string, j int, score double")
    x = members.select(F.col("text_id").alias("left_id"), F.col("page_id").alias("p"))
    y = members.select(F.col("text_id").alias("right_id"), F.col("page_id").alias("q"))
    full = found.join(x, "left_id").join(y, "right_id")
    first = F.col("p") < F.col("q")
    return full.select(
        F.least("p", "q").alias("page_id_a"), F.when(first, F.col("i")).otherwise(F.col("j")).alias("sent_a"),
        F.greatest("p", "q").alias("page_id_b"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("sent_b"), "score",
    )
