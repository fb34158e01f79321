"""Languages of documents and of the segments of mixed ones (problem 10).

A byte convolutional network reads windows of LENGTH bytes, which hold SPAN words at most and fewer where these
are long: filters of several widths over one-hot bytes, the maximum of each over the window, a softmax on top.
Training and use cut sentences into the same windows. Words are parted by more zero bytes than a filter is
wide, so the maximum over a window is the maximum over its words; in use a worker therefore convolves each
distinct word once, in batches of windows of fixed length, and takes the maximum over the words of a window,
which gives the values of the window itself. A word too long for a window is cut into several. The network is trained in numpy, first on the clean labelled
sentences, then on sentences of labelled documents where the first network agrees with the label; training
sentences are also given without their accents. Every sentence of a document gets the mean log-probability
of its windows; a segmentation of the document (a Viterbi path in which a segment has two sentences or more
and a change of language costs ``SWITCH``) joins them.

Bounds: the network is fitted on at most ``SAMPLE`` labelled documents, by hash order, which is all that is
sampled; every document is labelled, whole.

Results in special cases: null, empty and blank texts and texts without a word have no segment; a document
of one sentence is one segment; ties go to the earlier language of ``LANGUAGES``; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import spread

from .words import sampled

LANGUAGES = ("en", "cs", "sk", "de", "pl")
#: Labelled documents that the network is fitted on, at most.
SAMPLE = 3000
#: Clean sentences, and sentences of documents of each language, that it is fitted on, at most.
CLEAN, EACH = 10_000, 1200
SPAN, LENGTH, FILTERS, WIDTHS = 8, 168, 32, (3, 4, 6)
GAP = b"\0" * (max(WIDTHS) - 1)
#: Bytes of a word that a window can hold.
LONGEST = LENGTH - 2 - 2 * len(GAP)
#: Words whose filter values a worker keeps.
KEPT_WORDS = 100_000
SWITCH = 5.0
SENTENCES = re.compile(r"(?<=[.!?])[ \t\r\n\xa0]+|[\r\n]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")
MARKUP = re.compile(r"<[^<>\n]{1,40}>|https?://\S+")


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ł", "l")


def letters(sentence: str) -> bytes:
    return NOT_LETTERS.sub(" ", MARKUP.sub(" ", sentence).lower()).strip().encode("utf-8", "ignore")


def shares(words: list[bytes]) -> list[list[bytes]]:
    """A sentence's words in windows of SPAN at most that fit into LENGTH bytes, of equal shares, so that no window is a stub."""
    longest = max(map(len, words), default=0)
    if longest > LONGEST:
        words = [w[at : at + LONGEST] for w in words for at in range(0, len(w), LONGEST)]
    n = max(1, -(-len(words) // SPAN))
    if SPAN * (longest + 2 + len(GAP)) + len(GAP) > LENGTH:  # else any SPAN of them fit
        sizes = [len(w) + 2 + len(GAP) for w in words]
        fits = lambda n: all(sum(sizes[len(words) * k // n : len(words) * (k + 1) // n]) + len(GAP) <= LENGTH for k in range(n))
        while n < len(words) and not fits(n):
            n += 1
    return [words[len(words) * k // n : len(words) * (k + 1) // n] for k in range(n)]


def windows(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows (rows of LENGTH, zero at the end) of all sentences, and the sentence of each."""
    rows, of = [], []
    for i, raw in enumerate(raws):
        for own in shares(raw.split()):
            rows.append((GAP + b"".join(b" " + w + b" " + GAP for w in own)).ljust(LENGTH, b"\0"))
            of.append(i)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, LENGTH), np.array(of, np.int64)


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.filters = [(rng.standard_normal((w, 256, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0] = 0
        self.out = (rng.standard_normal((FILTERS * len(WIDTHS), len(LANGUAGES))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(LANGUAGES), np.float32)

    def pooled(self, x: np.ndarray, where: bool = False):
        values, places = [], []
        for f in self.filters:
            w = len(f)
            n = x.shape[1] - w + 1
            a = f[0][x[:, :n]]
            for k in range(1, w):
                a += f[k][x[:, k : k + n]]
            if where:
                p = a.argmax(1)
                places.append(p)
                values.append(np.take_along_axis(a, p[:, None], 1)[:, 0])
            else:
                values.append(a.max(1))
        v = np.maximum(np.concatenate(values, 1), 0)
        return (v, places) if where else v

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the cross-entropy, with dropout of pooled features."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                own = order[at : at + 64]
                xb, yb = x[own], y[own]
                h, places = self.pooled(xb, True)
                drop = (rng.random(h.shape) > 0.3) / np.float32(0.7)
                hd = (h * drop).astype(np.float32)
                z = hd @ self.out + self.bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.out.T) * drop * (h > 0)
                grads = []
                for i, f in enumerate(self.filters):
                    g = np.zeros_like(f)
                    part, place = back[:, i * FILTERS : (i + 1) * FILTERS], places[i]
                    for k in range(len(f)):
                        bytes_ = np.take_along_axis(xb, place + k, 1)
                        np.add.at(g[k], (bytes_, np.arange(FILTERS)[None, :]), part)
                    g[:, 0] = 0
                    grads.append(g)
                grads += [hd.T @ p, p.sum(0)]
                t += 1
                for j, (q, g) in enumerate(zip(params, grads)):
                    m[j] += 0.1 * (g - m[j])
                    v[j] += 0.001 * (g * g - v[j])
                    q -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)

    def words(self, new: list[bytes]) -> np.ndarray:
        """Filter values of words, each convolved once."""
        out = np.zeros((len(new), FILTERS * len(WIDTHS)), np.float32)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(new):
            by.setdefault(-(-(len(w) + 2 + 2 * len(GAP)) // 16) * 16, []).append(i)
        for length, own in by.items():
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                x = np.frombuffer(b"".join([(GAP + b" " + new[i] + b" ").ljust(length, b"\0") for i in part]), np.uint8).reshape(-1, length)
                out[part] = self.pooled(x)
        return out

    def sentences(self, raws: list[bytes]) -> np.ndarray:
        """Log-probabilities per sentence: the mean of its windows."""
        if not raws:
            return np.zeros((0, len(LANGUAGES)))
        if not hasattr(self, "index") or len(self.index) > KEPT_WORDS:
            self.index: dict[bytes, int] = {}
            self.rows = np.zeros((0, FILTERS * len(WIDTHS)), np.float32)
        flat, starts, of = [], [], []
        for i, raw in enumerate(raws):
            for own in shares(raw.split()):
                starts.append(len(flat))
                flat += own
                of.append(i)
        new = [w for w in dict.fromkeys(flat) if w not in self.index]
        if new:
            size = len(self.index)
            if size + len(new) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), size + len(new), 4096), self.rows.shape[1]), np.float32)
                grown[:size] = self.rows[:size]
                self.rows = grown
            self.rows[size : size + len(new)] = self.words(new)
            self.index.update(zip(new, range(size, size + len(new))))
        values = np.maximum.reduceat(self.rows[np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))], starts)
        z = values @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        s = np.zeros((len(raws), len(LANGUAGES)))
        np.add.at(s, np.array(of), z)
        return s / np.bincount(of, minlength=len(raws))[:, None]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "rows")}


def normal(label: str | None) -> str:
    """A label without letter case and region; '' if it says nothing."""
    label = re.split(r"[-_]", (label or "").strip().lower())[0]
    return "" if label == "und" else label


def units(text: str) -> list[tuple[int, int, bytes]]:
    """Sentences that hold a word: (start, end, letters)."""
    out, at = [], 0
    for m in [*SENTENCES.finditer(text), None]:
        end = m.start() if m else len(text)
        raw = letters(text[at:end])
        if len(raw) > 1:
            out.append((at, end, raw))
        at = m.end() if m else end
    return out


def path(scores: np.ndarray, switch: float = SWITCH) -> list[int]:
    """Best language of each sentence when segments have two sentences or more."""
    n, k = scores.shape
    if n < 2:
        return [int(scores[0].argmax())] if n else []
    first, later = scores[0].copy(), np.full(k, -np.inf)
    back = []
    for t in range(1, n):
        best = int(later.argmax())
        from_first = first >= later
        new_later = np.maximum(first, later) + scores[t]
        new_first = np.full(k, later[best] - switch) + scores[t]
        new_first[best] = -np.inf  # a change goes to another language
        back.append((from_first, best))
        first, later = new_first, new_later
    lang, is_later = int(later.argmax()), True
    out = [lang]
    for from_first, best in reversed(back):
        if is_later:
            is_later = not from_first[lang]
        else:
            lang, is_later = best, True
        out.append(lang)
    return out[::-1]


def segments(text: str | None, scored: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of every segment."""
    if not scored:
        return []
    s = np.array([x[2] for x in scored])
    # A short sentence says less, one that is all names or numbers hardly anything.
    langs = path(np.maximum(s, -8) * 2)
    out, a = [], 0
    for b in range(1, len(langs) + 1):
        if b == len(langs) or langs[b] != langs[a]:
            out.append((scored[a][0], scored[b - 1][1], LANGUAGES[langs[a]], float(np.exp(s[a:b, langs[a]]).mean())))
            a = b
    return out


def train(documents: DataFrame, samples: DataFrame, sample: int = SAMPLE, clean: int = CLEAN, each: int = EACH) -> Network:
    """The network; fitted on at most ``clean`` rows of the clean sentences, in the order of a hash, and ``sample`` documents.

    Of a document at most twelve sentences, of a language at most ``each`` sentences of documents are fitted on.
    """
    rows = sampled(samples.where(F.col("lang").isin(*LANGUAGES) & (F.length("text") > 0)).select("text", "lang", "sample_id" if "sample_id" in samples.columns else F.lit(0).alias("sample_id")), F.xxhash64("text"), clean, samples.count()).collect()
    clean_ = [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.sample_id, r.text))]
    raws = [(letters(v), LANGUAGES.index(g)) for t, g in clean_ for v in (t, plain(t))]
    first = Network()
    # Sentences are short of windows; halves of them double what the network sees.
    more = raws + [(r[len(r) // 2 :].partition(b" ")[2].strip() or r, g) for r, g in raws]
    x, of = windows([r for r, _ in more])
    first.fit(x, np.array([g for _, g in more])[of], 12)
    base = F.lower(F.element_at(F.split(F.trim("lang"), "[-_]"), 1))
    rows = documents.where(base.isin(*LANGUAGES) & (F.length("text") > 60)).select(base.alias("g"), F.col("text").alias("text"))
    rows = sampled(rows, F.xxhash64("text"), sample, documents.count()).collect()  # bounded by ``sample``
    pool, of_label = [], []
    for r in rows:
        own = units(r.text)[:12]  # of each sampled document, enough for fitting
        pool += [u[2] for u in own]
        of_label += [LANGUAGES.index(r.g)] * len(own)
    if not pool:
        return first
    guess = first.sentences(pool)
    label = np.array(of_label)
    agreed = np.flatnonzero((guess.argmax(1) == label) & (guess.max(1) > np.log(0.6)))
    rng = np.random.default_rng(3)
    train_raws, y = [], []
    for g in range(len(LANGUAGES)):
        own = agreed[label[agreed] == g]
        own = own[rng.permutation(len(own))[:each]]
        for i in own:
            train_raws.append(pool[i])
            y.append(g)
        for i in own[: len(own) // 3]:
            train_raws.append(plain(pool[i].decode()).encode())
            y.append(g)
    second = Network(12)
    train_raws += [r for r, _ in more]
    y += [g for _, g in more]
    x, of = windows(train_raws)
    second.fit(x, np.array(y)[of], 4)
    return second


def label_segments(documents: DataFrame, network: Network, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """key, seg_no, start, end, lang, confidence, n_segments, label: every segment of every document with words."""
    shared = documents.sparkSession.sparkContext.broadcast(network)
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).where(F.col("text").rlike("\\p{L}"))

    def run(batches):
        net = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts, labels = part.column(1).to_pylist(), part.column(2).to_pylist()
                own = [units(t) for t in texts]
                s = net.sentences([u[2] for o in own for u in o])
                which, columns, n = [], [[] for _ in range(7)], 0
                for i, o in enumerate(own):
                    scored = [(u[0], u[1], s[n + j]) for j, u in enumerate(o)]
                    n += len(o)
                    found = segments(texts[i], scored)
                    for k, (a, b, g, c) in enumerate(found):
                        which.append(i)
                        for column, value in zip(columns, (k, a, b, g, c, len(found), normal(labels[i]))):
                            column.append(value)
                types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=["key", "seg_no", "start", "end", "lang", "confidence", "n_segments", "label"])

    return spread(rows).mapInArrow(run, f"key {kind}, seg_no int, start int, end int, lang string, confidence double, n_segments int, label string")
