"""Text decoded with the wrong character encoding (problem 1).

A character n-gram model (orders 1 to 5, interpolated with the Witten-Bell weights) is trained on the words
of all clean records, those whose characters all belong to Czech or English text; words and n-grams are
counted in Spark, and the model holds all of them. Every word that holds anything
but ASCII letters in a sound place is put through every chain "encode as Y, decode as X", one step or, through
UTF-8, two; the likeliest result counts if it beats the word as it stands by more than a margin, which is
validated on all clean words (false alarms) and on the same words garbled by several chains (detection). Characters
lost for good (U+FFFD, or a question mark within a word) are scored by filling in the likeliest letters.

A record is a case if one word is accepted. A single-byte chain supported by one word of a line is held
against the words beside it: where those can't have come through the same wrong decoding, it is a misread
letter and not an encoding.

A word of more than LONGEST characters is looked at in parts, each ending at an ASCII character if one is there.
U+FFFD is what a decoder writes for a character that it has lost, so a word that holds one is a case by definition.

Results in special cases: null and empty values are never cases and stay as they are; lost characters are
left in the restored text, since nothing can bring them back; repeated rows give equal results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.session import cut, spread

from .words import count_words, most_frequent_table

# Encodings that Czech and English pages were written in, and those they are wrongly read in.
WRITTEN = ("cp1250", "iso8859_2", "cp852", "mac_latin2")
READ = ("cp1252", "cp1250", "latin_1", "iso8859_2", "cp852", "cp437", "cp1251", "mac_latin2", "mac_roman")
#: Of these, the ones that only UTF-8 was read in: a Cyrillic page would be spoilt whole, letters and all.
CYRILLIC = ("cp1251",)
#: Characters of clean Czech and English records, as a Java character class.
CLEAN = "^[\\x09\\x0a\\x0d\\x20-\\x7eáčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ–—„“”‘’°²³½±×]*$"
ALPHABET = "abcdefghijklmnopqrstuvwxyzáčďéěíňóřšťúůýž"
CAPITAL = re.compile("[a-záčďéěíňóřšťúůýž][A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ]")
LOST = "�"
#: Letters of other languages, rare but sound, that the margin is validated on.
RARE = "öãñçïâåüôàêøëîäßæœùò"
LONGEST = 200
_PART = rf"[^ \t\r\n]{{1,{LONGEST}}}"
#: A word; one that is too long in parts that don't end within a garbled sequence.
SPLIT = rf"{_PART}(?![^ \t\r\n])|{_PART}(?<=[\x00-\x7f])|{_PART}"
ORDER = 5
#: Bits for the number of different characters that follow a context.
KINDS = 21


def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; bytes that the codec leaves undefined are control characters, as browsers read them."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def _chars_of(codec: str) -> list[str]:
    return [c for c, _ in sorted(_bytes_of(codec).items(), key=lambda x: x[1])] if len(_bytes_of(codec)) == 256 else [bytes([b]).decode(codec, "replace") for b in range(256)]


ENCODE = {y: _bytes_of(y) for y in READ}
DECODE = {x: _chars_of(x) for x in WRITTEN}


def ngrams_of(words: dict[str, int]) -> dict[str, int]:
    """Counts of the n-grams of all orders in words and their counts."""
    counts: dict[str, int] = defaultdict(int)
    for word, n in words.items():
        s = "^" + NGrams.key(word) + "$"
        for k in range(1, ORDER + 1):
            for i in range(len(s) - k + 1):
                counts[s[i : i + k]] += n
    return counts


def count_ngrams(words: DataFrame) -> DataFrame:
    """g, n over all ``words`` (word, n); added up within a task first. A question mark within a word is a lost letter, not one of the language."""

    def run(batches):
        for batch in batches:
            rows = {w: n for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if "?" not in w.rstrip("?!.,;:)“”\"'")}
            counts = ngrams_of(rows)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["g", "n"])

    return words.select("word", "n").mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


class NGrams:
    """Likelihood of words by character n-grams, from the n-grams' counts."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        after: dict[str, list[int]] = {}
        for g, n in counts.items():
            if len(g) > 1:
                a = after.setdefault(g[:-1], [0, 0])
                a[0] += n
                a[1] += 1
        # total and number of kinds in one integer, which takes a quarter of the room
        self.after = {g: n << KINDS | kinds for g, (n, kinds) in after.items()}
        self.total = sum(c for g, c in self.counts.items() if len(g) == 1)
        self.memo: dict[str, float] = {}

    @staticmethod
    def key(word: str) -> str:
        return "".join("0" if c.isdigit() and c.isascii() else c for c in word.lower())

    def chance(self, g: str) -> float:
        """Probability of the last character of ``g`` after the others."""
        p = (self.counts.get(g[-1], 0) + 1e-7) / (self.total + 1)
        for k in range(2, len(g) + 1):
            h = g[-k:]
            a = self.after.get(h[:-1])
            if a is None:
                break
            kinds = a & (1 << KINDS) - 1
            p = (self.counts.get(h, 0) + kinds * p) / ((a >> KINDS) + kinds)
        return p

    def score(self, word: str) -> float:
        """Log-likelihood; a character that no clean record holds costs as much as eight ordinary ones."""
        got = self.memo.get(word)
        if got is None:
            s = "^" + self.key(word) + "$"
            got = sum(max(-24.0, math.log(self.chance(s[max(0, i - ORDER + 1) : i + 1]))) for i in range(1, len(s)))
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[word] = got
        return got


def chains(word: str, known: Callable[[str], bool] | None = None) -> list[tuple[str, str]]:
    """(name, result) of every encode-decode chain that ``word`` can have come through.

    All these encodings agree on ASCII, so only the other characters are looked at. With ``known``, results are
    left out in which one of the characters that replace these isn't known.
    """
    odd = [c for c in dict.fromkeys(word) if not c.isascii()]
    out: list[tuple[str, str]] = []
    seen = {word}
    fine = known or (lambda text: True)
    for y in READ:
        table = ENCODE[y]
        raw = [table.get(c, -1) for c in odd]
        if min(raw, default=0) < 0:
            continue
        if max(raw, default=0) >= 0xC2:  # else it is no UTF-8
            try:
                fixed = bytes([table[c] for c in word]).decode()
            except UnicodeDecodeError:
                fixed = word
            if fixed not in seen:
                seen.add(fixed)
                if fine(fixed):
                    out.append((f"utf-8<{y}", fixed))
                if not fixed.isascii():
                    out += [(f"{name}<{y}", again) for name, again in chains(fixed, known) if name.startswith("utf-8")]
        if y not in CYRILLIC:
            for x, letters in DECODE.items():
                if x != y and fine(new := "".join([letters[b] for b in raw])):
                    fixed = word.translate(dict(zip(map(ord, odd), new)))
                    if fixed not in seen:
                        seen.add(fixed)
                        out.append((f"{x}<{y}", fixed))
    return out


class Repairer:
    """Decisions for words and records by a model and its margins."""

    def __init__(self, model: NGrams, margin: float = 0.0, alone: float = 0.0, filled: float = -2.6):
        self.model, self.margin, self.alone, self.filled = model, margin, alone, filled
        self.memo: dict[str, tuple[float, str, str]] = {}

    def known(self, text: str) -> bool:
        """Whether clean records hold every character of ``text``."""
        return all(c in self.model.counts for c in self.model.key(text))

    def best(self, word: str) -> tuple[float, str, str]:
        """Gain in log-likelihood, chain and result of the likeliest chain; gain 0 if the word is likeliest as it stands."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[word] = self._best(word)
        return got

    def _best(self, word: str) -> tuple[float, str, str]:
        score = self.model.score
        core = word.rstrip("?!.,;:)“”\"'")
        if LOST in word or "?" in core:
            return self.lost(core, word)
        if word.isascii():
            return 0.0, "", word
        gain, name, fixed = 0.0, "", word
        options = chains(word, self.known)
        base = score(word) if options else 0.0
        for n, f in options:
            more = score(f) - base
            # the model knows no case; of equal results the one without a capital within the word
            if (more > gain + 1e-9 or more > gain - 1e-9 and CAPITAL.search(fixed) and not CAPITAL.search(f)) and self.known(f):
                gain, name, fixed = more, n, f
        return gain, name, fixed

    def lost(self, core: str, word: str) -> tuple[float, str, str]:
        if LOST in word:
            return 99.0, "lost", word
        if "/" in core or "=" in core or "&" in core or not re.search(r"[^\W\d_]", core):
            return 0.0, "", word
        if "?" not in core:
            return 0.0, "", word
        best = self.fill(core)
        # the filled word has to look like a word, not just better than one with a hole
        return (best - self.model.score(core), "lost", word) if best / len(core) > self.filled else (0.0, "", word)

    def fill(self, core: str) -> float:
        """Log-likelihood of a word whose question marks are filled with the likeliest letters beyond ASCII."""
        beam = [("^", 0.0)]
        for c in self.model.key(core):
            options = ALPHABET[26:] if c == "?" else c
            beam = sorted(((b + o, v + math.log(self.model.chance((b + o)[-ORDER:]))) for b, v in beam for o in options), key=lambda x: -x[1])[:4]
        return beam[0][1]

    def words(self, line: str) -> list[tuple[int, int, float, str, str]]:
        """Accepted words of a line: (start, end, gain, chain, result)."""
        all_ = [(m.start(), m.end(), *self.best(m[0]), m[0]) for m in re.finditer(SPLIT, line) if not m[0].isascii() or "?" in m[0][:-1]]
        hits = [i for i, w in enumerate(all_) if w[2] > self.margin and w[3]]
        out = []
        for i in hits:
            _, _, gain, chain, _, word = all_[i]
            simple = "<" in chain and not chain.startswith("utf-8")
            if simple and gain < 4 * self.alone:
                y, x = chain.split("<")[1], chain.split("<")[0]
                near = [all_[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(all_)]
                support = sum(w[3] == chain and w[2] > self.margin for w in near)
                # a neighbour holds against the chain if it can't be read through it, or would be spoilt by it
                against = 0
                for w in near:
                    if w[3] != chain:
                        table = ENCODE[y]
                        if any(c not in table for c in w[5]):
                            against += 1
                        else:
                            f = "".join(DECODE[x][table[c]] for c in w[5])
                            against += f != w[5] and self.model.score(f) < self.model.score(w[5]) - 2
                if against > support or (not support and gain < self.alone):
                    continue
            out.append((*all_[i][:5],))
        return out

    def suspect(self, value: str) -> bool:
        """Whether any word is likelier read otherwise; most values have none, and need no look at lines and neighbours."""
        for w in set(value.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")):
            if not w.isascii() or "?" in w:
                for part in (w,) if len(w) <= LONGEST else re.findall(SPLIT, w):
                    if self.best(part)[0] > self.margin:
                        return True
        return False

    def garbled(self, value: str | None) -> bool:
        if not value or not self.suspect(value):
            return False
        return any(self.words(line) for line in value.split("\n") if line)

    def restored(self, value: str | None) -> str | None:
        """``value`` with its garbled words read as they were written.

        What accepted words have in common says how the passage was spoilt: in a line with such a word, or in a
        value with two, every other word is read through the same chain if that is likelier than the word as it stands.
        """
        if not value or not self.suspect(value):
            return value
        lines = value.split("\n")
        accepted = [self.words(line) for line in lines]
        count = lambda rows: Counter(w[3] for w in rows if "<" in w[3]).most_common(1)
        whole = [c for c, n in count([w for own in accepted for w in own]) if n > 1]
        out = []
        for line, own in zip(lines, accepted):
            chain = next(iter([c for c, _ in count(own)] + whole), None)
            fixed = {w[0]: w[4] for w in own}
            at, parts = 0, []
            for m in re.finditer(SPLIT, line):
                word, new = m[0], fixed.get(m.start(), m[0])
                if chain and not word.isascii() and (again := read_through(chain, word)) not in (None, word, new) and self.known(again):
                    # near ties go to the passage's chain
                    least = self.model.score(new) - (3.0 if m.start() in fixed else 0.0)
                    new = again if self.model.score(again) > least else new
                if new != word:
                    parts += [line[at : m.start()], new]
                    at = m.end()
            out.append("".join(parts) + line[at:])
        return "\n".join(out)


def read_through(chain: str, word: str) -> str | None:
    """``word`` through a chain by its name, as ``chains`` gives it; None if it can't have come through."""
    x, *ys = chain.split("<")
    try:
        for y in reversed(ys[1:]):
            word = bytes([ENCODE[y][c] for c in word]).decode()
        raw = bytes([ENCODE[ys[0]][c] for c in word])
        return raw.decode() if x == "utf-8" else "".join([DECODE[x][b] for b in raw])
    except (KeyError, UnicodeDecodeError):
        return None


def rare(word: str) -> str:
    """``word`` with a rare letter in one place."""
    h = zlib.crc32(word.encode())
    at = h % len(word)
    return word[:at] + RARE[h // 256 % len(RARE)] + word[at + 1 :]


def _alarms(fixer: Repairer, word: str) -> list[float]:
    """Gains of a clean word and, if it has no accents, of it with a rare letter: names and loan words must not be mistaken for garbled ones either."""
    return [fixer.best(rare(word) if word.isascii() else word)[0]] + ([fixer.best(rare(word))[0]] if not word.isascii() and word.isalpha() and len(word) > 3 else [])


def _caught(fixer: Repairer, word: str) -> list[float]:
    """Gains of a clean word put through wrong decodings."""
    out = []
    for x, y in (("utf-8", "cp1250"), ("cp1250", "cp1252"), ("cp852", "cp1250"), ("cp1250", "cp852")):
        g = word.encode(x, "replace").decode(y, "replace")
        if g != word and LOST not in g:
            out.append(fixer.best(g)[0])
    return out


def _filled(fixer: Repairer, word: str) -> list[float]:
    """Log-likelihood a letter of a clean word whose accented letters are lost and filled in."""
    core = word.strip("?!.,;:()„“”\"'")
    return [fixer.fill("".join(c if c.isascii() else "?" for c in core)) / len(core)] if core.isalpha() and len(core) > 3 else []


def _tally(words: DataFrame, shared, of: Callable[[Repairer, str], list[float]]) -> list[tuple[float, int]]:
    """(value, weight), least first, of what ``of`` gives for every word of ``words`` (word, n): in thousandths, so that their number is bounded."""

    def run(batches):
        fixer, counts = shared.value, Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for value in of(fixer, word):
                    counts[round(value * 1000)] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["v", "n"])

    rows = spread(words.select("word", "n")).mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()
    return sorted((r.v / 1000, r.n) for r in rows)


def _quantile(values: list[tuple[float, int]], share: float, none: float) -> float:
    """The value that ``share`` of the weight doesn't exceed; ``none`` if there are no values."""
    most, sum_ = share * sum(n for _, n in values), 0
    for value, n in values:
        sum_ += n
        if sum_ > most:
            return value
    return none


def train(pages: DataFrame, columns: tuple[str, ...] = ("text", "title"), ngrams: int | None = None, floor: float = 6.0) -> Repairer:
    """Model of the clean values of ``columns``, over all rows, with margins validated on all clean words, as often as each occurs.

    ``floor`` is the least margin, in units of log-likelihood, however quiet the validation words are. The model holds every n-gram,
    at some 250 bytes each in a worker; ``ngrams`` bounds it to the most frequent ones where memory is short, with a warning.
    """
    counts = cut(count_words(pages, list(columns), SPLIT, CLEAN))
    kept = count_ngrams(counts).toArrow() if ngrams is None else most_frequent_table(count_ngrams(counts), ngrams, key="g")
    model = NGrams(dict(zip(kept["g"].to_pylist(), kept["n"].to_pylist())))
    del kept
    fixer = Repairer(model)
    shared = _shared(pages.sparkSession, fixer)
    words = counts.where(~F.col("word").rlike(r"\?(?![?!.,;:)“”\"']*$)"))
    accented = words.where(F.col("word").rlike("[^\\x00-\\x7f]"))
    # Above nearly every clean word, yet below nineteen in twenty garbled ones where that leaves a choice.
    quiet = _quantile(_tally(accented.unionByName(words.where(F.col("word").rlike("^[A-Za-z]{4,}$"))), shared, _alarms), 0.98, 0.0)
    fixer.margin = floor
    if quiet + 1.0 > floor:  # else it is the floor, whatever is heard
        fixer.margin = max(floor, min(quiet + 1.0, 0.8 * _quantile(_tally(accented, shared, _caught), 0.05, 16.0)))
    fixer.alone = fixer.margin + 4.0
    # Below what all but two in a hundred words, frequent or rare, reach whose lost letters are filled in.
    fixer.filled = min(fixer.filled, _quantile(_tally(accented.withColumn("n", F.lit(1).cast("long")), shared, _filled), 0.02, 0.0))
    shared.destroy()
    return fixer


def _shared(spark: SparkSession, fixer: Repairer):
    return spark.sparkContext.broadcast(fixer)


#: Values that may be garbled: they hold a character beyond ASCII, or a question mark within a word.
SUSPECT = "[^\\x00-\\x7f]|\\?[^\\s?]"


def garbled_fields(pages: DataFrame, fixer: Repairer, key: str = "page_id", fields: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """``key``, field of the garbled values; one row per value and input row."""
    shared = _shared(pages.sparkSession, fixer)
    schema = T.StructType([pages.schema[key], T.StructField("field", T.StringType())])
    rows = pages.select(F.col(key), *(F.when(F.col(f).rlike(SUSPECT), F.col(f)).alias(f) for f in fields)).where(" OR ".join(f"`{f}` IS NOT NULL" for f in fields))

    def run(batches):
        fixer = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, names = [], []
                ids = part.column(0).to_pylist()
                for i, f in enumerate(fields):
                    for k, value in zip(ids, part.column(i + 1).to_pylist()):
                        if value and fixer.garbled(value):
                            keys.append(k)
                            names.append(f)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(names, pa.string())], names=[key, "field"])

    return spread(rows).mapInArrow(run, schema)


def restore(pages: DataFrame, fixer: Repairer, fields: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """``pages`` with the original text of garbled ``fields`` where it is still there; other columns as they are."""
    shared = _shared(pages.sparkSession, fixer)

    def run(batches):
        fixer = shared.value
        for batch in batches:
            for f in fields:
                i = batch.schema.get_field_index(f)
                batch = batch.set_column(i, batch.schema.field(i), pa.array([fixer.restored(v) for v in batch.column(i).to_pylist()], batch.schema.field(i).type))
            yield batch

    return spread(pages).mapInArrow(run, pages.schema)
