"""Noise in text from scanned pages (problem 2).

Averaged perceptrons are trained on pages made from clean text. A line tagger, whose features are a line's
place on the page and its shape, tells body text from running heads and feet, page numbers, chapter headings
and figures of tables. A character editor predicts an operation for every character of a word: keep it (K),
replace it (R), replace it together with the next one, which is deleted (T and D), or replace it and insert
another after it (S). A character may have the operations that the editor was shown for it. A
judge looks at the likeliest readings that a beam over these operations gives and accepts one or none; whether
a vocabulary holds them is among its features. A joiner predicts for every line end that cuts a word whether
the parts are joined without the hyphen or keep it. The training pages are clean records of the same corpus,
wrapped, hyphenated and misread by the letter shapes below; the vocabulary is counted over all records.

Bounds, all parameters of ``train``: the perceptrons are fitted on at most ``sample`` clean pages and
``titles`` names of books, by hash order; the vocabulary holds the ``words`` most frequent words that occur
more than once (a warning says when there are more). Every scanned page is read, whole.

Results in special cases: pages of other content types, null and empty texts have no noisy line; a page of
fewer than three lines, or most of whose characters lie in lines of more than ``WRAPPED``, is no raw scan and
stays as it is; repeated rows give equal results.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import spread

from . import forms
from .words import count_words, most_frequent, sampled

#: Defaults: clean pages and names that the perceptrons are fitted on, words of the vocabulary.
SAMPLE, TITLES, WORDS = 1200, 300, 1_000_000
#: Length that a line of a scan doesn't pass.
WRAPPED = 110
#: Likeliest readings of a word that the judge looks at.
READINGS = 8
# What a scanner reads in place of a letter.
MISREAD = {
    "a": ("o",), "o": ("0",), "l": ("1",), "i": ("1",), "s": ("5",), "z": ("2",), "g": ("9",), "e": ("c",), "t": ("f",), "v": ("y",), "u": ("ii",), "m": ("rn",), "n": ("ri",), "d": ("cl",),
    "k": ("lc",), "h": ("li",), "w": ("vv",), "í": ("ì", "i"), "á": ("à",), "ě": ("ê",), "č": ("ë",), "ů": ("ü",), "ř": ("r'",), "ž": ("2", "z'"), "š": ("s'", "5"), "é": ("è",), "ý": ("ÿ",),
    "ú": ("ù",), "O": ("0",), "I": ("l", "1"), "S": ("5",), "B": ("8",), "Z": ("2",), "G": ("6",),
}
HYPHENS = "-‐¬­"
WORD = re.compile(r"[^\s]+")
CORE = re.compile(r"^[\W_]*(.*?)[\W_]*$", re.S)
LETTERS = r"[^\W\d_]+"
#: Compounds with a hyphen of their own.
COMPOUND = r"[^\W\d_]+(?:-[^\W\d_]+)+"
DIGIT = r"[\dOolIS]"
NUMBER = re.compile(rf"^\W*{DIGIT}*\d{DIGIT}*\W*$|^[ivxlcdm]+$|^[IVXLCDM]+$")
IN_WORDS = re.compile(rf"^\W*(?:[Ss]tran[ay]|[Pp]age|[Ss]tr|[Pp]|[Pp]g)\b\W*{DIGIT}+(?:\W+(?:z|of|ze)\W+{DIGIT}+)?\W*$")
PRINTED = re.compile(r"\((?:ed\.? ?\w+|\w+\.? ?(?:vyd|ed)\w*\.?|[^()]*vyd[^()]*)\)$")


class Perceptron:
    """Averaged perceptron over string features."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights: dict[str, dict[str, float]] = defaultdict(dict)
        self._total: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self._step = 0
        #: (feature, label) that went together at least once.
        self.shown: set[tuple[str, str]] = set()

    def scores(self, features: list[str], among: list[str] | None = None) -> dict[str, float]:
        out = dict.fromkeys(among or self.labels, 0.0)
        for f in features:
            for label, w in self.weights.get(f, {}).items():
                if label in out:
                    out[label] += w
        return out

    def best(self, features: list[str], among: list[str] | None = None) -> str:
        if among is None:  # labels that no feature speaks for or against score nought, and needn't be looked at if one is above
            out: dict[str, float] = {}
            for f in features:
                for label, w in self.weights.get(f, {}).items():
                    out[label] = out.get(label, 0.0) + w
            if out and (top := max(out.values())) > 0:
                return max((k for k, v in out.items() if v == top), key=lambda k: (k == "K", k))
        s = self.scores(features, among)
        return max(s, key=lambda k: (s[k], k == "K", k))

    def update(self, features: list[str], truth: str, among: list[str] | None = None) -> None:
        self._step += 1
        self.shown.update((f, truth) for f in features[:2])
        guess = self.best(features, among)
        if guess == truth:
            return
        for f in features:
            for label, d in ((truth, 1.0), (guess, -1.0)):
                w = self.weights[f].get(label, 0.0)
                self._total[f, label] += (self._step - self._at[f, label]) * w
                self._at[f, label] = self._step
                self.weights[f][label] = w + d

    def average(self) -> None:
        for f, own in self.weights.items():
            for label, w in own.items():
                own[label] = (self._total[f, label] + (self._step - self._at[f, label]) * w) / max(1, self._step)
        self.weights = {f: {k: w for k, w in own.items() if abs(w) > 1e-4} for f, own in self.weights.items()}
        self._total, self._at = {}, {}
        self.shown = {(f, label) for f, label in self.shown if label != "K"}


# --- lines


NO_LETTER = re.compile(r"[\W\d_]+")


def letter_pairs(text: str) -> dict[tuple[str, str], int]:
    """Counts of the pairs of letters of a text."""
    letters = NO_LETTER.sub("", text).lower()
    return Counter(zip(letters, letters[1:]))


#: Of names, which come up again for every line of a page.
name_pairs = functools.lru_cache(4096)(letter_pairs)


def overlap(line: dict[tuple[str, str], int], name: dict[tuple[str, str], int]) -> int:
    """0 to 3: how much of a line's letters a title holds, by pairs of letters; 0 for fewer than four letters."""
    total = sum(line.values())
    if total < 3 or not name:
        return 0
    share = sum(n if n < name[k] else name[k] for k, n in line.items() if k in name) / total
    return 3 if share > 0.85 else 2 if share > 0.7 else 1 if share > 0.5 else 0


def shape(line: str) -> str:
    s = line.strip()
    if IN_WORDS.match(s):
        return "words"
    if NUMBER.match(s):
        return "roman" if s.isalpha() else "bare" if s.isdigit() else "framed"
    if PRINTED.search(s):
        return "printed"
    if re.search(r"_{2,}$", s):
        return "ruled"
    if re.match(rf"^{DIGIT}{{1,4}} {{2,}}\S", s):
        return "number first"
    if re.search(rf"\S {{2,}}{DIGIT}{{1,4}}$", s):
        return "number last"
    if re.match(r"^\d{1,2}(\.\d+)* \w", s):
        return "numbered"
    return "text"


def line_features(lines: list[str], order: list[int], r: int, width: int, book: str, title: str) -> list[str]:
    """Place and shape of the ``r``-th line that isn't blank."""
    i = order[r]
    line = lines[i]
    s = line.strip()
    letters = [c for c in s if c.isalpha()]
    upper = sum(c.isupper() for c in letters) / max(1, len(letters))
    top, bottom = min(r, 3), min(len(order) - 1 - r, 3)
    kind = shape(line)
    before = i == 0 or not lines[i - 1].strip()
    after = i + 1 >= len(lines) or not lines[i + 1].strip()
    size = len(s) * 4 // max(1, width)
    end = "." if s[-1] in ".!?" else "," if s[-1] in ",;" else "-" if s[-1] in HYPHENS else "x"
    case = "U" if upper > 0.75 and len(letters) > 3 else "C" if s[:1].isupper() else "d" if s[:1].isdigit() else "l"
    near = "".join("n" if 0 <= r + d < len(order) and NUMBER.match(lines[order[r + d]].strip()) else "-" for d in (-1, 1))
    follow = lines[order[r + 1]].strip()[:1] if r + 1 < len(order) else ""
    next_ = "C" if follow.isupper() else "l" if follow.islower() else "d" if follow.isdigit() else "x"
    pairs = letter_pairs(s)
    named = max(overlap(pairs, name_pairs(book)), overlap(pairs, name_pairs(title)))
    place = f"t{top}" if top < 3 else f"b{bottom}" if bottom < 3 else "m"
    edge = "e" if place != "m" else "m"
    return [
        "bias", f"s={kind}", f"p={place}", f"s,p={kind},{place}", f"end,p={end},{place}", f"case,p={case},{place}", f"size,p={size},{place}", f"named={named},{edge}", f"near,s={near},{kind}",
        f"s,end,case,{edge}={kind},{end},{case}", f"ba={before}{after},{edge}", f"s,case,after={kind},{case},{after},{edge}", f"case,end,next={case},{end},{next_},{edge}", f"size,end,{place}={size},{end}",
        f"cepz={case},{end},{place},{min(size, 3)}", f"cepn={case},{end},{place},{next_}", f"cepzn={case},{end},{place},{min(size, 3)},{next_},{after}", f"kcp={kind},{case},{place},{end}",
        f"named,case,end={named},{case},{end},{edge}", f"s,near,{place}={kind},{near}", f"top0={top == 0},{kind},{after},{case}", f"full={len(s) >= width * 0.75},{place},{end}",
    ]


KINDS = ["body", "header", "page_number", "heading", "figure"]


class Reader:
    """Vocabulary and perceptrons, and what they make of a page."""

    def __init__(self, vocabulary: dict[str, int], compounds: set[str], lines: Perceptron, editor: Perceptron, joiner: Perceptron, judge: Perceptron | None = None):
        self.vocabulary, self.compounds, self.lines, self.editor, self.joiner, self.judge = vocabulary, compounds, lines, editor, joiner, judge
        self.firsts = first_parts(compounds)
        self.memo: dict[str, str | None] = {}
        #: Operations that the editor was shown for a character, and the characters that it saw deleted after which operation.
        self.options: dict[str, list[str]] = {}
        for f, op in sorted(editor.shown if editor else ()):
            if f.startswith("c=") and op not in "KD":
                self.options.setdefault(f[2:], []).append(op)
        self.deletes = {f for f, op in (editor.shown if editor else ()) if f.startswith("c,l=") and op == "D"}

    def known(self, word: str) -> bool:
        return self.vocabulary.get(word.lower(), 0) > 1

    # characters

    def fix(self, word: str) -> str | None:
        """The word as it was written, if it is misread; else None."""
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = self._fix(word)
        return self.memo[word]

    def _fix(self, word: str) -> str | None:
        if len(word) < 2 or self.known(word) or word.lower() in self.compounds or not re.search(LETTERS, word):
            return None
        if "-" in word:
            parts = word.split("-")
            fixed = [self.fix(p) for p in parts]
            return "-".join(f or p for f, p in zip(fixed, parts)) if any(fixed) else None
        return self.accepted(word)

    def accepted(self, word: str, hidden: str = "") -> str | None:
        """The reading that the judge accepts, if any; ``hidden`` is a word that counts as unknown."""
        best, most = None, 0.0
        for text, features in self.readings(word, hidden):
            s = self.judge.scores(features)
            if s["yes"] - s["no"] > most:
                best, most = text, s["yes"] - s["no"]
        return best

    def readings(self, word: str, hidden: str = "") -> list[tuple[str, list[str]]]:
        """The likeliest readings by the editor other than the word itself, those in the vocabulary first, with the judge's features."""
        own = [(t, e, m) for t, e, m in self.decode(word) if e and t != word]
        count = lambda t: 0 if t.lower() == hidden else self.vocabulary.get(t.lower(), 0)
        own = sorted(((count(t) < 2, i, t, e, m) for i, (t, e, m) in enumerate(own)))[:READINGS]
        return [(t, judge_features(word, t, count(t), e, m, i, n)) for n, (_, i, t, e, m) in enumerate(own)]

    def decode(self, word: str, width: int = 12) -> list[tuple[str, int, float]]:
        """Likeliest texts by the editor: (text, edits, score over the word as it is)."""
        beam = [("", 0, 0.0, "K")]
        for i, c in enumerate(word):
            new = []
            options = self.options.get(c, ())
            for text, edits, score, last in beam:
                s = self.editor.scores(char_features(word, i, last), ["K", "D", *options])
                keep = s["K"]
                if last[0] == "T":  # the second character of a letter that was read as two
                    if f"c,l={c},{last}" in self.deletes:
                        new.append((text, edits, score + s["D"] - keep, "D"))
                    continue
                new.append((text + c, edits, score, "K"))
                if edits < 3:
                    new += [(text + op[1:], edits + 1, score + s[op] - keep, op) for op in options if op[0] != "T" or i + 1 < len(word)]
            beam = sorted(new, key=lambda x: -x[2])[:width]
        return [(t, e, s) for t, e, s, _ in beam]

    # line ends

    def join(self, left: str, mark: str, right: str, spaced: bool) -> bool:
        """Whether the word at a line's end is broken there, rather than at its own hyphen."""
        return self.joiner.best(join_features(left, mark, right, spaced, self.vocabulary, self.compounds, self.firsts), ["J", "H"]) == "J"

    # pages

    def kinds(self, text: str, book: str, title: str) -> list[str] | None:
        """Kind of every line of a raw scan, 'blank' included; None for other pages."""
        lines = text.split("\n")
        order = [i for i, x in enumerate(lines) if x.strip()]
        sizes = [len(x.rstrip()) for x in lines]
        if len(order) < 3 or 2 * sum(n for n in sizes if n > WRAPPED) > sum(sizes):
            return None
        longest = max(n for n in sizes if n <= WRAPPED)
        out = ["blank"] * len(lines)
        for r, i in enumerate(order):
            f = line_features(lines, order, r, longest, book, title)
            out[i] = self.lines.best(f)
        return out

    def breaks(self, lines: list[str], kinds: list[str]) -> dict[int, tuple[bool, int]]:
        """Body lines that end in a hyphen: (broken word, line it goes on in, -1 if none)."""
        body = [i for i, k in enumerate(kinds) if k == "body"]
        out = {}
        for n, i in enumerate(body):
            line = lines[i].rstrip()
            if len(line) < 2 or line[-1] not in HYPHENS or not line[-2].isalpha():
                continue
            left = re.search(r"[^\s]+$", line[:-1])[0].lstrip("(„“\"'")
            then = body[n + 1] if n + 1 < len(body) else -1
            right = (re.match(r"[^\W\d_]+", lines[then].strip()) or [""])[0] if then >= 0 else ""
            out[i] = (self.join(left, line[-1], right, lines[i].rstrip("\r") != line), then)
        return out

    def noisy(self, text: str | None, book: str, title: str) -> list[tuple[int, str]]:
        """(line, kind) of every noisy line."""
        kinds = self.kinds(text, book, title) if text else None
        if not kinds:
            return []
        lines, out = text.split("\n"), []
        broken = self.breaks(lines, kinds)
        into = {then for _, then in broken.values() if then >= 0}
        for i, k in enumerate(kinds):
            if k in ("header", "page_number"):
                out.append((i, k))
            elif k in ("body", "heading"):
                if i in broken and broken[i][0]:
                    out.append((i, "hyphen"))
                words = [m[0] for m in WORD.finditer(lines[i])]
                whole = words[1 if i in into else 0 : len(words) - 1 if i in broken else len(words)]
                if any(self.fix(CORE.match(w)[1]) for w in whole):
                    out.append((i, "char"))
        return out

    def repaired(self, text: str | None, book: str, title: str) -> str | None:
        """Continuous paragraphs: furniture removed, lines joined, words mended."""
        kinds = self.kinds(text, book, title) if text else None
        if not kinds:
            return text
        lines = text.split("\n")
        broken = self.breaks(lines, kinds)
        longest = max(len(x) for x in lines if len(x.rstrip()) <= WRAPPED)
        paragraphs: list[str] = []
        now, glue = "", ""
        gap = False
        for i, k in enumerate(kinds):
            line = lines[i].strip()
            if k in ("header", "page_number"):
                continue
            if k == "blank":
                gap = True
                continue
            own = k in ("heading", "figure")
            # a paragraph ends at a blank line after a sentence, or at a short line that ends one
            if now and (own or (gap or len(lines[i - 1].strip()) < longest * 0.7) and now.rstrip()[-1:] in ".!?:" and line[:1].isupper()):
                paragraphs.append(now)
                now, glue = "", ""
            gap = False
            if i in broken:
                joined, _ = broken[i]
                line, next_glue = (line[:-1] if joined else line[:-1] + "-"), ""
            else:
                next_glue = " "
            now = now + glue + line if now else line
            glue = next_glue
            if own:
                paragraphs.append(now)
                now, glue = "", ""
        if now:
            paragraphs.append(now)

        def mend(m: re.Match) -> str:
            core = CORE.match(m[0])
            fixed = self.fix(core[1]) if core[1] else None
            return m[0][: core.start(1)] + fixed + m[0][core.end(1) :] if fixed else m[0]

        return "\n\n".join(WORD.sub(mend, p) for p in paragraphs)


#: Characters that Czech and English words don't have.
SIGNS = re.compile("[àìêëüèÿù']")


def judge_features(word: str, text: str, count: int, edits: int, margin: float, rank: int, nth: int) -> list[str]:
    """What speaks for a reading: the vocabulary, the kind of word, signs that no word has, and the editor's score."""
    level = 0 if count < 2 else 1 if count < 30 else 2
    plain = word.isalpha() and word.isascii()
    case = "C" if word[0].isupper() else "l"
    size = min(len(text), 6)
    letters = sum(x.isalpha() for x in word)
    form = "code" if re.fullmatch(r"[A-Z]{1,3}-?\d+|\d+[^\W\d_]{1,2}[²³]?|[ivxlcdm]+|\d+[²³]?|[^\W\d_]{1,2}[²³]", word) else "word"
    digit = "in" if re.search(r"[^\W\d_]\d+[^\W\d_]", word) else "edge" if re.search(r"[^\W\d_]\d|\d[^\W\d_]", word) else "no"
    sign = bool(SIGNS.search(word))
    left = bool(re.search("[àìêëüèÿù'\\d]", text))
    sure = 0 if margin <= -6 else 1 if margin <= 0 else 2 if margin <= 6 else 3
    return [
        "bias", f"v={level}", f"v,form={level},{form}", f"v,size={level},{size}", f"v,case,plain={level},{case},{plain}", f"v,case,plain,size={level},{case},{plain},{size}", f"digit,case={digit},{case}",
        f"v,digit,sign={level},{digit},{sign}", f"v,sure={level},{sure}", f"v,digit,sign,sure,left={level},{digit},{sign},{sure},{left}", f"edits={edits},{level}", f"rank={min(rank, 3)},{level}", f"nth={min(nth, 2)},{level}",
        f"left={left},{digit},{sign}", f"blind={level == 0 and digit == 'no' and not sign}", f"few={letters < 3},{level},{form}", f"v,form,digit,case={level},{form},{digit},{case}",
    ]


def char_features(word: str, i: int, last: str) -> list[str]:
    p = lambda k: word[k] if 0 <= k < len(word) else "^"
    c, a, b, x, y = word[i], p(i - 1), p(i - 2), p(i + 1), p(i + 2)
    shape_ = "".join("d" if z.isdigit() else "l" if z.isalpha() else "^" if z == "^" else "o" for z in (a, c, x))
    last_ = last[0]
    # the first two say which operations a character may have
    return [f"c={c}", f"c,l={c},{last}", f"ac={a}{c}", f"cx={c}{x}", f"acx={a}{c}{x}", f"bac={b}{a}{c}", f"cxy={c}{x}{y}", f"bacx={b}{a}{c}{x}", f"acxy={a}{c}{x}{y}", f"bacxy={b}{a}{c}{x}{y}", f"sh={shape_},{c}", f"up={c.isupper()},{i == 0},{c}", f"l={last_}"]


def first_parts(compounds: set[str]) -> set[str]:
    """What compounds begin with, up to and with each of their hyphens."""
    return {c[: i + 1] for c in compounds for i, x in enumerate(c) if x == "-"}


def join_features(left: str, mark: str, right: str, spaced: bool, vocabulary: dict[str, int], compounds: set[str], firsts: set[str]) -> list[str]:
    level = lambda n: 0 if n < 1 else 1 if n < 2 else 2 if n < 10 else 3
    last = left.split("-")[-1]
    whole, pair = level(vocabulary.get((last + right).lower(), 0)), (left + "-" + right).lower() in compounds
    a, b = level(vocabulary.get(last.lower(), 0)), level(vocabulary.get(right.lower(), 0))
    first = (left + "-").lower() in firsts
    return ["bias", f"w={whole}", f"pair={pair}", f"w,pair={whole},{pair}", f"a,b={a},{b}", f"mark={mark},{spaced}", f"w,a,b={whole},{a},{b}", f"first={first},{whole}", f"in={'-' in left}", f"up={right[:1].isupper()}"]


# --- training


#: Two letters that are read as one: the other way round.
MERGED = {shape: letter for letter, shapes in MISREAD.items() for shape in shapes if len(shape) == 2 and shape.isalpha()}


def misread(word: str, rng: random.Random) -> tuple[str, list[str]] | None:
    """The word with one or two letters misread, and the operation that mends each character of it."""
    spots = [(i, 1) for i, c in enumerate(word) if c in MISREAD]
    if not spots:
        return None
    chosen = dict(rng.sample(spots, min(len(spots), rng.choice((1, 1, 1, 2)))))
    pairs = [i for i in range(len(word) - 1) if word[i : i + 2] in MERGED]
    if pairs and rng.random() < 0.3:
        chosen = {rng.choice(pairs): 2}
    text, ops, i = "", [], 0
    while i < len(word):
        if chosen.get(i) == 2:
            text += MERGED[word[i : i + 2]]
            ops.append("S" + word[i : i + 2])
            i += 2
            continue
        if i in chosen:
            m = rng.choice(MISREAD[word[i]])
            text += m
            ops += ["R" + word[i]] if len(m) == 1 else ["T" + word[i], "D"]
        else:
            text += word[i]
            ops.append("K")
        i += 1
    return text, ops


def made_page(paragraphs: list[str], names: list[str], rng: random.Random) -> tuple[list[str], list[str], str, str]:
    """Lines, their kinds, book and title of a page like a scan."""
    book, title = rng.choice(names), rng.choice(names)
    width = rng.randint(46, 86)
    number = rng.randint(1, 380)
    roman = "".join(["c" * (number // 100), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")[number // 10 % 10], ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[number % 10]])
    cs = bool(re.search("[ěščřžýáíé]", " ".join(paragraphs)))
    page_line = rng.choice([str(number), f"[{number}]", f"- {number} -", f"— {number} —", roman, f"Strana {number} z {number + 90}" if cs else f"Page {number} of {number + 90}", f"str. {number}" if cs else f"p. {number}"])
    other = rng.choice(names)  # a chapter's name, which the record needn't give
    head = rng.choice([book, title, other, other])
    head = head if rng.random() < 0.5 else head.upper()
    style = rng.random()
    head = head + f"   {number}" if style < 0.25 else f"{number}   " + head if style < 0.45 else head + " " + "_" * rng.randint(3, 9) if style < 0.55 else head
    if rng.random() < 0.1:
        got = misread(head, rng)
        head = got[0] if got else head
    lines: list[str] = []
    kinds: list[str] = []
    add = lambda t, k: (lines.append(t), kinds.append(k))
    opening = rng.random() < 0.2
    if rng.random() < 0.3:
        add(page_line, "page_number")
        page_line = ""
    if opening:
        add(f"{rng.randint(1, 9)} {rng.choice([title, other])}", "heading")
        add("", "blank")
    elif rng.random() < 0.75:
        add(head, "header")
        if rng.random() < 0.5:
            add("", "blank")
    start, dash = len(lines), rng.choice("--‐¬")
    for k, p in enumerate(paragraphs):
        words, line = p.split(), ""
        for w in words:
            if len(line) + len(w) + 1 <= width:
                line = f"{line} {w}" if line else w
            elif len(w) > 6 and w.isalpha() and rng.random() < 0.35 and len(line) > 10:
                at = rng.randint(2, len(w) - 3)
                add(f"{line} {w[:at]}{dash}", "body")
                line = w[at:]
            else:
                if line:
                    add(line, "body")
                line = w
        if line:
            add(line, "body")
        if k + 1 < len(paragraphs):
            if rng.random() < 0.15:
                for _ in range(rng.randint(2, 5)):
                    add(str(rng.randint(10, 400)), "figure")
            if rng.random() < 0.6:
                add("", "blank")
    if rng.random() < 0.05:
        for _ in range(rng.randint(2, 4)):
            add(str(rng.randint(10, 400)), "figure")
    if rng.random() < 0.5:
        add("", "blank") if rng.random() < 0.4 else None
    if rng.random() < 0.25:
        add(f"{other} ({rng.randint(2, 9)}. vyd.)" if cs else f"{other} (ed. {rng.randint(2, 9)})", "header")
    if page_line and rng.random() < 0.6:
        add(page_line, "page_number")
    del start
    return lines, kinds, book, title


def train(pages: DataFrame, sample: int = SAMPLE, titles: int = TITLES, words: int = WORDS) -> Reader:
    """The reader of a corpus: vocabulary over all its records that are no scans, perceptrons on made pages."""
    rng = random.Random(17)
    sound = pages.where("content_type <> 'application/pdf'")
    counts = count_words(sound, ["text"], r"[^\W_]+(?:-[^\W\d_]+)*", "\\p{L}")
    top = sorted(most_frequent(counts.where("n > 1"), words), key=lambda r: (-r.n, r.word))
    vocabulary: dict[str, int] = defaultdict(int)
    for r in top:
        for part in r.word.split("-"):
            if part.isalpha():
                vocabulary[part.lower()] += r.n
    # Compounds stand in scans too; one that is seen whole several times is no accident.
    pairs = most_frequent(count_words(pages, ["text"], COMPOUND, "\\p{L}-\\p{L}").where("n > 2"), words)
    compounds = {r.word.lower() for r in pairs}
    for c in compounds:
        for part in c.split("-"):
            vocabulary[part] += 2
    rows = sampled(sound.where("length(text) > 300").select("text", "title"), F.xxhash64("text"), sample, pages.count()).collect()  # bounded
    books = [r.book for r in pages.where("book <> ''").select("book").distinct().orderBy(F.xxhash64("book")).limit(titles).collect()]
    clean = [[p.strip() for p in re.split(r"\s*\n\s*\n\s*", r.text) if len(p) > 40] for r in rows]
    clean = [c for c in clean if c and sum(map(str.isalpha, c[0])) > 20]
    names = [t for t in [*books, *(re.sub(r"^[\d.]+ ", "", r.title or "") for r in rows)] if len(t) > 5] or ["Title of a Book"]
    tagger = Perceptron(KINDS)
    made = [made_page(rng.choice(clean)[:6], names, rng) for _ in range(1600)] if clean else []
    described = []
    for lines, kinds, book, title in made:
        order = [i for i, x in enumerate(lines) if x.strip()]
        width = max(len(x) for x in lines)
        described.append([(line_features(lines, order, r, width, book, title), kinds[i], 3 <= r < len(order) - 3 and kinds[i] == "body") for r, i in enumerate(order)])
    for _ in range(4):
        rng.shuffle(described)
        for page in described:
            for features, kind, common in page:
                if not common or rng.random() >= 0.8:  # most lines are body in the middle
                    tagger.update(features, kind)
    tagger.average()
    # Words as often as they are used, flattened; names as well, which no vocabulary holds.
    frequent = [w for w in vocabulary if len(w) > 3]
    weights = [vocabulary[w] ** 0.5 for w in frequent]
    rare = [w for c in clean for p in c for w in re.findall(r"\b[A-Z][a-z]{5,}\b", p) if vocabulary.get(w.lower(), 0) < 3]
    labels = ["K", "D", *sorted({("R" if len(x) == 1 else "T") + c for c, shapes in MISREAD.items() for x in shapes} | {"S" + x for x in MERGED})]
    editor, joiner = Perceptron(labels), Perceptron(["J", "H"])
    drawn = rng.choices(frequent, weights, k=7000) + rng.choices(rare or frequent or ["word"], k=2000) if frequent else []
    for _ in range(2):
        rng.shuffle(drawn)
        for w in drawn:
            w = w.capitalize() if rng.random() < 0.15 else w
            got = misread(w, rng) if rng.random() < 0.8 else (w, ["K"] * len(w))
            if got:
                last = "K"
                for i, op in enumerate(got[1]):
                    editor.update(char_features(got[0], i, last), op)
                    last = op
    editor.average()
    whole, firsts = sorted(compounds), first_parts(compounds)
    for _ in range(6000):
        if rng.random() < 0.3 and whole:
            c = rng.choice(whole).split("-")
            k = rng.randint(1, len(c) - 1)
            left, right, truth = "-".join(c[:k]), c[k], "H"
        else:
            w = rng.choice(rare if rare and rng.random() < 0.4 else drawn) if drawn else "word"
            if rare and rng.random() < 0.08:
                joiner.update(join_features(w, "-", rng.choice(rare), False, vocabulary, compounds, firsts), "H", ["J", "H"])
            if len(w) < 5:
                continue
            at = rng.randint(2, len(w) - 2)
            left, right, truth = w[:at], w[at:], "J"
        joiner.update(join_features(left, rng.choice("---‐¬") if truth == "J" else "-", right, rng.random() < 0.2, vocabulary, compounds, firsts), truth, ["J", "H"])
    joiner.average()
    reader = Reader(dict(vocabulary), compounds, tagger, editor, joiner, Perceptron(["yes", "no"]))
    judged = judge_cases(reader, drawn, rare, [w for c in clean for p in c for w in re.findall(r"[^\W_]*\d[^\W_]*", p)], rng)
    for _ in range(6):
        rng.shuffle(judged)
        for features, good in judged:
            reader.judge.update(features, "yes" if good else "no")
    reader.judge.average()
    return reader


def judge_cases(reader: Reader, drawn: list[str], rare: list[str], codes: list[str], rng: random.Random, most: int = 1000) -> list[tuple[list[str], bool]]:
    """Readings of misread words, and of sound ones that the vocabulary is taken not to hold: names, rare words and codes.

    Most words that no vocabulary holds are sound, so there are more of these.
    """
    out: list[tuple[list[str], bool]] = []
    for w in rng.sample(drawn, min(most, len(drawn))):
        got = misread(w.capitalize() if rng.random() < 0.15 else w, rng)
        if got and not reader.known(got[0]):
            # a name without a sign that no word has, and that no record holds, might be sound as it stands
            known, odd = reader.vocabulary.get(w.lower(), 0) > 2, not got[0].isalpha() or SIGNS.search(got[0])
            out += [(f, t.lower() == w.lower() and bool(known or odd)) for t, f in reader.readings(got[0], "" if known else w.lower())]
    # Codes and measures as any text may have them, besides those of these records.
    letters, digits = "ABCDEFGHIJKLMNOPRSTUVWXYZ", "0123456789"
    some = lambda of, low, high: "".join(rng.choices(of, k=rng.randint(low, high)))
    codes = [*codes[:most], *(some(letters, 1, 3) + some(digits, 1, 4) for _ in range(most)), *(some(digits, 1, 4) + (some(letters.lower(), 1, 2) if rng.random() < 0.7 else some(letters, 1, 2)) for _ in range(most))]
    uncommon = [w for w, n in reader.vocabulary.items() if n < 4 and len(w) > 1]
    for words, n in ((rare, most), (uncommon, most // 2), (codes, most)):
        own = Counter(rng.choices(words, k=n)) if words else {}
        for w, times in own.items():
            out += [(f, False) for _, f in reader.readings(w, w.lower())] * times
    return out


def held_out(reader: Reader, words: list[str], rng: random.Random, times: int = 5) -> dict[str, tuple[int, int]]:
    """Per operation, how many words with a letter misread in that way are mended, of how many; 'K' are sound words left as they are."""
    out = {"K": (sum(reader.fix(w) is None for w in words), len(words))}
    for w in words * times:
        got = misread(w, rng)
        if got and not reader.known(got[0]):
            for kind in {op[0] for op in got[1]} - {"K", "D"}:
                hit, n = out.get(kind, (0, 0))
                out[kind] = (hit + (reader.fix(got[0]) == w), n + 1)
    return out


def _scans(pages: DataFrame) -> DataFrame:
    """Scanned pages in one form of characters; the line ends stay."""
    kept = pages.where("content_type = 'application/pdf' AND text IS NOT NULL").select("page_id", F.coalesce("book", F.lit("")).alias("book"), F.coalesce("title", F.lit("")).alias("title"), F.regexp_replace("text", "­([ \t]*\r?\n)", "-$1").alias("text"))
    return forms.unify(kept)


def noisy_lines(pages: DataFrame, reader: Reader) -> DataFrame:
    """page_id, line_no, kind of every noisy line of a scanned page; one row per line, kind and input row."""
    shared = pages.sparkSession.sparkContext.broadcast(reader)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids, numbers, kinds = [], [], []
                for k, book, title, text in zip(*(part.column(c).to_pylist() for c in ("page_id", "book", "title", "text"))):
                    for i, kind in shared.value.noisy(text, book, title):
                        ids.append(k)
                        numbers.append(i)
                        kinds.append(kind)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string())], names=["page_id", "line_no", "kind"])

    return spread(_scans(pages)).mapInArrow(run, "page_id long, line_no int, kind string")


def repair(pages: DataFrame, reader: Reader) -> DataFrame:
    """page_id, text of every scanned page in continuous paragraphs."""
    shared = pages.sparkSession.sparkContext.broadcast(reader)

    def run(batches):
        for batch in batches:
            texts = [shared.value.repaired(t, b, h) for b, h, t in zip(*(batch.column(c).to_pylist() for c in ("book", "title", "text")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    return spread(_scans(pages)).mapInArrow(run, "page_id long, text string")
