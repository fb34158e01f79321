"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

STEM = 6
SPACE = r"[ \t\r\n\x0b\f]"
# Function words that tell Czech from English questions.
CS_WORDS = [
    "co", "je", "jak", "jake", "jaké", "jaky", "jaký", "jsou", "se", "na", "pro", "podle", "proc", "proč", "kdo", "kdy", "kde", "ktery", "který", "ktere", "které", "stavba", "stavby", "staveb",
    "staveniste", "staveniště", "prace", "práce", "musi", "musí", "lze", "nebo", "mezi", "pri", "při", "do", "od", "za", "ze", "ve", "v", "a", "i", "u", "k", "s", "z", "o",
]
EN_WORDS = ["what", "how", "which", "who", "when", "where", "why", "is", "are", "the", "of", "and", "for", "to", "in", "on", "a", "an", "does", "do"]
CS_LETTERS = "ěščřžýáíéůúďťňĚŠČŘŽÝÁÍÉŮÚĎŤŇ"


def _folds() -> tuple[str, str]:
    """Letters that are a base letter with marks, and the base letters."""
    source, target = [], []
    for c in [*range(0xC0, 0x250), *range(0x386, 0x530), *range(0x1E00, 0x2000)]:
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != chr(c):
            source.append(chr(c))
            target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _folds()


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    """Without diacritics; letters that are no base letter with a mark stay (ß, ø, ł)."""
    return F.regexp_replace(F.translate(c(x), FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def strip(x: Column | str) -> Column:
    return F.regexp_replace(c(x), rf"^{SPACE}+|{SPACE}+$", "")


def stem(x: Column | str) -> Column:
    return F.substring(c(x), 1, STEM)


# Fixed value: a word is letters, numbers and underscores; a run of five digits or more alone is none. The pattern
# looks behind it, so that a long number isn't taken from its second digit on.
TERM = r"(?<![\p{L}\p{N}_])(?!\p{Nd}{5,}+(?![\p{L}\p{N}_]))[\p{L}\p{N}_]++"


def words(x: Column | str) -> Column:
    """Folded words in order."""
    return F.regexp_extract_all(F.translate(F.lower(c(x)), FOLD_FROM, FOLD_TO), F.lit(TERM), F.lit(0))


def forms(word: Column) -> Column:
    """A word, and its prefix if it is longer than that."""
    return F.when(F.length(word) > STEM, F.array(word, stem(word))).otherwise(F.array(word))


def tokenize(x: Column | str) -> Column:
    """Folded words in order, each followed by its prefix if it is longer than the prefix.

    Marks that stand alone part words, so folding single letters before the words are taken is the same as
    folding each word, and cheaper: one pass over the text.
    """
    return F.flatten(F.transform(words(x), forms))


def guess_lang(x: Column | str) -> Column:
    """cs if a Czech letter occurs or Czech function words outnumber the English ones, else en."""
    words = F.transform(F.split(F.lower(c(x)), rf"{SPACE}+"), lambda w: F.regexp_replace(w, r"""^[?.,!:;()"']+|[?.,!:;()"']+$""", ""))
    count = lambda of: F.size(F.filter(words, lambda w: w.isin(of)))
    return F.when(c(x).rlike(f"[{CS_LETTERS}]"), "cs").when(count(CS_WORDS) > count(EN_WORDS), "cs").otherwise("en")


def sentences(x: Column | str) -> Column:
    """A break is white space after . ! ? and before A-Z, a digit or a code point from Á to Ž."""
    return F.split(c(x), rf"(?<=[.!?]){SPACE}+(?=[A-ZÁ-Ž0-9])")


def paragraphs(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(c(x), rf"\n{SPACE}*\n"), strip), lambda p: p != "")


def clean_pdf_text(x: Column | str) -> Column:
    """Hyphens at line ends removed, wrapped lines joined, a blank line between paragraphs."""
    t = F.regexp_replace(F.replace(c(x), F.lit(" "), F.lit(" ")), r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    one = lambda p: strip(F.regexp_replace(F.regexp_replace(p, rf"{SPACE}*\n{SPACE}*", " "), r"[ \t]+", " "))
    return F.array_join(F.filter(F.transform(F.split(t, rf"\n{SPACE}*\n"), one), lambda p: p != ""), "\n\n")


def rejoin_hyphens(x: Column | str) -> Column:
    """'Není- li' to 'Není-li'."""
    return F.regexp_replace(c(x), r"([\p{L}\p{N}_])- (?=[a-záčďéěíňóřšťúůýž])", "$1-")


# Fixed value: characters of a broken text layer.
BROKEN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}\x{2303}\x{270F}]"


def broken_ratio(x: Column | str) -> Column:
    """Share of characters that no healthy text layer holds; 0 for an empty text."""
    n = F.length(c(x))
    return F.when(n > 0, (n - F.length(F.regexp_replace(c(x), BROKEN, ""))) / n).otherwise(F.lit(0.0))


# Fixed value: a numbered heading line.
HEADING = r"^(\d{1,2}(?:\.\d{1,2}){0,2})[ \t]+([A-ZÁ-Ž][^\n]{2,90})$"


def headings_in(x: Column | str) -> Column:
    """Numbered heading lines as (number, line)."""
    lines = F.transform(F.split(c(x), "\n"), strip)
    good = F.filter(lines, lambda s: s.rlike(HEADING) & ~s.rlike("[.,;]$"))
    return F.transform(good, lambda s: F.struct(F.regexp_extract(s, HEADING, 1).alias("number"), s.alias("line")))


def section_number(x: Column | str, anchored: bool = False) -> Column:
    """The first n.n or n.n.n; null if there is none."""
    found = F.regexp_extract(c(x), r"^\s*(\d{1,2}\.\d{1,2}(?:\.\d{1,2})?)\b" if anchored else r"\b(\d{1,2}\.\d{1,2}(?:\.\d+)?)\b", 1)
    return F.when(found != "", found)


# Titles that say nothing, and titles of figures and tables.
GENERIC = r"(?i)^\s*(kapitola|chapter|část|part|podkapitola|subchapter|untitled|obsah|contents)?\s*[\d.\s-]*\s*$"
FIGURE = r"(?i)^\s*(obr[aá]zek|obr\.|figure|figere|fig\.|foto|photo|tabulka|table)\b"


def is_generic_title(x: Column | str) -> Column:
    return F.coalesce(c(x).rlike(GENERIC), F.lit(True))


def is_figure_title(x: Column | str) -> Column:
    return F.coalesce(c(x).rlike(FIGURE), F.lit(False))


def best_title(body_title: Column | str, title: Column | str, headings: Column | str, text: Column | str, name: Column | str) -> Column:
    """Body title, title, first telling heading, first telling line, else whatever is there, else the file name."""
    first = lambda a: F.when(F.size(a) > 0, F.element_at(a, 1))
    own = lambda x: F.when(~is_generic_title(strip(x)), strip(x))
    lines = F.transform(F.split(c(text), "\n"), lambda s: F.regexp_replace(s, r"^[ |]+|[ |]+$", ""))
    some = F.coalesce(
        own(body_title), own(title), F.substring(first(F.filter(c(headings), lambda h: ~is_generic_title(h))), 1, 120),
        F.substring(first(F.filter(lines, lambda s: (F.length(s) > 3) & ~is_generic_title(s))), 1, 120), F.nullif(strip(body_title), F.lit("")), F.nullif(strip(title), F.lit("")), c(name),
    )
    return strip(F.regexp_replace(some, rf"{SPACE}+", " "))


def chapter_section(url: Column | str, title: Column | str, body_title: Column | str) -> Column:
    """struct(chapter, section): the printed section number, else the folder, else the file name's digits."""
    name = F.regexp_extract(c(url), r"([^/?#]*)(?:[?#].*)?$", 1)
    printed = F.coalesce(section_number(body_title), section_number(title))
    folder = F.nullif(F.regexp_extract(c(url), r"/kap(\d+)/", 1), F.lit("")).cast("int")
    digits = F.nullif(F.regexp_extract(name, r"(?i)^(?:text|o|obsah|liter)(\d+)", 1), F.lit(""))
    two = F.substring(digits, 1, 2).cast("int")
    by_name = F.when((F.length(digits) == 1) | (two > 13), F.substring(digits, 1, 1).cast("int")).otherwise(two)
    chapter = F.coalesce(F.substring_index(printed, ".", 1).cast("int"), folder, by_name)
    rest = F.substr(digits, F.length(chapter.cast("string")) + 1, F.lit(1000))
    by_digits = F.when(chapter.isNotNull() & name.rlike("(?i)^text") & (rest != ""), F.concat(chapter.cast("string"), F.lit("."), rest))
    return F.struct(chapter.alias("chapter"), F.coalesce(printed, by_digits).alias("section"))


def split_key(x: Column | str) -> Column:
    """'backend:model' at the first colon; a model may hold more."""
    return F.struct(F.substring_index(c(x), ":", 1).alias("backend"), F.when(F.instr(c(x), ":") > 0, F.substr(c(x), F.instr(c(x), ":") + 1, F.lit(1000))).otherwise(F.lit("")).alias("model"))


def escape_html(x: Column | str) -> Column:
    out = c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
