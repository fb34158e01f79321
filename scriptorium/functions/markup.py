"""Answers in light markup as HTML: paragraphs, lists, headings, code, emphasis and citations."""

from __future__ import annotations

import html as escape_
import re
from collections.abc import Iterator
from itertools import groupby

# What the marks of the markup look like.
CITED = re.compile(r"\[(\d+(?:\s*[,;]\s*\d+)*)\]")
BULLET, NUMBERED, HEADING = re.compile(r"\s*[-*•]\s+"), re.compile(r"\s*\d+[.)]\s+"), re.compile(r"#{1,4}\s+")
SPANS = ((re.compile(r"`([^`]+)`"), "code"), (re.compile(r"\*\*([^*]+)\*\*"), "strong"), (re.compile(r"(?<![^\s(])\*([^*\n]+)\*(?![^\s).,;:])"), "em"))


def link(n: int, sources: dict[int, dict]) -> str:
    """A citation; one without a source stays text."""
    if n not in sources:
        return f"[{n}]"
    of = sources[n]
    attributes = {"class": "cite", "href": of.get("url") or "#", "target": "_blank", "rel": "noopener", "title": of.get("title") or ""}
    return "<a {}>[{}]</a>".format(" ".join(f'{k}="{escape_.escape(v)}"' for k, v in attributes.items()), n)


def line(text: str, sources: dict[int, dict]) -> str:
    out = escape_.escape(text)
    for pattern, tag in SPANS:
        out = pattern.sub(rf"<{tag}>\1</{tag}>", out)
    return CITED.sub(lambda m: "".join(link(int(n), sources) for n in re.findall(r"\d+", m[1])), out)


def kind(text: str) -> tuple[str, re.Match | None]:
    for name, mark in (("ul", BULLET), ("ol", NUMBERED)):
        if m := mark.match(text):
            return name, m
    return "p", None


def blocks(text: str) -> Iterator[list[str]]:
    """Lines between blank lines."""
    for filled, own in groupby(text.replace("\r", "").split("\n"), key=lambda x: bool(x.strip())):
        if filled:
            yield list(own)


def html(text: str, sources: dict[int, dict]) -> str:
    """``sources`` by number. A numbered list stands alone in its block; bullets may stand within prose."""
    out = []
    for own in blocks(text):
        kinds = [kind(x) for x in own]
        if len(own) == 1 and HEADING.match(own[0]):
            out.append(f"<h4>{line(HEADING.sub('', own[0], count=1), sources)}</h4>")
            continue
        if any(k == "ol" for k, _ in kinds) and not all(k == "ol" for k, _ in kinds):
            kinds = [("p", None) if k == "ol" else (k, m) for k, m in kinds]
        for tag, rows in groupby(zip(own, kinds), key=lambda x: x[1][0]):
            made = [line(x[m.end() :] if m else x, sources) for x, (_, m) in rows]
            out.append("".join(f"<p>{x}</p>" for x in made) if tag == "p" else f"<{tag}>" + "".join(f"<li>{x}</li>" for x in made) + f"</{tag}>")
    return "".join(out)
