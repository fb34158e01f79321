"""URL predicates and parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c

# Names of navigation pages, and of images that are decoration.
CHROME = r"(?i)^(frame\d+|nadpis\d+\w*|index|mapa_stranek|default|obsah\d+\w*|obrazky\d*|nahledy\d*|foto\d+\w*)\.html?$"
DECORATIVE = r"(?i)sipka|logo|spacer|blank"
#: The folder of an edition; which hosts and folders are in scope is a parameter.
SCOPE = r"^https://ucebnice\.example/podklady/(online-priprava(?:-en)?(?:-demo)?)/"


# Fixed value: how raw HTML names what a crawler follows.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?([^"'\s>]+)"""
# Beginnings of references that lead to no page.
NO_PAGE = ("mailto:", "javascript:", "#", "data:")


def in_scope(url: Column | str, scope: str = SCOPE) -> Column:
    return c(url).rlike(scope)


def edition_key(url: Column | str, scope: str = SCOPE) -> Column:
    return F.nullif(F.regexp_extract(c(url), scope, 1), F.lit(""))


def fetchable(url: Column | str) -> Column:
    return F.lower(c(url)).rlike(r"(\.html?|\.txt|/)$")


def is_link(raw: Column | str) -> Column:
    return (c(raw) != "") & ~c(raw).rlike("^(" + "|".join(NO_PAGE) + ")")


def without_fragment(url: Column | str) -> Column:
    return F.substring_index(c(url), "#", 1)


def file_name(url: Column | str) -> Column:
    return F.regexp_extract(without_fragment(url), r"([^/?]*)(?:\?.*)?$", 1)


def is_chrome(url: Column | str) -> Column:
    return file_name(url).rlike(CHROME)


def content_images(images: Column | str) -> Column:
    """Distinct content images, sorted."""
    return F.array_sort(F.array_distinct(F.filter(c(images), lambda x: (x != "") & ~x.rlike(DECORATIVE))))
