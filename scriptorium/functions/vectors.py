"""Vector and ranking arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c

EPSILON = 1e-9


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column | str) -> Column:
    n = norm(v)
    return F.transform(c(v), lambda x: x.cast("double") / (n + EPSILON))


def rrf_term(rank: Column | str, k: int = 60) -> Column:
    """Part of a reciprocal-rank fusion for a rank that counts from 0; null gives 0."""
    return F.coalesce(1.0 / (F.lit(k + 1) + c(rank)), F.lit(0.0))


def sigmoid(d: Column | str) -> Column:
    return F.when(c(d) > -700, 1.0 / (1.0 + F.exp(-c(d)))).otherwise(F.lit(0.0))


def log_sum_exp(values: Column | str, absent: float = -30.0) -> Column:
    top = F.array_max(c(values))
    return F.when(F.size(c(values)) > 0, top + F.log(F.aggregate(c(values), F.lit(0.0), lambda s, x: s + F.exp(x - top)))).otherwise(F.lit(absent))


def yes_chance(logprobs: Column | str) -> Column:
    """P(yes) of (token, logprob) structs: sigmoid of the log-sum-exp of 'yes' forms minus that of 'no' forms."""
    of = lambda word: F.transform(F.filter(c(logprobs), lambda t: F.lower(F.trim(t["token"])) == word), lambda t: t["logprob"])
    return sigmoid(log_sum_exp(of("yes")) - log_sum_exp(of("no")))


def clamp(x: Column | str, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(c(x), F.lit(high)))
