"""Word counts over whole tables, the base of several models."""

from __future__ import annotations

import re
import warnings
from collections import Counter, namedtuple
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut, spread


#: Distinct words that a task holds before it passes their counts on.
KEPT = 400_000


def count_words(df: DataFrame, columns: list[str], split: str, texts: str | None = None) -> DataFrame:
    """word, n over all values of ``columns``: pieces that the pattern ``split`` finds.

    Values that don't match the Java pattern ``texts`` are left out. Counts are combined within each task
    before the shuffle, so what moves grows with the vocabulary and not with the text.
    """
    values = [F.when(F.col(c).rlike(texts), F.col(c)).alias(f"_{i}") if texts else F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]

    def run(batches):
        find = re.compile(split).findall
        counts: Counter = Counter()
        for batch in batches:
            for column in batch.columns:
                for at in range(0, len(column), 500):
                    for value in column.slice(at, 500).to_pylist():
                        if value:
                            counts.update(find(value))
            if len(counts) > KEPT:  # counts so far go on; they are added up later
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return spread(df.select(*values)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def sampled(rows: DataFrame, order: Column, n: int, total: int) -> DataFrame:
    """The first ``n`` rows in the order of a hash, for fitting a model on a bounded sample.

    Of a table of ``total`` rows only the share of hashes that holds about three times ``n`` is sorted, so
    what tasks send doesn't grow with their number.
    """
    share = min(1.0, 3.0 * n / max(1, total))
    top = F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)
    return rows.withColumn("_hash", order).where(F.col("_hash") <= top).orderBy("_hash").limit(n).drop("_hash")


def most_frequent(counts: DataFrame, most: int, n: str = "n", key: str | tuple[str, ...] = "word") -> list[NamedTuple]:
    """Rows of ``most_frequent_table``."""
    table = most_frequent_table(counts, most, n, key)
    row = namedtuple("Row", table.column_names)
    return list(map(row._make, zip(*(c.to_pylist() for c in table.columns))))


def most_frequent_table(counts: DataFrame, most: int, n: str = "n", key: str | tuple[str, ...] = "word") -> pa.Table:
    """The ``most`` rows with the highest counts (all, if there are no more), by (count, hash of ``key``), without a sort.

    A histogram of the counts, exact below 64 and in steps of a 32nd of a power of two above, says at which
    class the bound is reached. Of that class the share that still fits is taken by the hash of the key, so
    neither many equal counts nor one large class leaves less than there is room for. Only what is kept is
    fetched; a sorted limit would have every task send ``most`` rows. A bound that is hit is reported as a warning.
    """
    counts = cut(counts)
    keys = (key,) if isinstance(key, str) else key
    step = F.when(F.col(n) < 64, F.col(n).cast("long")).otherwise(F.floor(F.log2(F.col(n).cast("double")) * 32).cast("long") + 64)
    sizes = {r.p: r.c for r in counts.groupBy(step.alias("p")).agg(F.count("*").alias("c")).collect()}  # some 2,000 rows at most
    room, share, last = most, 1.0, None
    for p in sorted(sizes, reverse=True):
        if sizes[p] > room:
            last, share = p, (room + 4 * room**0.5 + 16) / sizes[p]  # hashes fall by chance; what is too much is cut off below
            break
        room -= sizes[p]
    if last is None:
        return counts.toArrow()
    warnings.warn(f"{sum(sizes.values())} rows of counts, of which the model keeps {most}", stacklevel=2)
    top = F.lit(max(-(2**63), min(2**63 - 1, int(-(2**63) + share * 2**64))))
    rows = counts.withColumn("_p", step).withColumn("_h", F.xxhash64(*keys)).where((F.col("_p") > last) | (F.col("_p") == last) & (F.col("_h") < top)).toArrow()
    return rows.sort_by([("_p", "descending"), ("_h", "ascending")]).slice(0, most).drop_columns(["_p", "_h"])
