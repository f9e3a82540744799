"""Bounded deterministic samples of labelled rows; the bound is a parameter of every fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 30


def hashed(key: str) -> F.Column:
    """A number below _SPAN that follows from the key."""
    return F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(_SPAN))


def share_of(most: int, n: int) -> int:
    """Of n keys, about ``most`` have a hash below this."""
    return _SPAN if n <= most else int(_SPAN * most / n)


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows whose key hash lies below a bound that is set so that about ``most`` rows remain (all, if there are fewer).

    The choice depends on the key alone, so it is the same for any partitioning. Rows with a null key are left out.
    """
    known = df.where(F.col(key).isNotNull())
    n = known.count()
    if n <= most:
        return known
    return known.where(hashed(key) < share_of(most, n))


def texts_of(docs: DataFrame, sample: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, the sample's other columns, text) of a bounded sample's documents; of rows that repeat a doc_id, the least text.

    The sample has few enough rows to be sent to every task.
    """
    rest = [c for c in sample.columns if c != "doc_id"]
    found = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id", *rest).agg(F.min("text").alias("text"))
