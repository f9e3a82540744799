"""Distances and vector functions as column expressions, with NumPy kernels for blocks of vectors.

Vectors are arrays; components are cast to double before they are summed. A zero vector has no angle: its angular distance is
null, and top-k operators leave nulls out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; larger is closer."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def angular(a: Column, b: Column) -> Column:
    """1 - cosine, between 0 and 2."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def hamming(a: Column, b: Column) -> Column:
    """Share of positions that differ, every component being taken as true or false."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("boolean") != y.cast("boolean")).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return differ / F.nullif(F.size(a), F.lit(0))


def packed_hamming(a: Column, b: Column, bits: int) -> Column:
    """The same for bits packed into arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / F.lit(float(bits))


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Distinct common elements over the sum of the list lengths less these; 0 if either is empty."""
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(n / F.nullif(F.size(a) + F.size(b) - n, F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.lit(1.0) - jaccard_similarity(a, b)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"angular": angular, "euclidean": euclidean, "hamming": hamming, "jaccard": jaccard}


def metric(name: str) -> Callable[[Column, Column], Column]:
    """The distance of that name; ValueError for an unknown one."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]


def valid(name: str, distance: Column) -> Column:
    """Whether a neighbour at this distance counts: with jaccard only if anything is shared."""
    return distance < 1 - 1e-5 if name == "jaccard" else F.lit(True)


def normalise(v: Column) -> Column:
    """v divided by its length; null components for a zero vector."""
    return F.transform(_double(v), lambda x: x / F.nullif(norm(v), F.lit(0.0)))


def repair_zero(v: Column) -> Column:
    """A zero vector becomes the constant unit vector; others are normalised."""
    d = F.size(v)
    return F.when(norm(v) == 0, F.array_repeat(1 / F.sqrt(d.cast("double")), d)).otherwise(normalise(v))


def squared_norm(v: Column) -> Column:
    return F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x)


def expansion_key(item: Column, query: Column, sqnorm: Column | None = None) -> Column:
    """|item|^2 - 2 item.query: ranks like the Euclidean distance for one query."""
    return (squared_norm(item) if sqnorm is None else sqnorm) - 2 * dot(item, query)


def augment_items(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Items with one more component that makes all norms equal, so that ranking by cosine is ranking by product; queries get a 0."""
    top = df.agg(F.max(squared_norm(F.col(vec))).alias("top_"))
    extra = F.sqrt(F.greatest(F.col("top_") - squared_norm(F.col(vec)), F.lit(0.0)))
    return df.crossJoin(F.broadcast(top)).withColumn(vec, F.concat(_double(F.col(vec)), F.array(extra))).drop("top_")


def augment_query(v: Column) -> Column:
    return F.concat(_double(v), F.array(F.lit(0.0)))


def decode_sparse(flat: Column, end: Column, length: Column) -> Column:
    """The set that ends at ``end`` in a flat array of all sets."""
    return F.slice(flat, (end - length + 1).cast("int"), length.cast("int"))


def true_positions(bits: Column) -> Column:
    """Positions of the true components, from 0."""
    return F.filter(F.transform(bits, lambda x, i: F.when(x.cast("boolean"), i)), lambda x: x.isNotNull())


def pad(v: Column, dim: int) -> Column:
    """v filled up with zeros to dim components."""
    return F.concat(_double(v), F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(v), F.lit(0))))


def binarise(v: Column) -> Column:
    return F.transform(v, lambda x: x > 0)


def parse_floats(s: Column) -> Column:
    return F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.cast("double"))


def parse_ints(s: Column) -> Column:
    """A set of integers, each once."""
    return F.array_distinct(F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.cast("int")))


def parse_bits(s: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(s, r"\s", ""), ""), lambda x: x == "1")


def format_point(v: Column) -> Column:
    return F.concat_ws(" ", F.transform(v, lambda x: x.cast("string")))


def distances(name: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(queries, vectors) in double precision; NaN where an angle is undefined."""
    q, v = q.astype(np.float64), v.astype(np.float64)
    if name == "angular":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    if name == "euclidean":
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T, 0))
    if name == "hamming":
        a, b = (q != 0).astype(np.float64), (v != 0).astype(np.float64)
        return (a @ (1 - b).T + (1 - a) @ b.T) / q.shape[1]
    raise ValueError(f"no kernel for {name!r}")
