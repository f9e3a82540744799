"""Random-projection forests: a vector's leaf in a tree is the path of its signs at the tree's hyperplanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.exact import rescored, top_k
from nearfield.operators.lsh import hyperplanes, sign_bits


def leaves(v: Column, trees: int, depth: int, dim: int, seed: int = 1) -> Column:
    """One (tree, leaf) for each tree; every level of a tree has one hyperplane."""
    return F.array(*[F.struct(F.lit(t).alias("tree"), sign_bits(v, hyperplanes(dim, depth, seed * 1000 + t)).alias("leaf")) for t in range(trees)])


def search(train: DataFrame, queries: DataFrame, k: int, trees: int = 8, depth: int = 4, dim: int = 64, min_votes: int = 1, name: str = "angular", seed: int = 1) -> DataFrame:
    """Candidates share a leaf with the query in ``min_votes`` trees or more; ranked exactly."""
    left = train.select("id", F.explode(leaves(F.col("embedding"), trees, depth, dim, seed)).alias("at"))
    right = queries.select("qid", F.explode(leaves(F.col("embedding"), trees, depth, dim, seed)).alias("at"))
    votes = left.join(right, "at").groupBy("qid", "id").agg(F.count("*").alias("votes")).where(F.col("votes") >= min_votes)
    return top_k(rescored(votes, queries, train, name), k)
