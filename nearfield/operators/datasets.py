"""Construction of datasets: generators, splits, sets, TF-IDF with random projection, factorisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gaussian_blobs(spark: SparkSession, n: int, dim: int, centres: int = 10, spread: float = 1.0, seed: int = 1) -> DataFrame:
    """(id, embedding, blob): each row is normal around its blob's centre; both follow from hashes, so any partitioning gives the same rows."""
    def gauss(salt, *cols):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *cols), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
        w = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt + 1), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * w)

    blob = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(centres))
    one = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: 10 * gauss(10, F.col("blob"), i) + spread * gauss(20, F.col("id"), i))
    return spark.range(n).withColumn("blob", blob).withColumn("embedding", one).select("id", "embedding", "blob")


def sign_bits(blobs: DataFrame) -> DataFrame:
    return blobs.withColumn("embedding", F.transform("embedding", lambda x: x > 0))


def random_sets(spark: SparkSession, n: int, universe: int, size: int, seed: int = 1) -> DataFrame:
    """(id, elements): sets of distinct elements, the ones with the smallest hashes."""
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(universe - 1)), lambda e: F.struct(F.xxhash64(F.lit(seed), F.col("id"), e).alias("h"), e.alias("e"))))
    return spark.range(n).select("id", F.transform(F.slice(ranked, 1, size), lambda s: s["e"]).alias("elements"))


def split(df: DataFrame, key: str, test: float, seed: int = 1) -> DataFrame:
    """df with is_test for about the given share; the choice follows from the key, not from the partitioning."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(test * 1_000_000))


def item_sets(ratings: DataFrame, at_least: float = 3.0, min_size: int = 20) -> DataFrame:
    """(user, elements) of the items that a user rates well, repeats kept; users with fewer elements go."""
    good = ratings.where(F.col("rating") >= at_least).groupBy("user").agg(F.array_sort(F.collect_list("item")).alias("elements"))
    return good.where(F.size("elements") >= min_size)


def dimension(sets: DataFrame) -> DataFrame:
    return sets.agg((F.max(F.array_max("elements")) + 1).alias("dimension"))


def tfidf_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tfidf) with smoothed inverse document frequencies."""
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")
    tf = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n_docs"))
    both = tf.join(df, "term").crossJoin(F.broadcast(n))
    return both.select("doc_id", "term", (F.col("tf") * (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)).alias("tfidf"))


def _gaussian(term: Column, i: int, seed: int) -> Column:
    """A standard normal number that follows from the term and i (Box and Muller's transform of two hashes)."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(2 * i + k), term), 11) + 1) / F.lit(float(1 << 53))
    return F.sqrt(F.log(u(0)) * -2) * F.cos(u(1) * (2 * math.pi))


def random_projection(terms: DataFrame, dim: int, seed: int = 1) -> DataFrame:
    """(doc_id, embedding): term weights times a Gaussian matrix whose rows follow from the term, so it is never stored."""
    sums = [F.sum(F.col("tfidf") * _gaussian(F.col("term"), i, seed)).alias(f"x{i}") for i in range(dim)]
    return terms.groupBy("doc_id").agg(*sums).select("doc_id", F.array(*[F.col(f"x{i}") / math.sqrt(dim) for i in range(dim)]).alias("embedding"))


def factorised(ratings: DataFrame, rank: int = 16, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Item and user vectors of a factorisation of BM25-weighted implicit ratings."""
    per_item = ratings.groupBy("item").agg(F.count("*").alias("df"))
    per_user = ratings.groupBy("user").agg(F.sum("rating").alias("len"))
    n = ratings.agg(F.countDistinct("user").alias("n"), (F.sum("rating") / F.countDistinct("user")).alias("avg_len"))
    w = ratings.join(per_item, "item").join(per_user, "user").crossJoin(F.broadcast(n))
    k1, b = 100.0, 0.8
    weight = F.col("rating") * (k1 + 1) / (F.col("rating") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))) * F.log(F.col("n") / (1 + F.col("df")) + 1)
    model = ALS(rank=rank, maxIter=5, seed=seed, userCol="user", itemCol="item", ratingCol="w", implicitPrefs=True).fit(w.select("user", "item", weight.alias("w")))
    return model.itemFactors.withColumnRenamed("features", "embedding"), model.userFactors.withColumnRenamed("features", "embedding")


def centred(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vectors less their mean."""
    means = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    one = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean_"))
    return df.crossJoin(F.broadcast(one)).withColumn(vec, F.zip_with(F.col(vec).cast("array<double>"), "mean_", lambda a, b: a - b)).drop("mean_")


def entry_points(df: DataFrame, k: int, seed: int = 1) -> list[list[float]]:
    """Centres of repeated halving."""
    rows = df.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return [[float(x) for x in c] for c in BisectingKMeans(k=k, seed=seed).fit(rows).clusterCenters()]
