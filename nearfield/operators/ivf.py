"""Inverted files: vectors listed under their nearest centroid; a query visits the lists of its ``probes`` nearest centroids.

Centroids are a bounded table that is sent to the tasks; lists join on their number. Quantised variants rank by codes first and
compute the exact distance of k * factor finalists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import distances, metric
from nearfield.operators.exact import matrix, rescored, top_k


@dataclass
class Ivf:
    """centroids (list_id, centroid); lists (list_id, id, embedding and what else the train table has)."""

    centroids: DataFrame
    lists: DataFrame
    name: str

    def route(self, queries: DataFrame, probes: int) -> DataFrame:
        """(qid, embedding, list_id) of the nearest centroids of each query."""
        d = metric(self.name)(F.col("centroid"), F.col("embedding"))
        pairs = queries.select("qid", "embedding").crossJoin(F.broadcast(self.centroids)).withColumn("d", d)
        w = Window.partitionBy("qid").orderBy("d", "list_id")
        return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= probes).select("qid", "embedding", "list_id")

    def search(self, queries: DataFrame, k: int, probes: int, where: Column | None = None) -> DataFrame:
        lists = self.lists if where is None else self.lists.where(where)
        found = lists.select("list_id", "id", F.col("embedding").alias("v_")).join(self.route(queries, probes), "list_id")
        return top_k(found.select("qid", "id", metric(self.name)(F.col("v_"), F.col("embedding")).alias("dist")), k)

    def save(self, path: str) -> None:
        """Keep the index: lists sorted by their number, so that a search reads only row groups of the lists it visits."""
        self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        self.lists.repartition("list_id").sortWithinPartitions("list_id").write.mode("overwrite").parquet(f"{path}/lists")

    @staticmethod
    def load(spark: SparkSession, path: str, name: str) -> Ivf:
        return Ivf(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/lists"), name)

    def candidates(self, queries: DataFrame, probes: int) -> DataFrame:
        """(qid, n): distances that a search computes."""
        sizes = self.lists.groupBy("list_id").agg(F.count("*").alias("n"))
        return self.route(queries, probes).join(sizes, "list_id", "left").groupBy("qid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def assign(train: DataFrame, centroids: DataFrame, name: str) -> DataFrame:
    """train with the list_id of the nearest centroid (ties to the smaller), without a shuffle of the vectors' pairs."""
    listed = centroids.agg(F.array_sort(F.collect_list(F.struct("list_id", F.col("centroid").alias("c_")))).alias("all_"))
    scored = F.array_min(F.transform("all_", lambda c: F.struct(metric(name)(c["c_"], F.col("embedding")).alias("d"), c["list_id"].alias("list_id"))))
    return train.crossJoin(F.broadcast(listed)).withColumn("list_id", scored["list_id"]).drop("all_")


def assign_blocks(train: DataFrame, centroids: list[list[float]], name: str) -> DataFrame:
    """(list_id, id, embedding): the same within rounding, by matrix products. A vector without a distance goes to the first list."""
    shared = train.sparkSession.sparkContext.broadcast(np.array(centroids, float))

    def run(batches):
        for b in batches:
            d = np.nan_to_num(distances(name, matrix(b.column(1)), shared.value), nan=np.inf) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1).astype(np.int32)), b.column(0), b.column(1)], ["list_id", "id", "embedding"])

    rows = train.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "list_id int, id long, embedding array<double>")


def sample(train: DataFrame, rows: int = 20_000, seed: int = 1) -> DataFrame:
    """About so many rows, by a hash of the id, to fit centres on; all if there are no more."""
    n = train.count()
    return train if n <= rows else train.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def build_fixed(train: DataFrame, centroids: DataFrame, name: str = "angular") -> Ivf:
    return Ivf(centroids, assign(train, centroids, name), name)


def build_kmeans(train: DataFrame, n_lists: int, name: str = "angular", seed: int = 1, iterations: int = 10) -> Ivf:
    """Lists of k-means clusters; with angular distance, of unit vectors."""
    return build_fixed(train, kmeans(train, n_lists, name, seed, iterations), name)


def kmeans(train: DataFrame, n_lists: int, name: str = "angular", seed: int = 1, iterations: int = 10) -> DataFrame:
    """(list_id, centroid)"""
    rows = train.withColumn("features_", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=n_lists, seed=seed, maxIter=iterations, featuresCol="features_", distanceMeasure="cosine" if name == "angular" else "euclidean").fit(rows)
    spark = train.sparkSession
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list_id int, centroid array<double>")


def label_centroids(train: DataFrame, label: str = "label") -> DataFrame:
    """The mean vector of each label as a centroid."""
    flat = train.select(F.col(label).alias("list_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = flat.groupBy("list_id", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def least_probes(index: Ivf, queries: DataFrame, truth: DataFrame, k: int, target: float, choices: list[int]) -> tuple[int, float]:
    """The smallest choice of probes whose recall against the true ids reaches the target; the last one if none does."""
    n = truth.count()
    share = 0.0
    for p in sorted(choices):
        share = index.search(queries, k, p).join(truth.select("qid", "id"), ["qid", "id"], "left_semi").count() / max(n, 1)
        if share >= target:
            return p, share
    return max(choices), share


def access_path(index: Ivf, queries: DataFrame, k: int, probes: int, where: Column, share: float, exact_below: float = 0.05) -> DataFrame:
    """A selective filter is searched exactly among the rows that pass, another one through the lists."""
    if share < exact_below:
        from nearfield.operators.exact import knn

        return knn(queries, index.lists, k, index.name, where)
    return index.search(queries, k, probes, where)


# --- quantised codes ---------------------------------------------------------------------------------------------


def sq8_bounds(train: DataFrame) -> DataFrame:
    """One row of per-dimension minima and spans."""
    flat = train.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    each = flat.groupBy("i").agg(F.min("x").alias("lo"), (F.max("x") - F.min("x")).alias("span"))
    rows = F.array_sort(F.collect_list(F.struct("i", "lo", "span")))
    return each.agg(F.transform(rows, lambda r: r["lo"]).alias("lo"), F.transform(rows, lambda r: r["span"]).alias("span"))


def sq8_encode(train: DataFrame, bounds: DataFrame) -> DataFrame:
    """train with ``code``: each component as a whole number from 0 to 255."""
    b = train.crossJoin(F.broadcast(bounds))
    step = F.zip_with(F.arrays_zip("lo", "span"), F.col("embedding").cast("array<double>"), lambda r, x: F.when(r["span"] == 0, 0).otherwise(F.floor((x - r["lo"]) / F.nullif(r["span"], F.lit(0.0)) * 255 + 0.5)).cast("int"))
    return b.withColumn("code", step).drop("lo", "span")


def sq8_search(coded: DataFrame, bounds: DataFrame, queries: DataFrame, k: int, factor: int = 4, name: str = "euclidean") -> DataFrame:
    """Rank by decoded codes, then by exact distance among k * factor."""
    decoded = F.zip_with(F.arrays_zip("lo", "span"), F.col("code"), lambda r, c: r["lo"] + r["span"] * c / 255.0)
    rows = coded.crossJoin(F.broadcast(bounds)).select("id", decoded.alias("v_"))
    pairs = rows.crossJoin(F.broadcast(queries.select("qid", "embedding")))
    first = top_k(pairs.select("qid", "id", metric(name)(F.col("v_"), F.col("embedding")).alias("dist")), k * factor)
    return top_k(rescored(first, queries, coded, name), k)


def pq_train(train: DataFrame, subspaces: int, codes: int = 16, seed: int = 1) -> list[list[list[float]]]:
    """k-means centres of each of the equal subspaces."""
    dim = train.select(F.size("embedding")).first()[0]
    if dim % subspaces:
        raise ValueError("the number of subspaces must divide the dimension")
    width, out = dim // subspaces, []
    for s in range(subspaces):
        part = train.select(array_to_vector(F.slice(F.col("embedding").cast("array<double>"), s * width + 1, width)).alias("features"))
        out.append([[float(x) for x in c] for c in KMeans(k=codes, seed=seed, maxIter=8).fit(part).clusterCenters()])
    return out


def _codebook(books: list[list[list[float]]]) -> Column:
    return F.array(*[F.array(*[F.array(*[F.lit(x) for x in c]) for c in book]) for book in books])


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def pq_encode(train: DataFrame, books: list[list[list[float]]]) -> DataFrame:
    """train with ``code``: the number of the nearest centre in each subspace."""
    width = len(books[0][0])
    book = train.sparkSession.range(1).select(_codebook(books).alias("books"))
    part = lambda s: F.slice(F.col("embedding").cast("array<double>"), s * width + 1, width)
    code = F.transform("books", lambda cs, s: F.array_min(F.transform(cs, lambda c, i: F.struct(_sqdist(c, part(s)).alias("d"), i.alias("i"))))["i"])
    return train.crossJoin(F.broadcast(book)).withColumn("code", code).drop("books")


def pq_search(coded: DataFrame, books: list[list[list[float]]], queries: DataFrame, k: int, factor: int = 10) -> DataFrame:
    """Asymmetric distances from a table of each query to all centres, then exact ones among k * factor; Euclidean."""
    width = len(books[0][0])
    book = coded.sparkSession.range(1).select(_codebook(books).alias("books"))
    part = lambda s: F.slice(F.col("embedding").cast("array<double>"), s * width + 1, width)
    tables = queries.crossJoin(F.broadcast(book)).select("qid", F.transform("books", lambda cs, s: F.transform(cs, lambda c: _sqdist(c, part(s)))).alias("table"))
    pairs = coded.select("id", "code").crossJoin(F.broadcast(tables))
    adc = F.aggregate(F.zip_with("table", "code", lambda t, c: F.get(t, c)), F.lit(0.0), lambda s, x: s + x)
    first = top_k(pairs.select("qid", "id", adc.alias("dist")), k * factor)
    return top_k(rescored(first, queries, coded, "euclidean"), k)
