"""Stored runs and ground truth: partitioned Parquet tables, parameters as columns and never in file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.curves import union_of

#: Partition columns of stored results, outermost first.
PARTITIONS = ["size", "att_idx", "filter_id", "k", "algorithm"]


def store(results: DataFrame, path: str, extra: list[str] | None = None) -> None:
    """Replace the partitions that ``results`` has; ``extra`` adds partition columns, such as a segment size."""
    by = [*PARTITIONS, *(extra or [])]
    results.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def load(spark: SparkSession, path: str, **equal) -> DataFrame:
    """Stored results; equalities on partition columns prune directories."""
    out = spark.read.parquet(path)
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out


def store_truth(neighbours: DataFrame, path: str) -> None:
    """Long form (qid, rank, id, dist), sorted within files so that the first ranks can be read alone."""
    neighbours.sortWithinPartitions("rank", "qid").write.mode("overwrite").parquet(path)


def load_truth(spark: SparkSession, path: str, k: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("rank") <= k)


def from_similarity(truth: DataFrame) -> DataFrame:
    """Stored similarities as distances."""
    return truth.withColumn("dist", 1 - F.col("dist"))


def store_sets(sets: DataFrame, path: str) -> None:
    """Sets (id, elements), each sorted."""
    sets.withColumn("elements", F.array_sort("elements")).write.mode("overwrite").parquet(path)


def scan_files(spark: SparkSession, root: str, pattern: str = "*", batch: bool | None = None) -> DataFrame:
    """(path, length, modified, batch) of every file below root whose name fits; with ``batch``, only those of runs in that mode.

    A run is in batch mode if the last directory of its path ends in "-batch". Contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    found = files.select("path", "length", F.col("modificationTime").alias("modified"), F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)).endswith("-batch"), F.lit(False)).alias("batch"))
    return found if batch is None else found.where(F.col("batch") == batch)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export_all(datasets: dict[str, DataFrame], path: str) -> None:
    """The metrics of every dataset in one CSV folder, with the dataset's name; columns that one lacks are empty there."""
    export_csv(union_of([d.withColumn("dataset", F.lit(name)) for name, d in sorted(datasets.items())]), path)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def attach_selectivity(facts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """facts with the selectivity of their filter_id; an id outside the catalogue raises on evaluation."""
    both = facts.join(catalogue.select("filter_id", "selectivity"), "filter_id", "left")
    return both.withColumn("selectivity", F.when(F.col("selectivity").isNull(), F.raise_error(F.lit("filter_id outside the catalogue")).cast("double")).otherwise(F.col("selectivity")))
