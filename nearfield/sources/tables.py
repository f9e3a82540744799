"""Schemas of the vector tables, and scans that check what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the two tables and the attribute that a filter names on each.
SCHEMAS = {
    "movies": "id string, embedding array<float>, avgrating double, title string, genre string, num_votes long, year int",
    "reviews": "id string, embedding array<float>, mid string, uid string, likeshare double, movierating double, total_votes long",
}
FILTER_ATTRIBUTE = {"movies": "avgrating", "reviews": "total_votes"}
FILTERS = "table string, filter_id int, filter string, selectivity double"
WORKLOAD = "table string, filter_id int, qid int, embedding array<float>, distances array<float>"
#: Columns of an older layout and what they are called now.
OLDER = {
    "movies": {"storyline_vec": "embedding", "title_id": "id", "avgRating": "avgrating", "start_year": "year"},
    "reviews": {"review_vec": "embedding", "review_ids": "id", "title_ids": "mid", "user_ids": "uid"},
}


def scan_train(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A typed table from Parquet; columns of the older layout are renamed, absent ones null."""
    if table not in SCHEMAS:
        raise ValueError(f"unknown table {table!r}")
    df = spark.read.parquet(path)
    for old, new in OLDER[table].items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    wanted = spark.createDataFrame([], SCHEMAS[table]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def dimension(df: DataFrame, vec: str = "embedding") -> int:
    """The one dimension of all vectors; ValueError if there are several."""
    row = df.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
    if row.lo != row.hi:
        raise ValueError(f"vectors of {row.lo} to {row.hi} components")
    return row.lo or 0


def scan_workload(spark: SparkSession, path: str, table: str, filter_id: int | None) -> DataFrame:
    """Queries of one filter (0 if none is named), from a dataset partitioned by table and filter_id."""
    return spark.read.parquet(path).where((F.col("table") == table) & (F.col("filter_id") == (filter_id or 0)))


def first_truths(workload: DataFrame, k: int) -> DataFrame:
    """(qid, rank, dist) of the first k stored similarities, as distances."""
    some = workload.select("qid", F.posexplode(F.slice("distances", 1, k)).alias("i", "s"))
    return some.select("qid", (F.col("i") + 1).alias("rank"), (1 - F.col("s").cast("double")).alias("dist"))


def numbered_filters(filters: DataFrame, order: str) -> DataFrame:
    """Filters as text, numbered from 0 in the given order."""
    from pyspark.sql import Window

    return filters.withColumn("filter", F.col("filter").cast("string")).withColumn("filter_id", F.row_number().over(Window.orderBy(order)) - 1)
