"""Named queries and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register the decorated builder under name, with its oracle if there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every hundredth vector; each is its own nearest neighbour."""
    return train(spark, sf_dir).where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), "embedding")


#: Result facts made from lineitem by fixed rules.
FACTS = """
facts AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'qm' ELSE 'qr' END || lpad(CAST(l_orderkey % 50 AS VARCHAR), 4, '0') AS query_id,
         CASE WHEN l_orderkey % 2 = 0 THEN 'movies' ELSE 'reviews' END AS query_type,
         l_linenumber - 1 AS filter_id, l_linenumber / 10.0 AS selectivity,
         CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 40 ELSE 100 END AS k,
         CASE l_suppkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN 500 ELSE 1000 END AS search,
         CASE l_returnflag WHEN 'A' THEN 'one-hnsw' WHEN 'N' THEN 'two-hnsw' ELSE 'two-ivf' END AS algorithm,
         CASE CAST(l_quantity AS INTEGER) % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 15 END AS build,
         CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS att_idx,
         CASE l_partkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS dataset_size,
         1 - l_discount AS recall, l_extendedprice / 1000000 AS runtime, (l_tax - 0.04) * 10 AS correlation
  FROM lineitem)
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(column, *values):
        out = F.when(column == 0, values[0])
        for i, v in enumerate(values[1:-1], 1):
            out = out.when(column == i, v)
        return out.otherwise(values[-1])

    c = F.col
    even = c("l_orderkey") % 2 == 0
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.when(even, "qm").otherwise("qr"), F.format_string("%04d", c("l_orderkey") % 50)).alias("query_id"),
        F.when(even, "movies").otherwise("reviews").alias("query_type"),
        (c("l_linenumber") - 1).alias("filter_id"),
        (c("l_linenumber") / 10.0).alias("selectivity"),
        pick(c("l_partkey") % 4, 1, 10, 40, 100).alias("k"),
        pick(c("l_suppkey") % 4, 100, 200, 500, 1000).alias("search"),
        F.when(c("l_returnflag") == "A", "one-hnsw").when(c("l_returnflag") == "N", "two-hnsw").otherwise("two-ivf").alias("algorithm"),
        pick(c("l_quantity").cast("int") % 3, 5, 10, 15).alias("build"),
        F.when(c("l_linestatus") == "O", 1).otherwise(0).alias("att_idx"),
        pick(c("l_partkey") % 3, "small", "medium", "large").alias("dataset_size"),
        (1 - c("l_discount")).alias("recall"),
        (c("l_extendedprice") / 1000000).alias("runtime"),
        ((c("l_tax") - 0.04) * 10).alias("correlation"),
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})  # no negative zero


from nearfield.plans import analytics, reports, search  # noqa: E402,F401  they register their queries
