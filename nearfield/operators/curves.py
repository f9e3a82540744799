"""Analytics over result facts: (query_id, query_type, filter_id, selectivity, k, search, algorithm, build, recall, runtime).

``search`` is the search effort (beam width or probes), ``build`` the build parameter (links or clusters).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["query_type", "filter_id", "selectivity", "k", "search", "algorithm", "build"]


def averages(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean recall and runtime by keys, and throughput as the reciprocal of the mean runtime."""
    out = facts.groupBy(*(KEYS if keys is None else keys)).agg(F.avg("recall").alias("recall"), F.avg("runtime").alias("runtime"))
    return out.withColumn("throughput", F.lit(1.0) / F.nullif("runtime", F.lit(0.0)))


def mean_reciprocal(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Throughput as the mean of reciprocals, which is another number."""
    return facts.groupBy(*keys).agg(F.avg("recall").alias("recall"), F.avg(F.lit(1.0) / F.nullif("runtime", F.lit(0.0))).alias("throughput"), F.countDistinct("query_id").alias("n_queries"))


def curve(means: DataFrame, by: list[str]) -> DataFrame:
    """Means of means, as a curve ordered by recall."""
    return means.groupBy(*by).agg(F.avg("recall").alias("recall"), F.avg("throughput").alias("throughput")).orderBy("recall")


def pareto(points: DataFrame, by: list[str], x: str, y: str, x_up: bool = True, y_up: bool = True) -> DataFrame:
    """Points that no point with a better y reaches in x: taken from the best y down, each beats the best x so far. Zero or null coordinates are left out."""
    fine = points.where(F.coalesce(F.col(x) != 0, F.lit(False)) & F.coalesce(F.col(y) != 0, F.lit(False)))
    sx = F.col(x) if x_up else -F.col(x)
    sy = F.col(y) if y_up else -F.col(y)
    w = Window.partitionBy(*by).orderBy(sy.desc(), sx.desc()).rowsBetween(Window.unboundedPreceding, -1)
    best = fine.withColumn("best_", F.max(sx).over(w))
    return best.where(F.col("best_").isNull() | (sx > F.col("best_"))).drop("best_")


def levels(facts: DataFrame, positions: list[int], column: str = "selectivity") -> DataFrame:
    """The distinct values at these places of their ascending order (-1: the last), each once; none for an empty table."""
    ranked = facts.select(column).distinct().withColumn("r_", F.dense_rank().over(Window.orderBy(column)) - 1)
    top = ranked.agg(F.max("r_").alias("top_"))
    wanted = F.array(*[F.when(F.lit(p) < 0, F.col("top_") + p + 1).otherwise(F.lit(p)) for p in positions])
    return ranked.crossJoin(F.broadcast(top)).where(F.array_contains(wanted, F.col("r_"))).select(column)


def shared_levels(a: DataFrame, b: DataFrame, column: str = "selectivity") -> DataFrame:
    """Values of both; if there is none, of either."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    both = x.intersect(y)
    return both if both.limit(1).count() else x.union(y).distinct()


def wide_by_build(facts: DataFrame, builds: list[int]) -> DataFrame:
    """One row for each (query_id, filter_id, k, search) with the first recall of each build."""
    out = facts.groupBy("query_id", "filter_id", "k", "search").pivot("build", builds).agg(F.first("recall", ignorenulls=True))
    return out.select("query_id", "filter_id", "k", "search", *[F.col(str(b)).alias(f"recall_{b}") for b in builds])


def index_on_off(off: DataFrame, on: DataFrame, keys: list[str]) -> DataFrame:
    """Means without and with the attribute index, side by side; gaps stay null."""
    a = averages(off, keys).select(*keys, F.col("recall").alias("recall_off"), F.col("runtime").alias("runtime_off"))
    b = averages(on, keys).select(*keys, F.col("recall").alias("recall_on"), F.col("runtime").alias("runtime_on"))
    return a.join(b, keys, "full_outer")


def level_of(correlation: Column) -> Column:
    """high above 0.3, low below -0.3, else average, also for null and NaN."""
    fine = ~F.isnan(correlation) & correlation.isNotNull()
    return F.when(fine & (correlation > 0.3), "high").when(fine & (correlation < -0.3), "low").otherwise("average")


def impact(facts: DataFrame) -> DataFrame:
    """Mean recall of each algorithm by correlation level, best at high first, nulls last."""
    out = facts.groupBy("algorithm").pivot("level", ["high", "average", "low"]).agg(F.avg("recall"))
    return out.orderBy(F.col("high").desc_nulls_last(), "algorithm")


def trend(facts: DataFrame, by: list[str], x: str, y: str, more_than: int = 0) -> DataFrame:
    """Slope and intercept of y over x for groups of more than so many points."""
    out = facts.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))
    return out.where(F.col("n") > more_than)


def histogram(facts: DataFrame, column: str, low: float, high: float, bins: int = 30) -> DataFrame:
    """(bin, n) with one value for each query; the upper end belongs to the last bin."""
    one = facts.groupBy("query_id").agg(F.min(column).alias("x"))
    at = F.least(F.floor((F.col("x") - low) / F.lit((high - low) / bins)), F.lit(bins - 1))
    return one.where(F.col("x").between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def dataset_summary(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("n_rows"), F.countDistinct("query_id").alias("n_queries"), F.countDistinct("algorithm").alias("n_algorithms"), F.countDistinct("algorithm", "build", "search").alias("n_configs"))


def index_summary(facts: DataFrame, below: float = 0.1) -> DataFrame:
    """For selective filters: counts, means, and how often recall is perfect."""
    return facts.where(F.col("selectivity") < below).agg(
        F.count("recall").alias("n"), F.avg("recall").alias("mean_recall"), F.count_if(F.col("recall") == 1.0).alias("n_perfect"), F.count_if(F.col("recall") < 1.0).alias("n_less")
    )


def with_statistics(facts: DataFrame, statistics: DataFrame, keys: list[str]) -> DataFrame:
    """facts with the mean of the statistics of the same keys; a missing parameter counts as 0 on both sides."""
    filled = lambda d: d.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in ("search", "build") else F.col(c) for c in d.columns])
    right = filled(statistics).groupBy(*keys).agg(F.avg("correlation").alias("correlation"))
    return filled(facts).join(right, keys, "left")


def lookup(statistics: DataFrame, **equal) -> DataFrame:
    """The first row, in the order of all its columns, that has these values; a column that the table lacks is not asked for."""
    rows = statistics
    for name, value in equal.items():
        if name in statistics.columns:
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows.orderBy(*statistics.columns).limit(1)


def mean_of_columns(wide: DataFrame, columns: list[str], by: list[str], alias: str) -> DataFrame:
    """Means by ``by`` of the row means of some columns; a null column is left out of its row's mean, a row of nulls of all."""
    known = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(known), F.lit(0))
    return wide.groupBy(*by).agg(F.avg(total).alias(alias))


def union_of(parts: list[DataFrame]) -> DataFrame:
    """Results of several filters or datasets under one another; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def in_preferred_order(df: DataFrame, preferred: list[str]) -> DataFrame:
    """The preferred columns first, as far as there are any, then the others."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def limited(definitions: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n definitions in random order; all for a negative n."""
    shuffled = definitions.orderBy(F.rand(seed))
    return shuffled if n < 0 else shuffled.limit(n)
