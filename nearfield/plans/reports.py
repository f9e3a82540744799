"""The fixed reports: compositions of the curve operators with their predicates as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import curves
from nearfield.plans.registry import FACTS, facts, query

_AVG = "round(avg(recall), 9) AS recall, round(avg(runtime), 9) AS runtime, round(1 / avg(runtime), 4) AS throughput"


def _r(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in (("recall", 9), ("runtime", 9), ("throughput", 4)) if c in df.columns})


def _kind(ivf: bool) -> str:
    return "algorithm LIKE '%ivf'" if ivf else "algorithm NOT LIKE '%ivf'"


def by_keys(f: DataFrame, where: str, keys: list[str]) -> DataFrame:
    """Averages of the facts that pass, in the order of the keys."""
    return curves.averages(f.where(where), keys).orderBy(*keys)


def level_curves(f: DataFrame, where: str, positions: list[int], keys: list[str], source: DataFrame | None = None) -> DataFrame:
    """Means of means along the search effort, at some levels of selectivity (of ``source``, or of the facts that pass)."""
    rows = f.where(where)
    chosen = curves.levels(rows if source is None else source, positions)
    means = curves.averages(rows.join(F.broadcast(chosen), "selectivity", "left_semi"), list(dict.fromkeys([*keys, *curves.KEYS])))
    return curves.curve(means, keys)


def _level_sql(where: str, positions: str, keys: str, source: str = "rows", extra: str = "") -> str:
    return f"""WITH {FACTS}, rows AS (SELECT * FROM facts WHERE {where}){extra},
    d AS (SELECT selectivity, row_number() OVER (ORDER BY selectivity) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT selectivity FROM {source})),
    m AS (SELECT att_idx, dataset_size, query_type, filter_id, selectivity, k, search, algorithm, build, recall, runtime FROM rows WHERE selectivity IN (SELECT selectivity FROM d WHERE r IN ({positions}))),
    a AS (SELECT {', '.join(dict.fromkeys([*keys.split(', '), *curves.KEYS]))}, avg(recall) AS recall, 1 / avg(runtime) AS throughput FROM m GROUP BY ALL)
    SELECT {keys}, round(avg(recall), 9) AS recall, round(avg(throughput), 4) AS throughput FROM a GROUP BY {keys}"""


for _name, _ivf in (("hnsw", False), ("ivf", True)):

    @query(f"report_search_curve_{_name}", f"WITH {FACTS} SELECT query_type, algorithm, build, search, {_AVG} FROM facts WHERE k = 10 AND {_kind(_ivf)} GROUP BY ALL")
    def _search_curve(spark, sf_dir, ivf=_ivf):
        return _r(by_keys(facts(spark, sf_dir), f"k = 10 AND {_kind(ivf)}", ["query_type", "algorithm", "build", "search"]))

    @query(f"report_recall_by_selectivity_{_name}", f"WITH {FACTS} SELECT query_type, selectivity, algorithm, search, {_AVG} FROM facts WHERE k = 10 AND build = 10 AND {_kind(_ivf)} GROUP BY ALL")
    def _by_selectivity(spark, sf_dir, ivf=_ivf):
        return _r(by_keys(facts(spark, sf_dir), f"k = 10 AND build = 10 AND {_kind(ivf)}", ["query_type", "selectivity", "algorithm", "search"]))

    @query(f"report_level_curves_{_name}", _level_sql(f"k = 10 AND {_kind(_ivf)}" + ("" if _ivf else " AND build = 10"), "1, 3, 5, n - 1", "selectivity, algorithm, search"))
    def _levels(spark, sf_dir, ivf=_ivf):
        where = f"k = 10 AND {_kind(ivf)}" + ("" if ivf else " AND build = 10")
        return _r(level_curves(facts(spark, sf_dir), where, [1, 3, 5, -1], ["selectivity", "algorithm", "search"]))

    @query(f"report_fixed_levels_{_name}", _level_sql(f"k IN (1, 10, 100) AND build IN (5, 15) AND {_kind(_ivf)}", "0, 2, 4, n - 1", "k, build, selectivity, algorithm, search"))
    def _fixed(spark, sf_dir, ivf=_ivf):
        return _r(level_curves(facts(spark, sf_dir), f"k IN (1, 10, 100) AND build IN (5, 15) AND {_kind(ivf)}", [0, 2, 4, -1], ["k", "build", "selectivity", "algorithm", "search"]))

    @query(f"report_by_k_{_name}", f"WITH {FACTS} SELECT algorithm, k, selectivity, {_AVG} FROM facts WHERE {_kind(_ivf)}" + ("" if _ivf else " AND build = 10") + " GROUP BY ALL")
    def _by_k(spark, sf_dir, ivf=_ivf):
        return _r(by_keys(facts(spark, sf_dir), _kind(ivf) + ("" if ivf else " AND build = 10"), ["algorithm", "k", "selectivity"]))

    _shared = ", s AS (SELECT selectivity FROM rows WHERE att_idx = 0 INTERSECT SELECT selectivity FROM rows WHERE att_idx = 1)"

    @query(f"report_attribute_index_{_name}", _level_sql(f"k = 10 AND {_kind(_ivf)}" + ("" if _ivf else " AND build = 10"), "1, 4, n - 1", "att_idx, selectivity, search", "s", _shared))
    def _attribute(spark, sf_dir, ivf=_ivf):
        where = f"k = 10 AND {_kind(ivf)}" + ("" if ivf else " AND build = 10")
        f = facts(spark, sf_dir)
        shared = curves.shared_levels(f.where(where + " AND att_idx = 0"), f.where(where + " AND att_idx = 1"))
        return _r(level_curves(f, where, [1, 4, -1], ["att_idx", "selectivity", "search"], shared))


@query("report_one_system", f"WITH {FACTS} SELECT att_idx, selectivity, search, {_AVG} FROM facts WHERE algorithm = 'one-hnsw' AND k = 10 AND build = 10 GROUP BY ALL")
def report_one_system(spark, sf_dir):
    return _r(by_keys(facts(spark, sf_dir), "algorithm = 'one-hnsw' AND k = 10 AND build = 10", ["att_idx", "selectivity", "search"]))


@query("report_hnsw_or_ivf", _level_sql("k = 10 AND algorithm LIKE 'two%' AND (build = 10 OR algorithm LIKE '%ivf')", "1, 4, n - 1", "algorithm, selectivity, search"))
def report_hnsw_or_ivf(spark, sf_dir):
    return _r(level_curves(facts(spark, sf_dir), "k = 10 AND algorithm LIKE 'two%' AND (build = 10 OR algorithm LIKE '%ivf')", [1, 4, -1], ["algorithm", "selectivity", "search"]))


@query("report_level_legend", f"""WITH {FACTS}, d AS (SELECT DISTINCT dataset_size, algorithm, selectivity FROM facts),
    l AS (SELECT *, row_number() OVER (PARTITION BY dataset_size, algorithm ORDER BY selectivity) - 1 AS level FROM d)
    SELECT algorithm, CAST(level AS INTEGER) AS level, max(selectivity) FILTER (dataset_size = 'small') AS small, max(selectivity) FILTER (dataset_size = 'medium') AS medium, max(selectivity) FILTER (dataset_size = 'large') AS large
    FROM l WHERE level IN (1, 3, 5) GROUP BY algorithm, level""")
def report_level_legend(spark, sf_dir):
    from pyspark.sql import Window

    d = facts(spark, sf_dir).select("dataset_size", "algorithm", "selectivity").distinct()
    w = Window.partitionBy("dataset_size", "algorithm").orderBy("selectivity")
    ranked = d.withColumn("level", F.row_number().over(w) - 1).where(F.col("level").isin(1, 3, 5))
    return ranked.groupBy("algorithm", "level").pivot("dataset_size", ["small", "medium", "large"]).agg(F.max("selectivity")).orderBy("algorithm", "level")


@query("report_segment_ablation", f"""WITH {FACTS} SELECT att_idx AS segment, selectivity, search, {_AVG} FROM facts WHERE algorithm NOT LIKE '%ivf' AND build = 10 GROUP BY ALL""")
def report_segment_ablation(spark, sf_dir):
    f = facts(spark, sf_dir).withColumnRenamed("att_idx", "segment")
    return _r(by_keys(f, "algorithm NOT LIKE '%ivf' AND build = 10", ["segment", "selectivity", "search"]))


@query("report_build_times", """WITH t AS (SELECT l_returnflag AS system, CAST(l_quantity AS INTEGER) % 3 * 5 + 5 AS m, l_extendedprice AS s FROM lineitem)
    SELECT system, CAST(m AS INTEGER) AS m, round(avg(s), 4) AS seconds FROM t GROUP BY system, m""")
def report_build_times(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("system"), (F.col("l_quantity").cast("int") % 3 * 5 + 5).alias("m"), F.col("l_extendedprice").alias("s"))
    return t.groupBy("system", "m").agg(F.round(F.avg("s"), 4).alias("seconds")).orderBy("system", "m")


@query("report_correlation_curve", f"""WITH {FACTS}, l AS (SELECT *, CASE WHEN round(correlation, 6) > 0.3 THEN 'high' WHEN round(correlation, 6) < -0.3 THEN 'low' ELSE 'average' END AS level FROM facts)
    SELECT algorithm, level, search, round(avg(recall), 9) AS recall, round(avg(1 / runtime), 4) AS throughput, count(DISTINCT query_id) AS n_queries FROM l GROUP BY algorithm, level, search""")
def report_correlation_curve(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("level", curves.level_of(F.round("correlation", 6)))
    return _r(curves.mean_reciprocal(f, ["algorithm", "level", "search"]))
