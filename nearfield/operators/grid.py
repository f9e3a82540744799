"""Parameter grids, run definitions, and which of them are still to be run."""

from __future__ import annotations

import itertools
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def expand(args: Any) -> list[Any]:
    """All combinations of a nested argument description: lists inside lists or dicts are alternatives."""
    if isinstance(args, dict):
        flat = [(k, v if isinstance(v, list) else [v]) for k, v in args.items()]
        return [dict(zip([k for k, _ in flat], c, strict=True)) for c in itertools.product(*[v for _, v in flat])]
    if isinstance(args, list):
        choices = [x if isinstance(x, list) else expand(x) if isinstance(x, dict) else [x] for x in args]
        return [list(c) for c in itertools.product(*choices)]
    return [args]


def substitute(value: Any, known: dict[str, Any]) -> Any:
    """Strings such as @count become the known value, at any depth."""
    if isinstance(value, dict):
        return {k: substitute(v, known) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, known) for v in value]
    if isinstance(value, str) and value.startswith("@") and value[1:] in known:
        return known[value[1:]]
    return value


def load_definitions(path: str, point_type: str = "float", metric: str = "any") -> list[dict[str, Any]]:
    """Run groups of a YAML configuration: of the point type, for any metric and for this one; a later algorithm replaces one of its name."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    with open(path, encoding="utf-8") as f:
        groups = yaml.safe_load(f).get(point_type, {})
    by_name = {a["name"]: a for a in [*groups.get("any", []), *(groups.get(metric, []) if metric != "any" else [])]}
    out = []
    for name, a in by_name.items():
        for group in a.get("run_groups", {}).values():
            out.append({"name": name, "disabled": a.get("disabled", False), "args": group.get("args", []), "query_args": group.get("query_args", [])})
    return out


def definitions(spark: SparkSession, algorithms: list[dict[str, Any]], known: dict[str, Any]) -> DataFrame:
    """(algorithm, arguments, query_arguments, disabled) for each algorithm's build grid and its groups of search arguments."""
    rows = []
    for a in algorithms:
        for build in expand(substitute(a.get("args", []), known)):
            groups = [json.dumps(q) for q in expand(substitute(a.get("query_args", []), known))]
            rows.append((a["name"], json.dumps(build), groups, bool(a.get("disabled", False))))
    return spark.createDataFrame(rows, "algorithm string, arguments string, query_arguments array<string>, disabled boolean")


def grid(spark: SparkSession, **axes: list[Any]) -> DataFrame:
    """The product of named lists as a table: explode after explode, no shuffle."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def available(defs: DataFrame, images: DataFrame) -> DataFrame:
    """Definitions whose algorithm has an image."""
    return defs.join(images.select("algorithm").distinct(), "algorithm", "left_semi")


def missing(defs: DataFrame, images: DataFrame) -> DataFrame:
    return defs.join(images.select("algorithm").distinct(), "algorithm", "left_anti")


def to_run(defs: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """(algorithm, arguments, query_argument) not yet among the stored runs; all of them with force."""
    each = defs.where(~F.col("disabled")).select("algorithm", "arguments", F.explode_outer("query_arguments").alias("query_argument"))
    if force:
        return each
    keys = ["algorithm", "arguments", "query_argument"]
    same = [each[k].eqNullSafe(done[k]) for k in keys]
    return each.join(done, same[0] & same[1] & same[2], "left_anti")
