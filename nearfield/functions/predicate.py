"""Filters on one attribute: parsing to validated terms, and column predicates; filter text never becomes SQL text."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_FILTER = "No_filter"
#: Operators in the order in which they are looked for.
OPERATORS = ("<=", ">=", "!=", "=", "<", ">")
_APPLY = {"<=": operator.le, ">=": operator.ge, "!=": operator.ne, "=": operator.eq, "<": operator.lt, ">": operator.gt}


def parse(text: str) -> list[str]:
    """[attribute, operator, value as text] of a single condition, or [No_filter]; ValueError without an operator."""
    compact = text.replace(" ", "")
    if compact == NO_FILTER:
        return [NO_FILTER]
    for op in OPERATORS:
        if op in compact:
            attr, value = compact.split(op, 1)
            return [attr, op, value]
    raise ValueError(f"no operator in filter {text!r}")


def parse_all(text: str) -> list[tuple[str, str, float]]:
    """Conditions joined by AND as (attribute, operator, number); whole words only, any number, all six operators."""
    if text.strip() in ("", NO_FILTER):
        return []
    out = []
    for part in re.split(r"\bAND\b", text):
        attr, op, value = parse(part)
        out.append((attr, op, float(value)))
    return out


def predicate(text: str, columns: dict[str, str] | None = None) -> Column:
    """The filter as a column; ``columns`` maps attribute names to columns. A null attribute fails every condition."""
    out = F.lit(True)
    for attr, op, value in parse_all(text):
        term = _APPLY[op](F.col((columns or {}).get(attr, attr)), F.lit(value))
        out = out & F.coalesce(term, F.lit(False))
    return out


def selectivity(df: DataFrame, text: str, columns: dict[str, str] | None = None) -> DataFrame:
    """One row: share of rows that pass, rounded to three digits."""
    return df.agg(F.round(F.avg(predicate(text, columns).cast("double")), 3).alias("selectivity"))


def catalogue(df: DataFrame, filters: list[str], columns: dict[str, str] | None = None) -> DataFrame:
    """(filter_id, filter, selectivity) of all filters in one pass; ids are positions."""
    shares = df.agg(*[F.avg(predicate(t, columns).cast("double")).alias(f"s{i}") for i, t in enumerate(filters)])
    rows = F.array(*[F.struct(F.lit(i).alias("filter_id"), F.lit(t).alias("filter"), F.col(f"s{i}").alias("selectivity")) for i, t in enumerate(filters)])
    return shares.select(F.explode(rows).alias("r")).select("r.*")


def nearest_selectivity(known: DataFrame, wanted: float, attribute: str | None = None, within: float = 0.05) -> DataFrame:
    """The known filter (filter, selectivity) whose first selectivity is nearest, if it is near enough; no row otherwise."""
    rows = known.where(F.col("filter").contains(attribute)) if attribute else known
    one = rows.groupBy("filter").agg(F.min("selectivity").alias("selectivity"))
    off = F.abs(F.col("selectivity") - wanted)
    return one.withColumn("off", off).where(F.col("off") <= within).orderBy("off", "filter").limit(1).drop("off")


def checked(results: DataFrame) -> DataFrame:
    """Results (qid, id, ...) without the -1 sentinel; an id that comes twice for a query raises on evaluation."""
    rows = results.where("id >= 0")
    n = rows.groupBy("qid", "id").agg(F.count("*").alias("times_"))
    ok = F.when(F.col("times_") > 1, F.raise_error(F.lit("an id comes twice for a query")).cast("boolean")).otherwise(True)
    return rows.join(n.where(ok), ["qid", "id"]).drop("times_")
