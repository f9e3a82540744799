"""Query plans as text, beside what a query returned and how long it took."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame


def plan(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def facts_of(text: str) -> dict[str, object]:
    """What a plan shows: filters that reach the scan, columns that it reads, exchanges, joins, and Python nodes."""
    return {
        "pushed_filters": re.findall(r"PushedFilters: \[(.*?)\]", text),
        "read_schema": re.findall(r"ReadSchema: (struct<.*?>)\n", text),
        "exchanges": len(re.findall(r"^\(\d+\) Exchange", text, re.M)),
        "joins": re.findall(r"^\(\d+\) (\w*(?:Join|CartesianProduct))", text, re.M),
        "python": re.findall(r"^\(\d+\) (\w*(?:InArrow|InPandas|PythonUDF|EvalPython))", text, re.M),
    }


def explained(df: DataFrame) -> tuple[str, float, list]:
    """(plan, seconds, rows) of a query with a small result."""
    text, start = plan(df), time.perf_counter()
    rows = df.collect()
    return text, time.perf_counter() - start, rows
