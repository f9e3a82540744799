"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it again, so a lost executor
costs a re-read and never a recomputation of everything upstream.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Tables written between two collections of the driver's garbage.
TIDY = 4
_WRITTEN = itertools.count(1)


def shared_root(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="nearfield-"))
    return f"{base.rstrip('/')}/nearfield-{app}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage after every few tables.

    Little of its heap is live, but by itself it collects late: in a query of some hundred jobs the heap grows to its limit.
    """
    if next(_WRITTEN) % TIDY == 0:
        spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a scan of what was written."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write df to the shared folder in buckets by a hash of key; groups and joins on key then read them without a shuffle.

    The catalogue holds the table only until it has been resolved; its files stay until ``cleanup``.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    _tidy(spark)
    return out


def cleanup(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it once results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
