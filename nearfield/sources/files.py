"""Readers of common vector files. Text goes through Spark's text source; binary files are split into their rows by Arrow code."""

from __future__ import annotations

import gzip
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, embedding) from lines of a word and its components."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, 1 << 20), lambda x: x.cast("float")).alias("embedding"))


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, elements): integers of each line, e.g. one transaction a line."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int")).alias("elements"))


def bit_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, embedding): a string of 0 and 1 each line."""
    bits = F.transform(F.split(F.regexp_replace("value", r"\s", ""), ""), lambda x: x == "1")
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), bits.alias("embedding"))


def bag_of_words(spark: SparkSession, path: str) -> DataFrame:
    """(doc, term, n) from lines of three numbers; the head lines of one number are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) == 3).select(parts[0].cast("int").alias("doc"), parts[1].cast("int").alias("term"), parts[2].cast("int").alias("n"))


def ratings(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    """(user, item, rating) from separated text; the separator may be longer than a character."""
    df = spark.read.csv(path, sep=sep, header=header)
    names = df.columns
    return df.select(F.col(names[0]).cast("int").alias("user"), F.col(names[1]).cast("int").alias("item"), F.col(names[2]).cast("double").alias("rating"))


def _rows(path: str, at: int, v: np.ndarray) -> pa.RecordBatch:
    n, d = v.shape
    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(v.astype(np.float32).ravel()))
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at, at + n)), values], ["path", "i", "embedding"])


#: Bytes that one task reads of a file of fixed-width records.
RANGE_BYTES = 64 << 20


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _open(path: str):
    """A file in a store that ``pyarrow.fs`` reaches."""
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _ranges(spark: SparkSession, path: str, head, kind: np.dtype, range_bytes: int) -> DataFrame:
    """Rows of files of equally wide records after a header.

    ``head`` reads an open file and returns (bytes of the header, components of a record before the vector, components of the
    vector). A task reads a range of records, whatever the size of the file; a gzip file can't be entered in its middle and is
    one task's stream.
    """

    def plan(batches):
        for b in batches:
            for name, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(name) as f:
                    if f.read(2) == b"\x1f\x8b":
                        yield pa.RecordBatch.from_pydict({"path": [name], "start": pa.array([0], pa.int64()), "rows": pa.array([-1], pa.int64())})
                        continue
                    f.seek(0)
                    skip, before, dim = head(f) if length else (0, 0, 1)
                width = (before + dim) * kind.itemsize
                n, step = (length - skip) // width, max(1, range_bytes // width)
                starts = np.arange(0, n, step)
                yield pa.RecordBatch.from_pydict({"path": [name] * len(starts), "start": starts, "rows": np.minimum(step, n - starts)})

    def read(batches):
        for b in batches:
            for name, start, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(name) as raw:
                    f = gzip.GzipFile(fileobj=raw) if rows < 0 else raw
                    skip, before, dim = head(f)
                    width = (before + dim) * kind.itemsize
                    if rows >= 0:
                        f.seek(skip + start * width)
                    at, left = start, rows
                    while left and (data := f.read(min(left, 4096) * width if left > 0 else 4096 * width)):
                        v = np.frombuffer(data, kind).reshape(-1, before + dim)[:, before:]
                        yield _rows(name, at, v)
                        at, left = at + len(v), left - len(v) if left > 0 else left

    planned = _listed(spark, path).mapInArrow(plan, "path string, start long, rows long")
    dealt = planned.repartition(F.xxhash64("path", "start"))
    return dealt.mapInArrow(read, "path string, i long, embedding array<float>")


def fvecs(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, i, embedding) from records of a 32-bit dimension and as many 32-bit floats."""

    def head(f):
        dim = int(np.frombuffer(f.read(4), "<i4")[0])
        f.seek(0)
        return 0, 1, dim

    return _ranges(spark, path, head, np.dtype("<f4"), range_bytes)


def idx(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, i, embedding) from a big-endian IDX file of unsigned bytes, one row for each entry of its first axis."""

    def head(f):
        axes = f.read(4)[3]
        shape = np.frombuffer(f.read(4 * axes), ">i4")
        return 4 + 4 * axes, 0, int(np.prod(shape[1:]))

    return _ranges(spark, path, head, np.dtype(np.uint8), range_bytes)


def archived_lines(spark: SparkSession, path: str, member: str = "") -> DataFrame:
    """(path, member, line, value): lines of the text members of zip and tar files (plain or compressed) whose name ends in ``member``.

    An archive is one task's stream; its members are never held whole.
    """

    def read(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                with _open(name) as f:
                    zipped = f.read(4) == b"PK\x03\x04"
                    f.seek(0)
                    for inner, stream in _members_of_zip(f) if zipped else _members_of_tar(f):
                        if inner.endswith(member):
                            held, at = [], 0
                            for line in stream:
                                held.append(line.decode().rstrip("\r\n"))
                                if len(held) == 4096:
                                    yield _lines(name, inner, at, held)
                                    at, held = at + len(held), []
                            if held:
                                yield _lines(name, inner, at, held)

    return _listed(spark, path).select("path").mapInArrow(read, "path string, member string, line long, value string")


def _lines(path: str, member: str, at: int, held: list[str]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_pydict({"path": [path] * n, "member": [member] * n, "line": np.arange(at, at + n), "value": held})


def _members_of_zip(f):
    with zipfile.ZipFile(f) as z:
        for info in z.infolist():
            if not info.is_dir():
                with z.open(info) as stream:
                    yield info.filename, stream


def _members_of_tar(f):
    with tarfile.open(fileobj=f, mode="r:*") as t:
        for info in t:
            if info.isfile():
                yield info.name, t.extractfile(info)


def every(df: DataFrame, i: str, step: int) -> DataFrame:
    """Every step-th row by its number."""
    return df.where(F.pmod(F.col(i), F.lit(step)) == 0)
