"""Hashed features of texts for linear classifiers: folded words, word beginnings, byte trigrams in a smaller range, and how varied the words are.

A text's feature values are its counts divided by the root of the number of words or trigrams, so that a score grows with
evidence but not with length alone.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import FOLDED, U64, Words, blocks, mix, per_text

WORDS, STARTS, TRIGRAM_BITS = 1 << 18, 1 << 16, 13
#: Bytes of a word's beginning.
START_BYTES = 5
#: Steps of the share of words that are distinct.
VARIETY = 16
SIZE = WORDS + STARTS + (1 << TRIGRAM_BITS) + VARIETY


class Features:
    """Buckets of the words, beginnings and trigrams of a slice of texts."""

    def __init__(self, col: pa.Array):
        w = Words(col, FOLDED)
        self.per = w.per
        whole = mix(w.hashes() ^ U64(0x51ED270B)) % U64(WORDS)
        start = mix(w.spans(w.start, np.minimum(w.end, w.start + START_BYTES)) ^ U64(0x2545F491)) % U64(STARTS)
        self.words = whole.astype(np.int32)
        self.starts = start.astype(np.int32) + np.int32(WORDS)
        h = w.hashes()
        keys = np.sort(w.text_of().astype(U64) << U64(47) | h >> U64(17))
        new = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
        distinct = np.bincount((new >> U64(47)).astype(np.int64), minlength=len(w.per))
        self.variety = (SIZE - VARIETY + np.minimum(distinct * VARIETY // np.maximum(w.per, 1), VARIETY - 1)).astype(np.int32)
        raw = Words(col)
        self.sizes, self.n_words = np.diff(raw.off), raw.per
        d = raw.data
        code = np.zeros(len(d), np.uint32)
        if len(d) > 2:
            code[:-2] = d[:-2].astype(np.uint32) << np.uint32(16) | d[1:-1].astype(np.uint32) << np.uint32(8) | d[2:]
            code *= np.uint32(0x9E3779B1)
        self.trigrams = (code >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int32) + np.int32(WORDS + STARTS)
        self.inside = np.ones(len(d), bool)  # whether the trigram that starts here lies within one text
        ends = raw.off[1:]
        for k in (1, 2):
            at = ends - k
            self.inside[at[(at >= raw.off[:-1]) & (at >= 0)]] = False
        self.n_trigrams = np.maximum(self.sizes - 2, 0)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """features @ weights for each text; weights (SIZE, columns)."""
        out = np.empty((len(self.per), weights.shape[1]))
        for k in range(weights.shape[1]):
            col = np.ascontiguousarray(weights[:, k])
            words = per_text(col[self.words] + col[self.starts], self.per)
            grams = per_text(np.where(self.inside, col[self.trigrams], 0), self.sizes)
            out[:, k] = words * _root(self.per) + grams * _root(self.n_trigrams) + col[self.variety]
        return out


def _root(n) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(n, 1))


def sparse(f: Features) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of the one text that f holds."""
    ids, vals = [], []
    for at, n in ((f.words, f.per[0]), (f.starts, f.per[0]), (f.trigrams[f.inside], f.n_trigrams[0])):
        a, c = np.unique(at, return_counts=True)
        ids.append(a)
        vals.append(c * _root(n))
    ids.append(f.variety)
    vals.append(np.ones(1))
    return np.concatenate(ids).astype(np.int32), np.concatenate(vals).astype(np.float32)


def _column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column end to end, without an object for each row, and how many each row has."""
    parts = [c for c in table.column(name).chunks if len(c)]
    flat, size = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for c in parts:
        off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) // np.dtype(kind).itemsize
        flat.append(np.frombuffer(c.buffers()[2], kind)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, kind))
        size.append(np.diff(off))
    return np.concatenate(flat), np.concatenate(size)


def learned(df: DataFrame, label: str, make, text: str = "text"):
    """make(labels, sparse rows) over a bounded sample (doc_id, label, text), in one task; what it returns comes to the driver.

    Features are made where the texts are, and the rows are put in an order that doesn't depend on partitions.
    """

    def features(batches):
        for b in blocks(batches, text, 1):
            ids, values = sparse(Features(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([ids.tobytes()], pa.binary()), pa.array([values.astype(np.float16).tobytes()], pa.binary())], ["key", "label", "ids", "vals"])

    def run(batches):
        got = pa.Table.from_batches(list(batches), schema=pa.schema({"key": pa.int64(), "label": pa.int32(), "ids": pa.binary(), "vals": pa.binary()}))
        keys, labels = got.column("key").to_numpy(), got.column("label").to_numpy()
        ids, size = _column(got, "ids", np.int32)
        vals, _ = _column(got, "vals", np.float16)
        start = np.cumsum(size) - size
        order = np.lexsort((size, labels, keys))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(make(labels[order], (ids, vals, start[order], size[order])))], pa.binary())})

    key = F.xxhash64(F.col("doc_id"), F.col(text)).alias("key")
    rows = df.select(key, F.col(label).cast("int").alias("label"), F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(features, "key long, label int, ids binary, vals binary")
    model = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(model[0]) if model else pickle.loads(next(run([])).column(0)[0].as_py())  # a plan known to be empty runs no task


class Batch:
    """Some rows of a sparse matrix."""

    def __init__(self, ids, vals, start, sizes, rows):
        size = sizes[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[rows] - (ends - size), size)
        self.row, self.n = np.repeat(np.arange(len(rows)), size), len(rows)
        self.vals = vals[at].astype(np.float64)
        self.own, self.at = np.unique(ids[at], return_inverse=True)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """rows @ w."""
        return np.bincount(self.row, weights=w[self.own][self.at] * self.vals, minlength=self.n)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        """rows.T @ g at the buckets ``own`` only; every other one is zero."""
        return np.bincount(self.at, weights=g[self.row] * self.vals, minlength=len(self.own))
