"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= j | x) = logistic(w.x - t_j) with one weight vector w over hashed text and ordered thresholds t_1 < t_2 < ...
It gives each document an expected grade and, for selection, the probability of reaching a chosen grade.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.features import SIZE, Batch, Features, learned
from nearfield.llm.samples import bounded, texts_of
from nearfield.llm.text import blocks

#: Rows of each grade that are learned, at most about.
PER_GRADE = 2000
TAIL_GRADE = 2
MIN_TAIL = 0.4


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from ratings: 0 for bad quality, 1 for good but toxic, 2 for good and not toxic; the least of repeated ones.

    Rows without doc_id or quality are left out; a null toxic counts as 0.
    """
    bad, toxic = F.col("quality") == 0, F.coalesce(F.col("toxic"), F.lit(0)) != 0
    grade = F.when(bad, 0).when(toxic, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """w, and thresholds kept in order as a first value and the logarithms of the gaps."""

    def __init__(self, n_grades: int):
        self.w = np.zeros(SIZE)
        self.first, self.gaps = 0.0, np.zeros(max(n_grades - 2, 0))

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... by column."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])

    def fit(self, y, sparse_rows, epochs: int = 20, batch: int = 128, rate: float = 1.0, decay: float = 3e-5, seed: int = 3) -> None:
        rng, n = np.random.default_rng(seed), len(y)
        if not n:
            return
        top = len(self.gaps) + 1
        weight = n / np.maximum(np.bincount(y, minlength=top + 1), 1)[y] / (top + 1)  # every grade counts alike
        square, side = np.full(SIZE, 1e-3), np.full(top, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                rows = order[i : i + batch]
                b = Batch(*sparse_rows, rows)
                s = b.dot(self.w)
                upper = np.concatenate([np.ones((len(rows), 1)), self.tails(s), np.zeros((len(rows), 1))], axis=1)
                at = np.arange(len(rows))
                hi, lo = upper[at, y[rows]], upper[at, y[rows] + 1]
                p = np.maximum(hi - lo, 1e-9)
                slope = upper * (1 - upper)  # of each tail in s
                scale = weight[rows] / len(rows)
                gs = -(slope[at, y[rows]] - slope[at, y[rows] + 1]) / p * scale
                gt = np.zeros((len(rows), top + 2))
                gt[at, y[rows]] += slope[at, y[rows]] / p * scale
                gt[at, y[rows] + 1] -= slope[at, y[rows] + 1] / p * scale
                g_t = gt.sum(axis=0)[1 : top + 1]
                g = b.transposed(gs) + decay * self.w[b.own]
                square[b.own] += g * g
                self.w[b.own] -= rate * g / np.sqrt(square[b.own])
                own = np.concatenate([[g_t.sum()], np.exp(self.gaps) * np.cumsum(g_t[::-1])[::-1][1:]])
                side += own * own
                step = rate * own / np.sqrt(side)
                self.first -= step[0]
                self.gaps -= step[1:]


def fit(docs: DataFrame, rated: DataFrame, n_grades: int = 3, per_grade: int = PER_GRADE) -> Ordinal | None:
    """From documents and (doc_id, grade); None without a rated document. A rated id counts once, with its least text."""
    sample = reduce(DataFrame.union, [bounded(rated.where(F.col("grade") == g), "doc_id", per_grade) for g in range(n_grades)])

    def make(y, rows):
        if not len(y):
            return None
        model = Ordinal(n_grades)
        model.fit(y, rows)
        return model

    return learned(texts_of(docs, sample.select("doc_id", "grade")), "grade", make)


def _grade_batches(shared, text: str, carry: int):
    def grade(batches):
        model, tail_grade, min_tail = shared.value
        for b in blocks(batches, text):
            w = Features(b.column(b.num_columns - 1))
            if model is None:
                tails = np.ones((b.num_rows, max(tail_grade, 1)))
            else:
                tails = model.tails(w.scores(model.w[:, None])[:, 0])
            tails = np.where((w.n_words > 0)[:, None], tails, 0.0)
            tail = tails[:, tail_grade - 1]
            out = [b.column(i) for i in range(carry)]
            yield out, tails.sum(axis=1), tail, (w.n_words > 0) & (tail >= min_tail)

    return grade


def rate(docs: DataFrame, model: Ordinal | None, tail_grade: int = TAIL_GRADE, min_tail: float = MIN_TAIL, text: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of reaching tail_grade) and kept of every row.

    A text that is null or has no word gets 0, 0 and false; without a model every other text gets the highest values and is
    kept. Repeated rows get equal results, a probability just at the bound is kept, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, tail_grade, min_tail))
    grade = _grade_batches(shared, text, 1)

    def run(batches):
        for (doc_id,), expected, tail, kept in grade(batches):
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(expected), pa.array(tail), pa.array(kept)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, model: Ordinal | None, tail_grade: int = TAIL_GRADE, min_tail: float = MIN_TAIL, text: str = "text") -> DataFrame:
    """The rows that ``rate`` keeps, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast((model, tail_grade, min_tail))
    n, schema = len(docs.columns), docs.schema
    grade = _grade_batches(shared, text, n)

    def run(batches):
        for cols, _, _, kept in grade(batches):
            yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(n)]).filter(pa.array(kept))

    # columns go by position, so that names that clash don't matter; the text comes once more at the end
    named = docs.toDF(*[f"c{i}" for i in range(n)])
    at = docs.columns.index(text)
    inner = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    return named.select("*", F.col(f"c{at}").alias(text)).mapInArrow(run, inner).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4_quality_classifier over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rate(docs, model)
