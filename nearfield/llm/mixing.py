"""Mixing to target weights with soft membership.

A softmax classifier learned from the labelled table gives every document a posterior over domains. Nonnegative document rates
r are then fitted so that the expected tokens of each domain, S(r) = sum of r_i * tokens_i * p_i, meet the targets T: projected
gradient descent on the least squares of S(r) - T, weighted by the inverse of the domains' second moments over the rates that
are free to move, from r = 1. A pass over the posteriors gives S and these moments, whose size is that of the list of domains,
and the rates are never stored: a document's rate is replayed from the few vectors of earlier passes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.bpe import token_counts
from nearfield.llm.features import SIZE, Batch, Features, learned
from nearfield.llm.samples import bounded, texts_of
from nearfield.llm.text import blocks
from nearfield.storage import materialise

#: Domains in order, and the share of tokens that the query asks for.
DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.95, "poor": 0.05, "toxic": 0.0}
PER_DOMAIN = 700
PASSES = 25
CLOSE = 1e-4
RIDGE = 1e-3


Target = Callable[[np.ndarray], np.ndarray]


def shares(wanted: dict[str, float], names: tuple[str, ...] = DOMAINS) -> Target:
    """As many tokens in all as there are, in the given shares (scaled to sum 1; a domain not named gets none)."""
    w = np.array([wanted.get(n, 0.0) for n in names])
    return lambda s: w / w.sum() * s.sum()


def tempered(power: float) -> Target:
    """Shares in proportion to the power of the tokens there are, scaled up so that no domain loses any: rare domains repeat."""

    def target(s: np.ndarray) -> np.ndarray:
        w = np.where(s > 0, np.maximum(s, 1e-300) ** power, 0.0)
        w /= w.sum()
        return w * np.max(s[w > 0] / w[w > 0])

    return target


def languages_of(docs: DataFrame) -> tuple[tuple[str, ...], DataFrame]:
    """The languages that documents are labelled with, and (doc_id, domain) with their numbers."""
    names = tuple(r[0] for r in docs.where("lang IS NOT NULL").select("lang").distinct().orderBy("lang").collect())
    number = F.coalesce(*[F.when(F.col("lang") == n, i) for i, n in enumerate(names)]) if names else F.lit(None).cast("int")
    return names, docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id", number.alias("domain")).groupBy("doc_id").agg(F.max("domain").alias("domain"))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): poor for quality 0, else toxic or clean; the last in the order of DOMAINS wins for repeated rows."""
    d = F.when(F.col("quality") == 0, 1).when(F.coalesce(F.col("toxic"), F.lit(0)) != 0, 2).otherwise(0)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", d.alias("domain")).groupBy("doc_id").agg(F.max("domain").alias("domain"))


class Softmax:
    def __init__(self, k: int):
        self.w, self.b = np.zeros((SIZE, k), np.float64), np.zeros(k)

    def _posterior(self, s: np.ndarray) -> np.ndarray:
        s = s + self.b
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    def posteriors(self, f: Features) -> np.ndarray:
        return self._posterior(f.scores(self.w))

    def fit(self, y, sparse_rows, share: np.ndarray, epochs: int = 15, batch: int = 128, rate: float = 1.0, decay: float = 3e-5, seed: int = 9) -> None:
        """share: the domains' part of the labelled table; sampled rows are weighted to it, so that posteriors fit the table."""
        n, k = len(y), self.w.shape[1]
        if not n:
            return
        rng, weight = np.random.default_rng(seed), (share / np.maximum(np.bincount(y, minlength=k) / n, 1e-9))[y]
        square, side = np.full(self.w.shape, 1e-3), np.full(k, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                rows = order[i : i + batch]
                b = Batch(*sparse_rows, rows)
                g = self._posterior(np.stack([b.dot(self.w[:, j]) for j in range(k)], axis=1))
                g[np.arange(len(rows)), y[rows]] -= 1
                g *= (weight[rows] / len(rows))[:, None]
                gw = np.stack([b.transposed(g[:, j]) for j in range(k)], axis=1) + decay * self.w[b.own]
                square[b.own] += gw * gw
                self.w[b.own] -= rate * gw / np.sqrt(square[b.own])
                gb = g.sum(axis=0)
                side += gb * gb
                self.b -= rate * gb / np.sqrt(side)


def fit_classifier(docs: DataFrame, labelled: DataFrame, k: int = len(DOMAINS), per_domain: int = PER_DOMAIN) -> Softmax | None:
    """From (doc_id, domain) rows, at most about ``per_domain`` of each; None if no labelled document is there."""
    counts = {r[0]: r[1] for r in labelled.groupBy("domain").count().collect()}
    total = sum(counts.values())
    if not total or not k:
        return None
    sample = reduce(DataFrame.union, [bounded(labelled.where(F.col("domain") == d), "doc_id", per_domain) for d in range(k)])
    share = np.array([counts.get(d, 0) / total for d in range(k)])

    def make(y, rows):
        if not len(y):
            return None
        model = Softmax(k)
        model.fit(y, rows, share)
        return model

    return learned(texts_of(docs, sample.select("doc_id", "domain")), "domain", make)


def with_posteriors(docs: DataFrame, model: Softmax | None, keep: list[str], text: str = "text", k: int = len(DOMAINS), ranks: str | None = None) -> DataFrame:
    """The columns ``keep`` (by position, as c0, c1, ...), n_tokens, and p0, p1, ...; all the first domain without a model.

    ranks: a vocabulary file, by which tokens are counted; without it they are words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        m = shared.value
        for b in blocks(batches, "text_"):
            f = Features(b.column(b.num_columns - 1))
            p = np.eye(1, k).repeat(b.num_rows, axis=0) if m is None else m.posteriors(f)
            cols = [b.column(i) for i in range(len(fields))] + [pa.array(f.n_words.astype(np.int64) if ranks is None else token_counts(b.column(b.num_columns - 1).to_pylist(), ranks))] + [pa.array(np.ascontiguousarray(p[:, j])) for j in range(k)]
            yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(fields))] + ["n_tokens"] + [f"p{j}" for j in range(k)])

    inner = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "n_tokens long", *(f"p{j} double" for j in range(k))])
    return docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("text_")).mapInArrow(run, inner)


def _along(v: np.ndarray) -> F.Column:
    """How far a step takes a rate down."""
    return reduce(lambda a, b: a + b, [F.col(f"p{j}") * float(x) for j, x in enumerate(v)])


def _rate(steps: list[np.ndarray], least: float = 0.0) -> F.Column:
    """The rate after the steps, from p0, p1, ...: each moves against the gradient and is projected onto r >= least."""
    r = F.lit(1.0)
    for v in steps:
        r = F.greatest(F.lit(least), r - _along(v))
    return r


class Fit(NamedTuple):
    """steps: what ``_rate`` replays; gaps: what is left to the targets after each pass, as a share of the tokens; wanted and
    reached: expected tokens of each domain."""

    steps: list[np.ndarray]
    gaps: list[float]
    wanted: list[float]
    reached: list[float]


def fit_rates(table: DataFrame, target: Target, k: int, passes: int = PASSES, close: float = CLOSE, least: float = 0.0) -> Fit:
    """Rates of at least ``least`` that bring the domains' expected tokens to their targets.

    table: n_tokens and p0, p1, ...; target: from the expected tokens of each domain, those to reach. No tokens: no steps. A
    domain of which no document has any posterior can't be met; the rest is fitted as well as least squares allow, and the last
    gap says how well that is.
    """
    t, p = F.col("n_tokens").cast("double"), [F.col(f"p{j}") for j in range(k)]
    steps: list[np.ndarray] = []
    gaps: list[float] = []
    reached: list[list[float]] = []
    n, goal = 0.0, np.zeros(k)
    while True:
        r = _rate(steps, least)
        # a rate at its bound doesn't answer to a step, unless the last one went away from the bound
        moving = F.when((r > least) | (_along(steps[-1]) < 0), t).otherwise(0.0) if steps else t
        sums = [F.sum(t).alias("n"), *[F.sum(t * r * a).alias(f"s{j}") for j, a in enumerate(p)]]
        row = table.agg(*sums, *[F.sum(moving * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).collect()[0]
        if not row["n"]:
            return Fit([], [], [0.0] * k, [0.0] * k)
        s = np.array([row[f"s{j}"] for j in range(k)])
        if not steps:
            n, goal = row["n"], target(s)
        gaps.append(float(np.abs(s - goal).sum() / n))
        reached.append(s.tolist())
        stuck = len(gaps) > 6 and gaps[-1] > 0.999 * gaps[-4]
        if gaps[-1] <= close or len(steps) >= passes or stuck:
            best = int(np.argmin(gaps))
            return Fit(steps[:best], gaps[: best + 1], goal.tolist(), reached[best])
        h = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n
        damp = RIDGE * max(np.trace(h) / k, 1e-12) * np.eye(k)  # domains that hardly move get small steps
        steps.append(np.linalg.solve(h + damp, (s - goal) / n))


def _copies(rate: F.Column, key: F.Column) -> F.Column:
    """The rate rounded down or up to a whole number of copies, by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit(29), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def rates(docs: DataFrame, labelled: DataFrame, target: Target, names: tuple[str, ...] = DOMAINS, model: Softmax | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies and gap of every row; gap: what is left to all targets, as a share of the tokens.

    n_tokens is 0 for a null text, whose rate still follows from its posterior. Repeated rows get equal rates. Without a
    labelled document every posterior is that of the first domain. Other columns are ignored; an empty table gives no rows.
    """
    k = len(names)
    model = model or fit_classifier(docs, labelled, k)
    table = materialise(with_posteriors(docs, model, ["doc_id"], k=k, ranks=ranks), "mixing-posteriors")
    fit = fit_rates(table, target, k)
    gap = F.lit(fit.gaps[-1] if fit.gaps else 0.0)
    return table.select(F.col("c0").cast("long").alias("doc_id"), "n_tokens", *[F.col(f"p{j}").alias(f"p_{d}") for j, d in enumerate(names)], _rate(fit.steps).alias("rate"), _copies(_rate(fit.steps), F.col("c0")).alias("copies"), gap.alias("gap"))


def totals(docs: DataFrame, labelled: DataFrame, target: Target, names: tuple[str, ...] = DOMAINS) -> DataFrame:
    """domain, wanted_tokens and reached_tokens: the targets and what the fitted rates are expected to give."""
    k = len(names)
    fit = fit_rates(materialise(with_posteriors(docs, fit_classifier(docs, labelled, k), ["doc_id"], k=k), "mixing-posteriors"), target, k)
    return docs.sparkSession.createDataFrame(list(zip(names, fit.wanted, fit.reached, strict=True)), "domain string, wanted_tokens double, reached_tokens double")


def mix(docs: DataFrame, labelled: DataFrame, target: Target, names: tuple[str, ...] = DOMAINS, least: float = 0.0, ranks: str | None = None) -> DataFrame:
    """The rows of docs, each as many times as its rate says, with the columns of docs. Nothing is shuffled.

    Rates are at least ``least``: with 1, no row is lost, and a domain with more tokens than its share is met by repeating the others.
    """
    k, n = max(1, len(names)), len(docs.columns)
    table = materialise(with_posteriors(docs, fit_classifier(docs, labelled, len(names)), docs.columns, k=k, ranks=ranks), "mixing-documents")
    fit = fit_rates(table, target, k, least=least)
    times = _copies(_rate(fit.steps, least), F.col(f"c{docs.columns.index('doc_id')}"))
    once = table.select(*[f"c{i}" for i in range(n)], times.alias("times")).where("times > 0")
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op2_mixing over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rates(docs, domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), shares(TARGETS))
