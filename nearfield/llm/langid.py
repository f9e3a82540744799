"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Each direction is a gated recurrent unit whose input is a byte's embedding; every position gets a distribution over the
languages from both states, and a document's probabilities are the mean over its positions. Texts are cut into segments of
``SEGMENT`` bytes at which both directions start anew, so any length costs time in proportion and bounded memory, and
segments of many texts run side by side. Weights are trained here by backpropagation through time on a bounded sample.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.samples import hashed, share_of
from nearfield.llm.text import blocks, offsets_of

SEGMENT = 128
HIDDEN = 10
SAMPLE = 3000
STEPS = 120
BATCH = 256
UND = "und"
#: Labels that can be learned, at most.
LANGUAGES = 1000


class BiGru:
    """Weights, the forward pass, and training.

    Gates use a logistic function written as (1 + tanh(x)) / 2, the halves being part of the weights:
    z, r = tanh of (byte row + state @ u); n = tanh(byte row + (1 + r) * (state @ u)); state = n + (1 + z) / 2 * (state - n).
    """

    def __init__(self, n_lang: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.h, self.k = hidden, n_lang
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(f)
            self.p[f"u{d}"] = (rng.standard_normal((hidden, 3 * hidden)) * 0.5 / np.sqrt(hidden)).astype(f)
            self.p[f"c{d}"] = (rng.standard_normal((hidden, n_lang)) * 0.3).astype(f)
        self.p["bias"] = np.zeros(n_lang, f)

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        """States for bytes x (time, batch) in the order given; with keep, also what the backward pass needs."""
        w, u, h = self.p[f"w{d}"], self.p[f"u{d}"], self.h
        t_max, n = x.shape
        out = np.empty((t_max, n, h), np.float32)
        g, a = np.empty((n, 3 * h), np.float32), np.empty((n, 3 * h), np.float32)
        state, kept = np.zeros((n, h), np.float32), []
        for t in range(t_max):
            np.take(w, x[t], axis=0, out=g, mode="clip")
            np.matmul(state, u, out=a)
            zr = g[:, : 2 * h]
            zr += a[:, : 2 * h]
            np.tanh(zr, out=zr)
            z, r, c = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            r += 1
            c += r * a[:, 2 * h :]
            np.tanh(c, out=c)
            if keep:
                kept.append((z.copy(), r.copy(), c.copy(), a[:, 2 * h :].copy(), state))
            z += 1
            z *= 0.5
            new = out[t]
            np.subtract(state, c, out=new)
            new *= z
            new += c
            state = new
        return out, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, language) for bytes (time, batch)."""
        t, n = x.shape
        s = self._run(x, "f")[0].reshape(t * n, self.h) @ self.p["cf"]
        s = s.reshape(t, n, self.k)
        s += (self._run(x[::-1], "b")[0].reshape(t * n, self.h) @ self.p["cb"]).reshape(t, n, self.k)[::-1]
        s += self.p["bias"]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        return s

    def _back(self, x, d, kept, grad_out, grads):
        """Add the gradients of one direction, given those of its states."""
        h, u = self.h, self.p[f"u{d}"]
        gw, gu = grads[f"w{d}"], grads[f"u{d}"]
        carry = np.zeros_like(grad_out[0])
        pre = np.empty((x.shape[0], x.shape[1], 3 * h), np.float32)
        for t in range(x.shape[0] - 1, -1, -1):
            z, r, c, a, state = kept[t]
            gh = grad_out[t] + carry
            keep = (1 + z) * 0.5
            gc = gh * (1 - keep) * (1 - c * c)
            gz = gh * (state - c) * 0.5 * (1 - z * z)
            gr = gc * a * (1 - (r - 1) * (r - 1))
            p = pre[t]
            p[:, :h], p[:, h : 2 * h], p[:, 2 * h :] = gz, gr, gc
            ga = p.copy()
            ga[:, 2 * h :] *= r
            gu += state.T @ ga
            carry = gh * keep + ga @ u.T
        flat, rows = x.ravel(), pre.reshape(-1, 3 * h)
        order = np.argsort(flat, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(flat[order].astype(int)) != 0])
        gw[flat[order][at]] += np.add.reduceat(rows[order], at, axis=0)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the masked positions, and its gradient by backpropagation through time."""
        t, n = x.shape
        hf, kf = self._run(x, "f", True)
        hb, kb = self._run(x[::-1], "b", True)
        s = hf @ self.p["cf"] + (hb @ self.p["cb"])[::-1] + self.p["bias"]
        s -= s.max(axis=2, keepdims=True)
        e = np.exp(s)
        e /= e.sum(axis=2, keepdims=True)
        cols = np.arange(n)
        total = max(mask.sum(), 1)
        loss = float(-(np.log(e[:, cols, y] + 1e-9) * mask).sum() / total)
        e[:, cols, y] -= 1
        e *= (mask / total)[:, :, None]
        e = e.astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = e.reshape(-1, self.k)
        back = e[::-1]
        grads["cf"] += hf.reshape(-1, self.h).T @ flat
        grads["cb"] += hb.reshape(-1, self.h).T @ back.reshape(-1, self.k)
        grads["bias"] += flat.sum(axis=0)
        self._back(x, "f", kf, e @ self.p["cf"].T, grads)
        self._back(x[::-1], "b", kb, back @ self.p["cb"].T, grads)
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.03, seed: int = 5) -> list[float]:
        """Adam over random batches of segments (time, segments); returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            at = rng.integers(0, x.shape[1], min(batch, x.shape[1]))
            loss, grads = self.gradients(np.ascontiguousarray(x[:, at]), y[at], mask[:, at])
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step = rate * min(1.0, 3 * (1 - i / (steps + 1)))
            for k, g in grads.items():
                g *= min(1.0, 1.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] -= (step * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
        return losses


def segments(data: np.ndarray, off: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes (time, segments), length of each segment, segments of each text); short ones are filled up with zero bytes."""
    size = np.diff(off)
    per = -(-size // length)
    text = np.repeat(np.arange(len(size)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = off[:-1][text] + k * length
    n = np.minimum(length, off[1:][text] - start)
    at = start[None, :] + np.arange(length)[:, None]
    x = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.uint8)
    x[np.arange(length)[:, None] >= n[None, :]] = 0
    return x, n, per


def pooled(model: BiGru, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean position probabilities of each text (zeros for an empty one)."""
    x, n, per = segments(data, off)
    out = np.zeros((len(off) - 1, model.k))
    if x.shape[1]:
        total = np.empty((x.shape[1], model.k))
        for i in range(0, x.shape[1], 4096):
            p = model.probabilities(x[:, i : i + 4096])
            p[np.arange(x.shape[0])[:, None] >= n[None, i : i + 4096]] = 0
            total[i : i + 4096] = p.sum(axis=0)
        np.add.at(out, np.repeat(np.arange(len(per)), per), total)
        size = np.diff(off)
        out[size > 0] /= size[size > 0, None]
    return out


def _held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS, hidden: int = HIDDEN) -> tuple[list[str], BiGru | None]:
    """Languages and a trained network, from at most about ``sample`` labelled ids outside the held-out part.

    Every language gets an equal part of the sample, so that a rare one is learned too; an id that several rows have counts
    once, with its least text. Of each text a few segments, chosen by its id, are learned, in one task. Without any labelled
    text there is no network. More than LANGUAGES labels raise ValueError.
    """
    train = docs.where(~_held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", F.col("text"))
    known = sorted(r[0] for r in train.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not known:
        return [], None
    each = max(1, sample // len(known))
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    bound = F.coalesce(*[F.when(F.col("lang") == v, share_of(each, counts[v])) for v in known])
    rows = train.where(hashed("doc_id") < bound).where(F.col("text").rlike(r"\p{L}")).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("k"), "lang", "text")

    def pick(batches):  # a bounded piece of each text leaves the executors: six segments from places that the id decides
        for b in blocks(batches, "text"):
            out: dict[str, list] = {"k": [], "lang": [], "seg": []}
            for k, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                n = max(1, -(-len(raw) // SEGMENT))
                for j in np.random.default_rng(k % (1 << 32)).permutation(n)[:6].tolist():
                    out["k"].append(k)
                    out["lang"].append(lang)
                    out["seg"].append(raw[j * SEGMENT : (j + 1) * SEGMENT])
            yield pa.RecordBatch.from_pydict({"k": pa.array(out["k"], pa.int64()), "lang": pa.array(out["lang"], pa.string()), "seg": pa.array(out["seg"], pa.binary())})

    def learn(batches):
        got = sorted(zip(*([x for b in batches for x in b.column(i).to_pylist()] for i in range(3)), strict=True)) if (batches := list(batches)) else []
        model = BiGru(len(known), hidden)
        if got:
            data = np.frombuffer(b"".join(x[2] for x in got), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(x[2]) for x in got])])
            x, n, per = segments(data, off)
            number = {v: i for i, v in enumerate(known)}
            y = np.repeat(np.array([number[x[1]] for x in got]), per)
            model.train(x, y, (np.arange(SEGMENT)[:, None] < n[None, :]).astype(np.float32), steps)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    got = rows.mapInArrow(pick, "k long, lang string, seg binary").repartition(1).mapInArrow(learn, "model binary").first()
    return known, pickle.loads(got[0]) if got else BiGru(len(known), hidden)


def identify(docs: DataFrame, known: list[str], model: BiGru | None, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text is looked at.

    ``und`` with score 0 for a null text, one without a letter, and for every text if nothing was learned. Among equal
    probabilities the first language in order wins. Repeated rows get the same answer; other columns are ignored.
    """
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.when(lettered, F.col(text)).alias(text))
    shared = docs.sparkSession.sparkContext.broadcast((known, model))

    def label(batches):
        names, net = shared.value
        for b in blocks(batches, text, 1 << 19):
            col = b.column(2)
            off = offsets_of(col)
            p = np.zeros((b.num_rows, 1))
            if net is not None and off[-1] > off[0]:
                p = pooled(net, np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0])
            best = p.argmax(axis=1)
            score = np.clip(p[np.arange(len(p)), best], 0, 1)
            given = (np.diff(off) > 0) & (net is not None)
            pred = [names[i] if ok else UND for i, ok in zip(best.tolist(), given.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.where(given, score, 0.0))})

    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op1_language_id over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known, model = fit(docs)
    return identify(docs, known, model)
