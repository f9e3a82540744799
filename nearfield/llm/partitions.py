"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into equally large parts that sever few edges; a small network learns to
predict the parts of a vector's neighbours. Every row is indexed under its most probable part. A query goes to its several
most probable parts, and all their rows are ranked exactly. How many parts suffices is measured: for a bounded set of
calibration vectors the true neighbours among all rows are found, and the least number is taken that reaches the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.samples import bounded
from nearfield.storage import materialise

#: Parts: at least so many, then one more for so many rows, up to a bound; and sampled vectors for each.
PARTS, PART_ROWS, MOST_PARTS = 16, 100_000, 256
SAMPLE_OF_PART = 250
GRAPH_DEGREE = 10
CALIBRATION = 256
TARGET = 0.95
#: Rows of a part and queries that meet in one task, and queries that it ranks at once.
SHARD_ROWS = 8192
QUERY_BLOCK = 16_384
AT_ONCE = 1024
#: Above the rounding error of a product of unit vectors.
_NEAR = 1e-9


def usable(column: str) -> F.Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    v = F.col(column)
    inf = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(col: pa.Array) -> np.ndarray:
    """(rows, dimension) in double precision from a list column of equal lengths."""
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors divided by the power of two above their largest component: exact, and squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    w = scaled(v)
    return w / np.sqrt((w * w).sum(axis=1, keepdims=True))


def neighbour_graph(u: np.ndarray, degree: int) -> np.ndarray:
    """The nearest rows of each row of unit vectors, by blocks."""
    degree = min(degree, len(u) - 1)
    out = np.empty((len(u), max(degree, 0)), np.int64)
    for i in range(0, len(u), 1024):
        s = u[i : i + 1024] @ u.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        if degree > 0:
            out[i : i + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(graph: np.ndarray, parts: int, sweeps: int = 30, seed: int = 1) -> np.ndarray:
    """A part for each node, by repeated halving; parts differ by one node at most (parts is a power of two).

    A half is found by smoothing random values over the graph (power iteration), splitting at the median, and then exchanging
    the pairs of nodes that gain most.
    """
    n = len(graph)
    label, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    size = 1
    while size < parts:
        same = label[src] == label[dst]
        a, b = src[same], dst[same]
        degree = np.maximum(np.bincount(a, minlength=n), 1)
        x = rng.standard_normal(n)
        for _ in range(sweeps):
            x = 0.5 * x + 0.5 * np.bincount(a, weights=x[b], minlength=n) / degree
            x -= (np.bincount(label, weights=x) / np.bincount(label))[label]
            x /= np.sqrt((np.bincount(label, weights=x * x) + 1e-30) / np.bincount(label))[label]
        order = np.lexsort((x, label))
        start = np.searchsorted(label[order], np.arange(size))
        count = np.bincount(label, minlength=size)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - start[label[order]]
        side = (place >= count[label] // 2).astype(np.int64)
        for _ in range(sweeps):  # exchange nodes that have more neighbours on the other side
            other = np.bincount(a, weights=side[a] != side[b], minlength=n)
            gain = 2 * other - degree
            moved = 0
            for part in range(size):
                here = np.flatnonzero(label == part)
                left, right = here[side[here] == 0], here[side[here] == 1]
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                m = min(len(left), len(right))
                good = np.flatnonzero(gain[left[:m]] + gain[right[:m]] > 1)
                m = min(len(good), max(1, len(here) // 50))
                side[left[:m]], side[right[:m]] = 1, 0
                moved += m
            if not moved:
                break
        label = label * 2 + side
        size *= 2
    return label


class Router:
    """One hidden layer; probabilities of parts for unit vectors."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.p = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim) * 2, np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]

    def _hidden(self, u):
        return np.maximum(u @ self.p[0] + self.p[1], 0)

    def probabilities(self, u: np.ndarray) -> np.ndarray:
        s = self._hidden(u) @ self.p[2] + self.p[3]
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, u: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3, seed: int = 4) -> None:
        """y: for each row, the distribution of its neighbours over the parts."""
        rng = np.random.default_rng(seed)
        m, s, i = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(u))
            for at in (order[j : j + batch] for j in range(0, len(u), batch)):
                i += 1
                h = self._hidden(u[at])
                e = h @ self.p[2] + self.p[3]
                e = np.exp(e - e.max(axis=1, keepdims=True))
                g = (e / e.sum(axis=1, keepdims=True) - y[at]) / len(at)
                gh = (g @ self.p[2].T) * (h > 0)
                for k, grad in enumerate((u[at].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    grad = grad + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad * grad
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.999**i)) + 1e-8)


def learn(sample: np.ndarray, parts: int = PARTS, degree: int = GRAPH_DEGREE) -> Router:
    """A router from sampled vectors; fewer parts if the sample is small."""
    u = unit(sample)
    while parts > 1 and parts * 8 > len(u):
        parts //= 2
    graph = neighbour_graph(u, degree)
    label = balanced_parts(graph, parts) if graph.shape[1] else np.zeros(len(u), np.int64)
    y = np.zeros((len(u), parts))
    own = np.concatenate([label[:, None], label[graph]], axis=1)
    np.add.at(y, (np.repeat(np.arange(len(u)), own.shape[1]), own.ravel()), 1 / own.shape[1])
    router = Router(u.shape[1], parts)
    router.fit(u, y)
    return router


def nearest(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, cosine) of the k nearest rows of each query, its own id left out; ties to the smaller id.

    A matrix product finds what may be among them; their cosines are then summed in an order that depends on the pair alone,
    so that equal vectors tie exactly.
    """
    s = unit(q) @ unit(v).T
    s[q_ids[:, None] == v_ids[None, :]] = -np.inf
    kth = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
    qi, vi = np.nonzero((s >= kth[:, None] - _NEAR) & np.isfinite(s))
    exact = np.empty(len(qi))
    q, v = scaled(q), scaled(v)
    qn, vn = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    for i in range(0, len(qi), 65536):
        a, b = qi[i : i + 65536], vi[i : i + 65536]
        exact[i : i + 65536] = (q[a] * v[b]).sum(axis=1) / (qn[a] * vn[b])
    order = np.lexsort((v_ids[vi], -exact, qi))
    qi, vi, exact = qi[order], vi[order], exact[order]
    first = np.searchsorted(qi, qi)
    keep = np.arange(len(qi)) - first < k
    return qi[keep], v_ids[vi[keep]], exact[keep]


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def calibrate(index: DataFrame, router: Router, k: int, target: float = TARGET, most: int = CALIBRATION) -> tuple[int, float]:
    """(parts to visit, share of true neighbours in them) for calibration vectors against every row of the index."""
    rows = bounded(index, "vec_id", most).select("vec_id", "embedding").orderBy("vec_id").collect()
    q, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows], np.int64)
    n_parts = len(router.p[3])
    if not len(rows):
        return n_parts, 1.0
    shared = index.sparkSession.sparkContext.broadcast((q, ids))

    def scan(batches):
        q, ids = shared.value
        for b in batches:
            for i in range(0, b.num_rows, SHARD_ROWS):
                c = b.slice(i, SHARD_ROWS)
                if c.num_rows:
                    v_ids, part = c.column(0).to_numpy(), c.column(2).to_numpy()
                    qi, near, score = nearest(q, ids, matrix(c.column(1)), v_ids, k)
                    order = np.argsort(v_ids, kind="stable")
                    at = order[np.searchsorted(v_ids, near, sorter=order)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(near), pa.array(score), pa.array(part[at])], ["query_id", "vec_id", "score", "part"])

    found = index.select("vec_id", "embedding", "part").mapInArrow(scan, "query_id long, vec_id long, score double, part int")
    true = _top(found, k).select("query_id", "part").collect()
    order = np.argsort(-router.probabilities(unit(q)), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n_parts)[None, :], axis=1)
    row = {i: r for r, i in enumerate(ids.tolist())}
    need = np.array([place[row[r[0]], r[1]] for r in true]) if true else np.zeros(1, int)
    share = np.cumsum(np.bincount(need, minlength=n_parts)) / len(need)
    visit = int(np.searchsorted(share, target) + 1)
    return min(visit, n_parts), float(share[min(visit, n_parts) - 1])


def build(vectors: DataFrame, parts: int | None = None, sample: int | None = None) -> tuple[DataFrame, Router | None]:
    """(vec_id, embedding, part) for every usable row, written to the shared folder, and the router.

    The number of parts follows the number of rows, unless it is given; the sample follows the number of parts, and both are bounded.

    vec_id and embedding are the columns used. Null ids take no part. All vectors must have the dimension that most have;
    others take no part either.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable("embedding") & F.col("vec_id").isNotNull())
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    parts = parts or min(MOST_PARTS, max(PARTS, dims[0]["count"] // PART_ROWS if dims else 0))
    sample = sample or parts * SAMPLE_OF_PART
    if not dims:
        return rows.withColumn("part", F.lit(0)), None
    rows = rows.where(F.size("embedding") == dims[0]["d"])
    got = bounded(rows, "vec_id", sample).orderBy("vec_id").collect()
    router = learn(np.array([r[1] for r in got]), parts) if got else Router(dims[0]["d"], 1)
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                part = shared.value.probabilities(unit(matrix(b.column(1)))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], ["vec_id", "embedding", "part"])

    return materialise(rows.mapInArrow(assign, "vec_id long, embedding array<double>, part int"), "ann-index"), router


def search(index: DataFrame, router: Router, queries: DataFrame, k: int, visit: int, shard_rows: int = SHARD_ROWS, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query (vec_id, embedding), itself left out.

    Rows of a part are dealt to shards of bounded size and queries to blocks; a task ranks one block against one shard. Fewer
    than k rows for a query only if its parts hold fewer (see ``find``). Repeated rows of the index count each, repeated queries once.
    """
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((router, visit))
    sizes = {r[0]: r[1] for r in index.groupBy("part").count().collect()}
    shards = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, -(-n // shard_rows))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    n_blocks = max(1, -(-queries.count() // block))

    def route(batches):
        router, visit = shared.value
        for b in batches:
            if b.num_rows:
                p = router.probabilities(unit(matrix(b.column(1))))
                top = np.argsort(-p, axis=1, kind="stable")[:, :visit].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(top), pa.list_(pa.int32()))], ["vec_id", "embedding", "parts"])

    n_shards = F.element_at(shards, F.col("part"))
    q = queries.dropDuplicates(["vec_id"]).select("vec_id", "embedding").mapInArrow(route, "vec_id long, embedding array<double>, parts array<int>")
    q = q.select("vec_id", "embedding", F.explode("parts").alias("part")).where(F.array_contains(F.map_keys(shards), F.col("part")))
    q = q.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(n_blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), n_shards.cast("int") - 1)))
    v = index.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.xxhash64("embedding")), n_shards).cast("int"))
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    keys = ["part", "shard", "block"]

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, vid = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        if not len(qid) or not len(vid):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = matrix(left.column("embedding").combine_chunks()), matrix(right.column("embedding").combine_chunks())
        out = [nearest(q[i : i + AT_ONCE], qid[i : i + AT_ONCE], v, vid, k) for i in range(0, len(qid), AT_ONCE)]
        ids = [qid[i * AT_ONCE + qi] for i, (qi, _, _) in enumerate(out)]
        return pa.table({"query_id": np.concatenate(ids), "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")


def find(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by ``every``, among all other rows; all of them, if there are fewer.

    A query whose parts hold fewer than k other rows is asked again in all parts. calibrated_recall is the share of true
    neighbours that the visited parts held for the calibration vectors.
    """
    index, router = build(vectors)
    if router is None:
        return index.select(F.col("vec_id").alias("query_id"), F.col("part").alias("rank"), "vec_id", F.lit(0.0).alias("score"), F.lit(1.0).alias("calibrated_recall"))
    visit, share = calibrate(index, router, k)
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0)
    found = search(index, router, queries, k, visit)
    if visit < len(router.p[3]):
        found = materialise(found, "ann-found")
        short = queries.select("vec_id", "embedding").join(found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        short = materialise(short, "ann-short")
        if not short.isEmpty():
            again = search(index, router, short, k, len(router.p[3]))
            found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(found.columns).union(again)
    return found.withColumn("calibrated_recall", F.lit(share))


def query(spark, sf_dir: str) -> DataFrame:
    """op3_ann_partitions: 5 nearest of every fiftieth vector."""
    return find(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
