"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A text's shingles are its runs of five words of letters and digits in lower case (ASCII signs part words), weighted by how
often they occur. Every shingle is the source of a Poisson process whose rate is its weight; each arrival goes to a random
register, and a register keeps the earliest. Registers of two texts agree with the probability Jaccard similarity of their
weights. A process is followed no further than the latest register value so far, since later arrivals can change nothing.

Candidates share all registers of a band. Rounds whose work follows the number of texts connect most of a group of copies, and
what they leave open is compared in full, by pairs in small buckets and by bounded chunks in large ones (see ``link``). A link
counts only after the exact similarity has been computed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import FOLDED_WITH_DIGITS, U64, Words, blocks, mix, per_text, windows
from nearfield.operators.components import components
from nearfield.storage import materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Pairs whose share of equal registers is below this are not compared exactly: five standard deviations under the threshold.
SLACK = 5 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
#: Up to this size, every pair of a bucket that the rounds leave unconnected is compared.
SMALL_BUCKET = 64
#: Pivots of a bucket in a round, and rounds at most; they save comparisons but decide nothing.
PIVOTS = 3
ROUNDS = 3
#: Texts of a chunk; two chunks are compared in one task.
CHUNK = 256


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> U64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def shingle_counts(col: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count) of the distinct shingles of each text in order of hash, how many each text has, and a hash of its words.

    A text of fewer than n words, but one at least, has one shingle made of all of them; without words it has none.
    """
    w = Words(col, FOLDED_WITH_DIGITS)
    h = w.hashes()
    keys, at = windows(h, w.per, n)
    texts = w.text_of()
    own = texts[at] if len(at) else np.zeros(0, np.int64)
    place = np.arange(len(h)) - np.repeat(np.cumsum(w.per) - w.per, w.per)
    whole = mix(h + mix(place.astype(U64)))
    cum = np.zeros(len(h) + 1, U64)
    np.cumsum(whole, out=cum[1:])
    ends = np.cumsum(w.per)
    digest = mix(cum[ends] - cum[ends - w.per] + w.per.astype(U64))
    short = np.flatnonzero((w.per > 0) & (w.per < n))
    keys, own = np.concatenate([keys, digest[short]]), np.concatenate([own, short])
    order = np.lexsort((keys, own))
    keys, own = keys[order], own[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(keys)))
    return keys[first], counts, np.bincount(own[first], minlength=len(w.per)), digest


def signatures(keys: np.ndarray, counts: np.ndarray, per: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (texts, m): the low 32 bits of the hash of the shingle that came first; 0 throughout without shingles."""
    n = len(per)
    best, who = np.full(n * m, np.inf), np.zeros(n * m, np.uint32)
    text = np.repeat(np.arange(n), per)
    live = np.arange(len(keys))
    time = np.zeros(len(keys))
    rate = counts.astype(np.float64)
    k = 0
    while len(live):
        salt = U64(0x632BE59BD9B4E019 * (2 * k + 1) % 2**64)
        seed = mix(keys[live] + salt)
        time[live] -= np.log(_uniform(seed)) / rate[live]
        if k:  # an arrival after the latest register of its text changes nothing, and neither do later ones
            live = live[time[live] < best.reshape(n, m).max(axis=1)[text[live]]]
            seed = mix(keys[live] + salt)
        register = text[live] * m + (mix(seed ^ U64(0x8CB92BA72F3D8DD7)) % U64(m)).astype(np.int64)
        order = np.lexsort((keys[live], time[live], register))
        r = register[order]
        lead = order[np.r_[True, r[1:] != r[:-1]]] if len(r) else order
        won = lead[time[live[lead]] < best[register[lead]]]
        best[register[won]] = time[live[won]]
        who[register[won]] = keys[live[won]].astype(np.uint32) | np.uint32(1)
        k += 1
    return who.reshape(n, m)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard similarity of sorted keys a with weights x and b with y: the sum over common i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    if not len(a) or not len(b):
        return 0.0
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    xs, ys = x[ia].astype(np.float64), y[ib].astype(np.float64)
    ratio = xs / ys
    order = np.argsort(ratio, kind="stable")
    xs, ys, ratio = xs[order], ys[order], ratio[order]
    # x_j / x_i is the larger where x_j / y_j >= x_i / y_i; shingles of one text only are always their own maximum
    above = np.append(np.cumsum(xs[::-1])[::-1], 0.0)
    below = np.concatenate([[0.0], np.cumsum(ys)])
    at = np.searchsorted(ratio, ratio, side="left")
    only_a, only_b = x.sum() - xs.sum(), y.sum() - ys.sum()
    return float((1 / ((above[at] + only_a) / xs + (below[at] + only_b) / ys)).sum())


_SKETCH = "id long, digest long, n_shingles int, bands array<long>, registers binary"


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """id (of the row), a digest of its words (null without a word), bands and registers."""

    def sketch(batches):
        for b in blocks(batches, text):
            keys, counts, per, digest = shingle_counts(b.column(1))
            sig = signatures(keys, counts, per)
            h = np.zeros((len(per), BANDS), U64)
            for r in range(ROWS):
                h = mix(h + sig[:, r::ROWS].astype(U64) + U64(r + 1))
            h = mix(h ^ (np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15))[None, :]).view(np.int64)
            none = per == 0
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(per) + 1, dtype=np.int32) * BANDS), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digest.view(np.int64), mask=none), pa.array(per.astype(np.int32)), bands, pa.array([s.tobytes() for s in sig.astype(np.uint16)], pa.binary())],
                ["id", "digest", "n_shingles", "bands", "registers"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias(text)).mapInArrow(sketch, _SKETCH)


def _agree(pairs: DataFrame, least: float) -> DataFrame:
    """Of rows with registers ra and rb, those whose share of equal registers reaches ``least``; ``share`` is added."""
    names = [c for c in pairs.columns if c not in ("ra", "rb")]
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            a, c = (np.frombuffer(_bytes(b.column(b.schema.get_field_index(k))), np.uint16).reshape(b.num_rows, -1) for k in ("ra", "rb"))
            share = (a == c).mean(axis=1)
            keep = pa.array(share >= least)
            cols = [b.column(b.schema.get_field_index(k)) for k in names] + [pa.array(share)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "share"]).filter(keep)

    return pairs.mapInArrow(run, f"{kinds}, share double")


def _bytes(col: pa.Array) -> memoryview:
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return memoryview(col.buffers()[2])[off[0] : off[-1]]


def _verified(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose exact similarity reaches the threshold."""
    side = lambda n: shingles.select(F.col("id").alias(n), F.col("keys").alias(f"k{n}"), F.col("counts").alias(f"c{n}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "ca", "kb", "cb")

    def run(batches):
        for batch in batches:
            a, b, ok = batch.column(0), batch.column(1), []
            for ka, ca, kb, cb in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                k = [np.frombuffer(x.as_buffer(), U64) for x in (ka, kb)]
                c = [np.frombuffer(x.as_buffer(), np.uint32) if len(x.as_buffer()) else np.ones(len(y), np.uint32) for x, y in zip((ca, cb), k, strict=True)]
                ok.append(similarity(k[0], c[0], k[1], c[1]) >= threshold)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _shingles(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(id, digest, keys, counts) of the rows of wanted ids; counts are left empty where all are 1."""

    def run(batches):
        for b in blocks(batches, text):
            keys, counts, per, digest = shingle_counts(b.column(1))
            ends = np.cumsum(per)
            k, c = [], []
            for i, j in zip((ends - per).tolist(), ends.tolist(), strict=True):
                k.append(keys[i:j].tobytes())
                c.append(b"" if (counts[i:j] == 1).all() else counts[i:j].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest.view(np.int64)), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["id", "digest", "keys", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias(text))
    one = rows.join(wanted, "id", "left_semi")
    return one.mapInArrow(run, "id long, digest long, keys binary, counts binary")


def _compare(pairs: DataFrame, unique: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Edges among candidate pairs (a, b): the registers first (16 bits of each), then the exact similarity."""
    side = lambda n: unique.select(F.col("digest").alias(n), F.col("registers").alias(f"r{n}"))
    alike = _agree(pairs.join(side("a"), "a").join(side("b"), "b"), threshold - SLACK)
    return materialise(_verified(alike.select("a", "b"), shingles, threshold), "near-edges")


def _with_groups(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Entries (bucket, digest) with the group of each digest so far."""
    if roots is None:
        return entries.withColumn("group", F.col("digest"))
    return entries.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").select("bucket", "digest", F.coalesce("root", "digest").alias("group"))


def _unlinked(entries: DataFrame) -> DataFrame:
    """Entries of buckets that still hold two groups or more."""
    open_ = entries.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("bucket")
    return entries.join(open_, "bucket")


class _Links:
    """Edges found so far, and what they connect."""

    def __init__(self, unique: DataFrame, shingles: DataFrame, threshold: float):
        self.unique, self.shingles, self.threshold = unique, shingles, threshold
        self.edges: DataFrame | None = None
        self.roots: DataFrame | None = None

    def add(self, pairs: DataFrame) -> bool:
        """Compare candidate pairs; whether any is a link."""
        new = _compare(pairs, self.unique, self.shingles, self.threshold)
        found = bool(new.limit(1).count())
        self.edges = new if self.edges is None else self.edges.union(new)
        if found or self.roots is None:
            self.roots = components(self.edges)
        return found

    def open(self, entries: DataFrame) -> DataFrame:
        """Entries (bucket, digest) of buckets with texts that aren't all connected, with their groups."""
        return materialise(_unlinked(_with_groups(entries.select("bucket", "digest"), self.roots)).select("bucket", "digest", "group"), "near-live")


def _in_chunks(entries: DataFrame, links: _Links) -> DataFrame:
    """(a, b) edges between all texts of large open buckets, a spanning set of them: every two groups are compared in full.

    Texts that share such buckets, directly or through others, form a cluster. A cluster is dealt to chunks, large groups to
    chunks of their own, and each pair of chunks but those of one group is one task's work: registers first, then the exact
    similarity from the most alike pair down, leaving out what is connected by then. A task returns no more edges than texts.
    """
    star = entries.join(entries.groupBy("bucket").agg(F.min("digest").alias("low")), "bucket").select(F.col("digest").alias("a"), F.col("low").alias("b"))
    clusters = components(star).select(F.col("node").alias("digest"), F.col("root").alias("cluster"))
    texts = materialise(entries.select("digest", "group").distinct().join(clusters, "digest"), "near-cluster")
    sizes = texts.groupBy("cluster", "group").agg(F.count("*").alias("n")).withColumn("own", F.when(F.col("n") >= CHUNK // 2, F.col("group")))
    room = sizes.groupBy("cluster", "own").agg(F.sum("n").alias("m")).select(F.col("cluster").alias("rc"), F.col("own").alias("ro"), F.ceil(F.col("m") / CHUNK).alias("chunks"))
    dealt = texts.join(sizes.select("cluster", "group", "own"), ["cluster", "group"])
    dealt = dealt.join(room, (F.col("cluster") == F.col("rc")) & F.col("own").eqNullSafe(F.col("ro")))
    dealt = materialise(dealt.select("cluster", "digest", "group", "own", F.xxhash64("own", F.pmod(F.xxhash64(F.lit(3), "digest"), F.col("chunks"))).alias("chunk")), "near-chunks")
    chunk = dealt.select("cluster", "own", "chunk").distinct()
    left, right = (chunk.select("cluster", F.col("own").alias(f"o{i}"), F.col("chunk").alias(f"c{i}")) for i in (1, 2))
    work = materialise(left.join(right, "cluster").where("c1 <= c2 AND NOT coalesce(o1 = o2, false)").select("cluster", "c1", "c2"), "near-work")
    side = lambda c: work.select("cluster", F.col(c).alias("chunk"), "c1", "c2", F.lit(c == "c2").alias("second"))
    both = side("c1").where("c1 <> c2").union(side("c2"))
    rows = dealt.select("cluster", "chunk", "digest", "group").join(both, ["cluster", "chunk"])
    rows = rows.join(links.unique.select("digest", "registers"), "digest").join(links.shingles.select(F.col("id").alias("digest"), "keys", "counts"), "digest")
    threshold = links.threshold

    def compare(table: pa.Table) -> pa.Table:
        ids, group = table.column("digest").to_numpy(), table.column("group").to_pylist()
        reg = np.stack([np.frombuffer(x, np.uint16) for x in table.column("registers").to_pylist()])
        keys = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
        counts = [np.frombuffer(x, np.uint32) if x else np.ones(len(k), np.uint32) for x, k in zip(table.column("counts").to_pylist(), keys, strict=True)]
        second = table.column("second").to_numpy()
        one, two = (np.flatnonzero(~second), np.flatnonzero(second)) if not second.all() else (np.arange(len(ids)),) * 2
        found = []
        for i in one.tolist():
            share = (reg[two] == reg[i]).mean(axis=1)
            at = np.flatnonzero(share >= threshold - SLACK)
            found += [(-float(share[j]), i, int(two[j])) for j in at if group[i] != group[two[j]]]
        parent = {g: g for g in group}

        def find(g):
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        edges = []
        for _, i, j in sorted(found):
            x, y = find(group[i]), find(group[j])
            if x != y and similarity(keys[i], counts[i], keys[j], counts[j]) >= threshold:
                parent[x] = y
                edges.append((int(ids[i]), int(ids[j])))
        cols = list(zip(*edges, strict=True)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return materialise(rows.drop("chunk").groupBy("cluster", "c1", "c2").applyInArrow(compare, "a long, b long"), "near-edges")


def link(unique: DataFrame, shingles: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS, pivots: int = PIVOTS, small: int = SMALL_BUCKET) -> DataFrame:
    """(a, b) edges that connect all distinct texts that share a bucket and have a similarity of the threshold or more.

    A round draws a few pivots in each open bucket and compares every text with that pivot of another group with which it
    shares most bands, the likeliest link; buckets all of whose texts are connected then close. So most of a group of copies
    is connected at a cost that follows its size and not its square. In the buckets that stay open, mostly of texts that share
    a band by chance or through a common passage, every two texts of different groups are compared: as pairs in buckets of up
    to ``small`` texts, chunk by chunk in larger ones.
    """
    links = _Links(unique, shingles, threshold)
    live = links.open(unique.select(F.explode("bands").alias("bucket"), "digest"))
    for k in range(rounds):
        if not live.limit(1).count():
            break
        drawn = F.slice(F.array_sort(F.collect_list(F.struct(F.col("h").alias("h"), "digest", "group"))), 1, pivots)
        # a text can be drawn only where its hash is low enough to leave a few of the bucket, which bounds what is collected
        sized = live.join(live.groupBy("bucket").agg(F.count("*").alias("n")), "bucket").withColumn("h", F.xxhash64(F.lit(k), "bucket", "digest"))
        low = sized.where(F.pmod("h", F.lit(1 << 30)) * F.col("n") < F.lit((1 << 30) * 8 * pivots))
        drawn_ = low.groupBy("bucket").agg(drawn.alias("p")).select("bucket", F.explode("p").alias("p")).select("bucket", F.col("p.digest").alias("b"), F.col("p.group").alias("gb"))
        shared = live.join(drawn_, "bucket").where("group <> gb").groupBy(F.col("digest").alias("a"), "b").agg(F.count("*").alias("n"))
        found = links.add(shared.groupBy("a").agg(F.max_by("b", F.struct("n", F.xxhash64(F.lit(k), "b"), "b")).alias("b")))
        live = links.open(live)
        if not found:
            break
    sized = live.join(live.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    few = sized.where(F.col("n") <= small)
    left, right = (few.select("bucket", F.col("digest").alias(n), F.col("group").alias(f"g{n}")) for n in "ab")
    links.add(left.join(right, "bucket").where("a < b AND ga <> gb").select("a", "b").distinct())
    many = links.open(sized.where(F.col("n") > small))
    if not many.limit(1).count():
        return links.edges
    return links.edges.union(_in_chunks(many, links))


def classes(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, class_id) for every document: the least doc_id among those connected by a similarity of the threshold or more.

    Rows that repeat a doc_id are one document and all their texts belong to its class. Texts that fold to the same words are
    equal. A text of one to four words is near only to equal ones; a null text, or one without a word, is a class of its own.
    A null doc_id has a null class. Other columns are ignored; an empty table gives no rows.
    """
    rows = materialise(sketches(docs, text), "near-sketches")
    named = rows.where("id IS NOT NULL")
    known = named.where("digest IS NOT NULL")
    reps = known.groupBy("digest").agg(F.min("id").alias("id"))
    unique = materialise(known.join(reps, ["digest", "id"]).select("digest", "id", "bands", "registers").dropDuplicates(["digest"]), "near-unique")
    buckets = unique.select(F.explode("bands").alias("bucket"), "digest").groupBy("bucket").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("bucket")
    wanted = unique.select("digest", "id", F.explode("bands").alias("bucket")).join(buckets, "bucket").select("digest", "id").distinct()
    found = _shingles(docs.where("doc_id IS NOT NULL"), wanted.select("id").distinct(), text)
    shingles = materialise(found.select(F.col("digest").alias("id"), "keys", "counts").join(wanted.select(F.col("digest").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "near-shingles")
    edges = link(unique, shingles, threshold)
    ids = named.groupBy("id").agg(F.min("digest").alias("digest"), F.max("digest").alias("other"))
    both = ids.where("digest <> other").select(F.col("digest").alias("a"), F.col("other").alias("b"))
    roots = components(edges.union(both))
    rooted = ids.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").select("id", F.coalesce("root", "digest").alias("root"))
    rooted = materialise(rooted, "near-roots")
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("class_id"))
    out = rooted.join(least, "root", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))
    return out.union(rows.where("id IS NULL").select(F.col("id"), F.col("id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The row with the least doc_id of each class, with all columns of docs; rows without doc_id stay."""
    first = classes(docs, threshold, text).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id_"))
    kept = docs.join(first, F.col("doc_id") == F.col("kept_id_")).drop("kept_id_").dropDuplicates(["doc_id"])
    return kept.union(docs.where("doc_id IS NULL"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7_near_duplicates over all documents."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
