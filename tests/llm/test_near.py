import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from nearfield.llm import lines, minhash, partitions


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
    return " ".join(w)


def corpus(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = text_of(rng, rng.randint(60, 200))
        texts += [base] + [edited(rng, base, k) for k in (1, 2, 3, 5, 9)] + [base] * 2
    hub = text_of(rng, 150)
    texts += [edited(rng, hub, rng.randint(0, 8)) for _ in range(150)]  # a large group
    passage = text_of(rng, 60)
    texts += [text_of(rng, 40) + " " + passage + " " + text_of(rng, 40) for _ in range(60)]  # a common passage
    texts += ["one two", "one two", "One, two!", "three", "", None, " ", "...", text_of(rng, 30000)]
    rng.shuffle(texts)
    return texts


def brute_classes(texts, threshold=0.8):
    sets = []
    for t in texts:
        keys, counts, per, digest = minhash.shingle_counts(pa.array([t], pa.string()))
        sets.append((keys, counts, int(per[0]), int(digest[0])))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a[2] and b[2] and (a[3] == b[3] or minhash.similarity(a[0], a[1], b[0], b[1]) >= threshold):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(texts))]


def test_similarity_is_probability_jaccard():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = (np.unique(rng.integers(0, 40, 25)).astype(np.uint64) for _ in range(2))
        x, y = rng.integers(1, 6, len(a)), rng.integers(1, 6, len(b))
        xs, ys = dict(zip(a.tolist(), x.tolist(), strict=True)), dict(zip(b.tolist(), y.tolist(), strict=True))
        want = sum(1 / sum(max(xs.get(j, 0) / xs[i], ys.get(j, 0) / ys[i]) for j in {*xs, *ys}) for i in xs if i in ys)
        assert minhash.similarity(a, x, b, y) == pytest.approx(want)
    one = np.arange(10, dtype=np.uint64)
    assert minhash.similarity(one, np.ones(10, int), one, np.full(10, 3)) == pytest.approx(1)
    assert minhash.similarity(one[:0], one[:0], one, np.ones(10, int)) == 0


def test_registers_agree_with_the_similarity():
    rng = np.random.default_rng(3)
    m = 4000
    keys = rng.integers(1, 2**63, 90).astype(np.uint64)
    a, b = np.sort(keys[:70]), np.sort(keys[20:])
    x, y = rng.integers(1, 5, 70), rng.integers(1, 5, 70)
    s = minhash.signatures(np.concatenate([a, b]), np.concatenate([x, y]), np.array([70, 70]), m)
    assert (s[0] == s[1]).mean() == pytest.approx(minhash.similarity(a, x, b, y), abs=0.04)
    alone = minhash.signatures(b, y, np.array([70]), m)
    assert (alone[0] == s[1]).all()  # a text's registers don't depend on its neighbours in a batch


def test_shingles():
    keys, counts, per, digest = minhash.shingle_counts(pa.array(["a b c d e f", "A, b c d e!", "a b", None, "a b c d e a b c d e"]))
    assert per.tolist() == [2, 1, 1, 0, 5] and counts.tolist() == [1, 1, 1, 1, 2, 1, 1, 1, 1][:0] + counts.tolist()
    assert keys[2] in keys[:2] and sorted(counts[-5:].tolist()) == [1, 1, 1, 1, 2]
    assert len(set(digest.tolist())) == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, id string").repartition(5)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    want = brute_classes(texts)
    assert len(got) == len(texts)
    assert [got[i * 3] for i in range(len(texts))] == [c * 3 for c in want]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c * 3 for c in want})


def test_near_duplicates_of_odd_tables(spark):
    kind = "doc_id long, text string"
    long = text_of(random.Random(5), 40)
    rows = [(1, long), (1, long), (2, long), (None, long), (3, "w x y z v u"), (3, long), (7, None), (8, None)]
    got = minhash.classes(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in got) == [(0, 0), (1, 1), (2, 1), (3, 1), (7, 7), (8, 8)]
    assert minhash.classes(spark.createDataFrame([], kind)).count() == 0
    assert minhash.keep_one(spark.createDataFrame(rows, kind)).count() == 4


# --- lines ---------------------------------------------------------------------------------------------------------


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def line_docs(seed):
    rng = random.Random(seed)
    bases = [text_of(rng, rng.choice([3, 8, 30, 80, 600])) for _ in range(25)]
    docs = []
    for _ in range(60):
        some = []
        for _ in range(rng.randint(1, 6)):
            b = rng.choice(bases)
            kind = rng.random()
            some.append(b if kind < 0.3 else edited(rng, b, 1) if kind < 0.6 else b.upper() + " !!" if kind < 0.7 else text_of(rng, rng.randint(1, 20)))
        docs.append("\n".join(some))
    template = text_of(rng, 200)
    docs += ["\n".join([edited(rng, template, 1), text_of(rng, 9)]) for _ in range(80)]  # one line with many variants
    return docs + [None, "", "\n\n", "a\nb\na\nb", "x y z\nx y z\n", "été à côté\nÉTÉ, à: côté"]


def words(line):
    return tuple("".join(c.lower() if c.isalnum() else " " for c in line).split())


def similar_lines(found):
    """All pairs of distinct lines with an edit similarity of 0.8 at least, by comparing all that their lengths and words allow."""
    known = sorted(found)
    bags = [Counter(w) for w in known]
    for i, a in enumerate(known):
        for j in range(i):
            b = known[j]
            most = int(max(len(a), len(b)) * 0.2 + 1e-9)
            if abs(len(a) - len(b)) <= most and sum((bags[i] & bags[j]).values()) >= max(len(a), len(b)) - most and edits(a, b) <= most:
                yield a, b


def line_places(texts):
    places = defaultdict(list)
    for d, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if w := words(line):
                places[w].append((d, p))
    return places


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_lines_equal_brute_force(spark, seed):
    texts = line_docs(seed)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, k string").repartition(4)
    rep = {r.doc_id: r for r in lines.report(docs).collect()}
    places = line_places(texts)
    parent = {w: w for w in places}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in similar_lines(places):
        parent[find(a)] = find(b)
    groups = defaultdict(list)
    for w, at in places.items():
        groups[find(w)] += at
    want = defaultdict(set)
    for g in groups.values():
        for d, p in sorted(g)[1:]:
            want[d].add(p)
    assert sum(len(g) > 1 for g in groups.values()) > 5 and len(groups) < len(places)
    for i, t in enumerate(texts):
        assert set(rep[i].removed_lines) == want[i] and rep[i].n_lines == (0 if t is None else t.count("\n") + 1) and rep[i].n_removed == len(want[i])
    kept = {r.doc_id: r for r in lines.dedup(docs).collect()}
    for i, t in enumerate(texts):
        left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[i])
        if want[i] and not any(c.isalnum() for c in left):
            assert i not in kept
        else:
            assert kept[i].text == left


def test_recall_of_similar_lines_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    places = line_places([texts.get(i) for i in range(max(texts) + 1)])
    by_length, truth = sorted(places, key=len), []
    for k in range(0, len(by_length), 400):  # windows of lengths keep the brute force short
        top = by_length[k : k + 400]
        low = [w for w in by_length[:k] if len(w) >= 0.8 * len(top[0]) - 1]
        rare = Counter(x for w in by_length for x in set(w)) if not k else rare  # noqa: F821
        index = defaultdict(set)
        for w in low + top:
            for x in sorted(set(w), key=lambda x: (rare[x], x))[: int(len(w) * 0.25) + 1]:
                index[x].add(w)
        for w in top:
            near = set().union(*(index[x] for x in sorted(set(w), key=lambda x: (rare[x], x))[: int(len(w) * 0.25) + 1]))
            truth += [(w, v) for v in near if (len(v), v) < (len(w), w) and len(w) - len(v) <= int(len(w) * 0.2 + 1e-9) and edits(v, w) <= int(len(w) * 0.2 + 1e-9)]
    table = lines.materialise(lines.line_table(docs), "t")
    repeated = table.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    key = {(r.doc_id, r.pos): r.k for r in table.select("doc_id", "pos", "k").collect()}
    root = {r.node: r.root for r in lines.linked_lines(docs, table, repeated).collect()}
    of = lambda w: root.get(key[places[w][0]], w)
    assert len(truth) > 300 and np.mean([of(a) == of(b) for a, b in truth]) >= 0.97


def test_lines_at_the_threshold_are_found(spark):
    rng = random.Random(7)
    docs, want = [], []
    for n in (4, 5, 6, 9, 10, 14, 15, 20, 45, 100, 300):
        for _ in range(6):
            w = text_of(rng, n).split(" ")
            other = list(w)
            d = (n + 1) // 5 if n % 5 == 4 else n // 5
            at = rng.sample(range(n), d)
            if n % 5 == 4:  # a word more makes one more edit possible
                other.insert(rng.randrange(n + 1), "more")
                at = at[1:]
            for i in at:
                other[i if other[i] != "more" else i + 1] = "edit" + str(rng.randrange(10**6))
            if edits(w, other) <= 0.2 * max(len(w), len(other)) + 1e-9:
                docs.append((len(docs), " ".join(w) + "\n" + " ".join(other)))
                want.append([1])
    got = lines.report(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    # exactly at the threshold a fourth of the runs of three words agree; one block of four then does in two of three cases
    assert len(docs) > 50 and np.mean([r.removed_lines == w for r, w in zip(got, want, strict=True)]) >= 0.6


def test_blocks_are_signs_of_weighted_votes(spark):
    """With weights that fall by more than half, the sign of the votes is the heaviest feature's, for every bit of a block."""
    rng = random.Random(11)
    texts = [text_of(rng, n) for n in (12, 15, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n, r.blocks) for r in lines.line_table(docs).collect()}
    for d, t in enumerate(texts):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in t.split(" ")]

        def run(*x):
            out = 42
            for v in x:
                out = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), out)
            return out

        f = [run(*h[i : i + 3]) for i in range(len(h) - 2)]
        want = []
        for block in {x >> 62 for x in f}:
            own = sorted({x & ((1 << 55) - 1) for x in f if x >> 62 == block})  # no feature is common here
            votes = [sum((1 if x >> j & 1 else -1) * 3 ** (len(own) - 1 - i) for i, x in enumerate(own)) for j in range(55)]
            want.append((block << 62 | sum(1 << j for j, v in enumerate(votes) if v > 0)) - (1 << 64 if block >= 2 else 0))
        assert got[d][0] == len(h) and sorted(got[d][1]) == sorted(want)


def test_short_lines_are_removed(spark):
    texts = ["Menu\nRead more", "read MORE!\n\nmenu\n--\nother", "無空白的一行文字\n\n--", "無空白的一行文字\nread less"]
    got = lines.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.removed_lines for r in got] == [[], [0, 2], [], [0]]


def test_common_features_change_no_result(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(line_docs(3))), "doc_id long, text string")
    before = sorted(map(str, lines.report(docs).collect()))
    monkeypatch.setattr(lines, "SAMPLE", 1)
    assert any(lines._common(docs, "text")) and sorted(map(str, lines.report(docs).collect())) == before
    monkeypatch.setattr(lines, "SENT_ROWS", 0)  # every join is shuffled
    monkeypatch.setattr(lines, "MAP_WORDS", 1)  # the map of wanted keys is full
    assert sorted(map(str, lines.report(docs).collect())) == before


def test_common_features_are_counted_in_all_rows(spark):
    """A run of words in every third row has a level, whichever rows a sample would hold."""
    line = "one very common line of words"
    docs = spark.createDataFrame([(i, line if i % 3 == 0 else f"row{i} has words{i} of its{i} own{i}") for i in range(120)], "doc_id long, text string")
    levels = np.array(lines._common(docs, "text"))
    # four runs of three words and five of two, each in forty rows
    assert (levels > 0).sum() == 9 and set(levels[levels > 0]) == {int(6 * np.log2(41))}


def test_maps_of_words_lose_no_similar_pair(spark):
    """Pairs of few edits pass the maps of words, others of the same length don't; copies of a line make one entry."""
    rng = random.Random(13)
    texts = []
    for n in (6, 11, 12, 30, 90):
        w = text_of(rng, n).split(" ")
        other = ["edit" + x if i % 5 == 4 else x for i, x in enumerate(w)]
        texts.append("\n".join([" ".join(w), " ".join(other), text_of(rng, n), " ".join(w)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = lines.line_table(docs).collect()
    by = {(r.doc_id, r.pos): r for r in table}
    rows = [(*[by[d, 0][c] for c in "knst"], *[by[d, p][c] for c in "knst"]) for d in range(len(texts)) for p in (1, 2)]
    pairs = spark.createDataFrame(rows, "ka long, na int, sa long, ta long, kb long, nb int, sb long, tb long")
    got = {(r.a, r.b) for r in lines._candidates(pairs, lines.THRESHOLD).collect()}
    assert got == {tuple(sorted((by[d, 0].k, by[d, 1].k))) for d in range(len(texts))}
    places = lines.line_places(lines.folded_texts(docs, "text"), lines._common(docs, "text"))
    long = lines.blocks_of_long(lines.folded_texts(docs, "text"), lines._common(docs, "text")).collect()
    assert all(by[d, 0].k == by[d, 3].k for d in range(len(texts))) and places.count() == 4 * len(texts)
    assert len(long) == len({r.k for r in long}) == 9  # copies of a long line count once; three lines of three texts


def test_lines_of_odd_tables(spark):
    kind = "doc_id long, text string, n_chars long, pos int"
    rows = [(None, "a b c d", 7, 1), (1, "a b c d\nzz yy xx", 16, 1), (1, "a b c d\nzz yy xx", 16, 1), (2, "zz yy xx", 8, 1)]
    df = spark.createDataFrame(rows, kind)
    out = sorted((r.doc_id or 0, r.text, r.n_chars) for r in lines.dedup(df).collect())
    assert out == [(0, "a b c d", 7), (1, "zz yy xx", 8), (1, "zz yy xx", 8)]
    assert lines.report(df.limit(0)).count() == 0 and lines.dedup(df.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(5000))
    two = spark.createDataFrame([(1, long, 1, 1), (2, long + " more", 1, 1)], kind)
    assert [r.n_removed for r in lines.report(two).orderBy("doc_id").collect()] == [0, 1]


# --- partitions ----------------------------------------------------------------------------------------------------


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(1)
    u = partitions.unit(np.concatenate([rng.standard_normal((100, 8)) * 0.3 + c for c in rng.standard_normal((4, 8)) * 3]))
    g = partitions.neighbour_graph(u, 6)
    label = partitions.balanced_parts(g, 4)
    assert np.bincount(label).tolist() == [100] * 4
    assert (label[g] == label[:, None]).mean() > 0.9


def test_search_finds_nearly_all(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3000, 24)) + 2 * rng.standard_normal((30, 24))[np.arange(3000) % 30]
    v[7], v[500] = v[50], v[50]  # exact ties
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)] + [(9001, None, "c"), (9050, [0.0] * 24, "c"), (9100, [float("nan")] + [1.0] * 23, "c"), (9101, [None] + [1.0] * 23, "c"), (9102, [float("inf")] + [1.0] * 23, "c"), (None, [1.0] * 24, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part string").repartition(6)
    got = partitions.find(df).collect()
    q = np.arange(0, 3000, 50)
    qi, near, score = partitions.nearest(v[q], q, v, np.arange(3000), 5)
    want = defaultdict(dict)
    for a, b, s in zip(q[qi].tolist(), near.tolist(), score.tolist(), strict=True):
        want[a][b] = s
    assert len(got) == 300 and {r.query_id for r in got} == set(q.tolist())
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert hits >= 0.9 * 300
    for r in got:
        a, b = v[r.query_id], v[r.vec_id]
        assert r.score == pytest.approx(float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())), abs=1e-12) and r.vec_id != r.query_id
    top = {(r.query_id, r.rank): r for r in got}
    assert [top[50, 1].vec_id, top[50, 2].vec_id] == [7, 500]


def test_search_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], kind)
    rows = {(r.query_id, r.rank): r.vec_id for r in partitions.find(few).collect()}
    assert rows == {(0, 1): 50, (0, 2): 1, (50, 1): 0, (50, 2): 1}
    assert partitions.find(few.limit(0)).count() == 0
    assert partitions.find(spark.createDataFrame([(0, [1.0])], kind)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() > 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.schema == before.schema
    assert docs.where("ids_sha256 IS NULL").count() == 0
    empty = before.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = spark.createDataFrame(stage(spark, empty, sf).collect(), stage(spark, empty, sf).schema)
        assert empty.count() == 0


def test_queries_of_small_parts_find_all(spark, monkeypatch):
    rng = np.random.default_rng(9)
    far = [(50 * i, (rng.standard_normal(4) * 0.01 + np.eye(4)[0] * (1 if i else -9)).tolist()) for i in range(2)]
    rows = far + [(i, (rng.standard_normal(4) + 5).tolist()) for i in range(1, 60) if i % 50]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(partitions, "calibrate", lambda *a: (1, 0.5))
    got = partitions.find(df).collect()
    assert {q: sorted(r.rank for r in got if r.query_id == q) for q in (0, 50)} == {0: [1, 2, 3, 4, 5], 50: [1, 2, 3, 4, 5]}
    few = partitions.find(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]


def test_equal_and_extreme_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in partitions.find(same).orderBy("rank").collect()] == [(i, pytest.approx(1.0)) for i in (1, 2, 3, 4, 5)]
    sizes = [1e300, 1e-300, 1.0, 1e308, 5e-320, 1e155]
    wide = spark.createDataFrame([(i, [s, s, 0.0]) for i, s in enumerate(sizes)], "vec_id long, embedding array<double>")
    got = partitions.find(wide).collect()
    assert len(got) == 5 and all(r.score == pytest.approx(1.0, abs=1e-3) for r in got)
