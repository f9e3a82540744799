"""Queries on vectors and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions import distance as dist
from nearfield.functions import predicate as pred
from nearfield.operators import datasets, exact, families, graph, index, ivf, lsh
from nearfield.operators import metrics as met
from nearfield.storage import materialise
from nearfield.plans.registry import probes, query, rounded, table, train

_V = "CAST(embedding AS DOUBLE[])"
_PAIRS = f"""
t AS (SELECT vec_id AS id, {_V} AS v, label FROM embeddings), q AS (SELECT vec_id AS qid, {_V} AS v FROM embeddings WHERE vec_id % 100 = 0)
"""
_ANGULAR = "1 - list_dot_product(t.v, q.v) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(q.v, q.v)))"
_EUCLID = "list_distance(t.v, q.v)"


def _knn_sql(d: str, k: int, where: str = "true", pre: str = "") -> str:
    return f"""WITH {_PAIRS}{pre}, s AS (SELECT qid, id, {d} AS dist FROM t, q WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM s WHERE dist IS NOT NULL)
    SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) + 0.0 AS dist FROM r WHERE rank <= {k}"""


@query("knn_filtered_angular", _knn_sql(_ANGULAR, 10, "label >= 5"))
def knn_filtered_angular(spark, sf_dir):
    return rounded(exact.knn(probes(spark, sf_dir), train(spark, sf_dir), 10, "angular", pred.predicate("label >= 5")), "dist")


@query("knn_angular", _knn_sql(_ANGULAR, 10))
def knn_angular(spark, sf_dir):
    return rounded(exact.knn(probes(spark, sf_dir), train(spark, sf_dir), 10), "dist")


@query("knn_euclidean", _knn_sql(_EUCLID, 10))
def knn_euclidean(spark, sf_dir):
    return rounded(exact.knn(probes(spark, sf_dir), train(spark, sf_dir), 10, "euclidean"), "dist")


@query("knn_blocks_angular", _knn_sql(_ANGULAR, 40))
def knn_blocks_angular(spark, sf_dir):
    return rounded(exact.knn_blocks(probes(spark, sf_dir), train(spark, sf_dir), 40), "dist")


@query("knn_blocks_filtered", _knn_sql(_EUCLID, 10, "label < 3"))
def knn_blocks_filtered(spark, sf_dir):
    return rounded(exact.knn_blocks(probes(spark, sf_dir), train(spark, sf_dir), 10, "euclidean", pred.predicate("label < 3")), "dist")


_BITS = "list_transform(range(1, 65), lambda i: CASE WHEN (t.v[i] > 0) <> (q.v[i] > 0) THEN 1 ELSE 0 END)"


@query("knn_hamming_bits", _knn_sql(f"list_sum({_BITS}) / 64.0", 10))
def knn_hamming_bits(spark, sf_dir):
    bits = lambda d, *k: d.select(*k, dist.binarise(F.col("embedding")).alias("embedding"))
    return rounded(exact.knn(bits(probes(spark, sf_dir), "qid"), bits(train(spark, sf_dir), "id"), 10, "hamming"), "dist")


for _op, _name in (("<=", "le"), (">=", "ge"), ("!=", "ne"), ("=", "eq"), ("<", "lt"), (">", "gt")):

    @query(f"knn_filter_{_name}", _knn_sql(_ANGULAR, 10, f"label {_op} 4"))
    def _filtered(spark, sf_dir, op=_op):
        return rounded(exact.knn(probes(spark, sf_dir), train(spark, sf_dir), 10, "angular", pred.predicate(f"label {op} 4")), "dist")


@query("knn_filter_and", _knn_sql(_ANGULAR, 10, "label >= 2 AND label < 6"))
def knn_filter_and(spark, sf_dir):
    return rounded(exact.knn(probes(spark, sf_dir), train(spark, sf_dir), 10, "angular", pred.predicate("label >= 2 AND label < 6")), "dist")


@query("knn_post_filter", f"""WITH {_PAIRS}, s AS (SELECT qid, id, label, {_ANGULAR} AS dist FROM t, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM s)
    SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) + 0.0 AS dist FROM r WHERE rank <= 10 AND label >= 5""")
def knn_post_filter(spark, sf_dir):
    return rounded(exact.post_filter(probes(spark, sf_dir), train(spark, sf_dir), 10, "angular", pred.predicate("label >= 5"), ["label"]), "dist")


@query("knn_one_vector", f"""WITH {_PAIRS} SELECT id, round({_EUCLID}, 6) AS dist FROM t, q WHERE qid = 0 ORDER BY {_EUCLID}, id LIMIT 10""")
def knn_one_vector(spark, sf_dir):
    v = probes(spark, sf_dir).where("qid = 0").first()["embedding"]
    return rounded(exact.knn_one(train(spark, sf_dir), v, 10, "euclidean"), "dist")


#: Recall at ten that registered approximate searches reach on their own queries, by the least effort that does.
TARGET = 0.9


def _reaching(spark, sf_dir, family: str, efforts: list[int], name: str = "angular", where=None, **args):
    """The search of a family at the least effort that reaches the target; recall is a column of the result."""
    t, q = train(spark, sf_dir), probes(spark, sf_dir)
    built = families.build(family, t, name, **args)
    truth = materialise(exact.knn_blocks(q, t, 10, name), "truth")
    found, effort, share = index.reaching(built, q, truth, 10, TARGET, efforts)
    return rounded(found if where is None else built.search(q, 10, where, effort), "dist").withColumn("recall", F.lit(share))


@query("filter_selectivities", """SELECT * FROM (VALUES (0, 'label >= 5'), (1, 'label < 1'), (2, 'label != 3')) AS f(filter_id, filter),
    LATERAL (SELECT round(avg(CASE WHEN (filter_id = 0 AND label >= 5) OR (filter_id = 1 AND label < 1) OR (filter_id = 2 AND label <> 3) THEN 1.0 ELSE 0.0 END), 6) AS selectivity FROM embeddings)""")
def filter_selectivities(spark, sf_dir):
    return rounded(pred.catalogue(train(spark, sf_dir), ["label >= 5", "label < 1", "label != 3"]), "selectivity")


@query("nearest_filter", """WITH f AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS s FROM embeddings GROUP BY label)
    SELECT 'label = ' || label AS filter, round(s, 6) AS selectivity FROM f WHERE abs(s - 0.1) <= 0.05 ORDER BY abs(s - 0.1), 'label = ' || label LIMIT 1""")
def nearest_filter(spark, sf_dir):
    known = pred.catalogue(train(spark, sf_dir), [f"label = {i}" for i in range(10)])
    return rounded(pred.nearest_selectivity(known, 0.1, "label"), "selectivity")


_WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> ''))"


def _word_sets(spark, sf_dir):
    """Distinct words of the documents, as hashes: sets of longs are compared much faster than sets of strings."""
    words = F.array_distinct(F.array_remove(F.split(F.lower("text"), "[^a-z]+"), ""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("embedding"))


@query("knn_jaccard_documents", f"""WITH t AS (SELECT doc_id AS id, {_WORDS} AS v FROM documents), q AS (SELECT id AS qid, v FROM t WHERE id % 100 = 0),
    s AS (SELECT qid, id, len(list_intersect(t.v, q.v)) AS n, len(t.v) AS a, len(q.v) AS b FROM t, q),
    d AS (SELECT qid, id, CASE WHEN a = 0 OR b = 0 THEN 1.0 ELSE 1 - n / (a + b - n) END AS dist FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d WHERE dist < 1 - 1e-5)
    SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) + 0.0 AS dist FROM r WHERE rank <= 10""")
def knn_jaccard_documents(spark, sf_dir):
    sets = _word_sets(spark, sf_dir)
    return rounded(exact.knn_sets(sets.where("id % 100 = 0").withColumnRenamed("id", "qid"), sets, 10), "dist")


_MEANS = """, c AS (SELECT label AS list_id, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM t) GROUP BY label, i) GROUP BY label)"""
_COS = "1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def _ivf_sql(probes_: int, where: str = "true") -> str:
    d = lambda a, b: _COS.format(a=a, b=b)
    return f"""WITH {_PAIRS}{_MEANS},
    l AS (SELECT id, v, label, list_id FROM (SELECT t.id, t.v, t.label, c.list_id, row_number() OVER (PARTITION BY t.id ORDER BY {d('t.v', 'c.c')}, c.list_id) AS r FROM t, c) WHERE r = 1),
    p AS (SELECT qid, v, list_id FROM (SELECT q.qid, q.v, c.list_id, row_number() OVER (PARTITION BY q.qid ORDER BY {d('q.v', 'c.c')}, c.list_id) AS r FROM q, c) WHERE r <= {probes_}),
    s AS (SELECT qid, id, {d('l.v', 'p.v')} AS dist FROM l JOIN p USING (list_id) WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM s)
    SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(dist, 6) + 0.0 AS dist FROM r WHERE rank <= 10"""


def _label_ivf(spark, sf_dir):
    t = train(spark, sf_dir)
    return ivf.build_fixed(t, ivf.label_centroids(t))


for _p in (1, 3, 10):

    @query(f"ivf_label_centroids_{_p}", _ivf_sql(_p))
    def _ivf_query(spark, sf_dir, p=_p):
        return rounded(_label_ivf(spark, sf_dir).search(probes(spark, sf_dir), 10, p), "dist")


@query("ivf_filtered", _ivf_sql(3, "label >= 5"))
def ivf_filtered(spark, sf_dir):
    return rounded(_label_ivf(spark, sf_dir).search(probes(spark, sf_dir), 10, 3, pred.predicate("label >= 5")), "dist")


@query("ivf_kmeans")
def ivf_kmeans(spark, sf_dir):
    return _reaching(spark, sf_dir, "inverted file", [2, 4, 6, 7, 8], lists=8)


@query("ivf_access_path", _knn_sql(_ANGULAR, 10, "label = 7"))
def ivf_access_path(spark, sf_dir):
    index = _label_ivf(spark, sf_dir)
    return rounded(ivf.access_path(index, probes(spark, sf_dir), 10, 3, pred.predicate("label = 7"), 0.1, exact_below=0.2), "dist")


@query("sq8_rerank")
def sq8_rerank(spark, sf_dir):
    t = train(spark, sf_dir)
    bounds = ivf.sq8_bounds(t)
    return rounded(ivf.sq8_search(ivf.sq8_encode(t, bounds), bounds, probes(spark, sf_dir), 10), "dist")


@query("sq8_bounds", f"""WITH {_PAIRS}, f AS (SELECT unnest(range(0, 64)) AS i, unnest(v) AS x FROM t)
    SELECT CAST(i AS INTEGER) AS i, round(min(x), 6) AS lo, round(max(x) - min(x), 6) AS span FROM f GROUP BY i""")
def sq8_bounds(spark, sf_dir):
    b = ivf.sq8_bounds(train(spark, sf_dir))
    return rounded(b.select(F.posexplode(F.arrays_zip("lo", "span")).alias("i", "z")).select("i", "z.lo", "z.span"), "lo", "span")


@query("pq_rerank")
def pq_rerank(spark, sf_dir):
    t = train(spark, sf_dir)
    books = ivf.pq_train(t, 8)
    return rounded(ivf.pq_search(ivf.pq_encode(t, books), books, probes(spark, sf_dir), 10), "dist")


@query("lsh_sign_bits", """WITH t AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT id, """ + " + ".join(f"CASE WHEN list_dot_product(v, [{', '.join(map(str, p))}]::DOUBLE[]) > 0 THEN {1 << i} ELSE 0 END" for i, p in enumerate(lsh.hyperplanes(64, 12))) + " AS bits FROM t")
def lsh_sign_bits(spark, sf_dir):
    return train(spark, sf_dir).select("id", lsh.sign_bits(F.col("embedding"), lsh.hyperplanes(64, 12)).alias("bits"))


@query("lsh_sign_search")
def lsh_sign_search(spark, sf_dir):
    return _reaching(spark, sf_dir, "hashing", [8, 16, 32, 64], tables=64, bits=4)


@query("lsh_projected_search")
def lsh_projected_search(spark, sf_dir):
    return _reaching(spark, sf_dir, "projected hashing", [8, 16, 32, 64], "euclidean", tables=64, bits=9, width=1.0)


@query("lsh_minhash_search")
def lsh_minhash_search(spark, sf_dir):
    sets = _word_sets(spark, sf_dir).withColumnRenamed("embedding", "elements")
    return rounded(lsh.minhash_search(sets, sets.where("id % 100 = 0").withColumnRenamed("id", "qid"), 10, bands=64, rows=1), "dist")


@query("forest_search")
def forest_search(spark, sf_dir):
    return _reaching(spark, sf_dir, "forest", [2 << i for i in range(9)], trees=8, leaf=32)


@query("small_world_search")
def small_world_search(spark, sf_dir):
    return _reaching(spark, sf_dir, "small world", [32, 64, 128, 256], shard_rows=500)


@query("small_world_filtered")
def small_world_filtered(spark, sf_dir):
    t, q, where = train(spark, sf_dir), probes(spark, sf_dir), pred.predicate("label >= 5")
    found = families.build("small world", t, shard_rows=500).search(q, 10, where, 256)
    return rounded(found, "dist")


@query("graph_search")
def graph_search(spark, sf_dir):
    return _reaching(spark, sf_dir, "graph", [64, 128, 256], degree=16)


@query("ivf_quantised")
def ivf_quantised(spark, sf_dir):
    return _reaching(spark, sf_dir, "quantised", [2, 4, 6, 7, 8], "euclidean", lists=8)


@query("ivf_product_codes")
def ivf_product_codes(spark, sf_dir):
    return _reaching(spark, sf_dir, "product codes", [2, 4, 6, 7, 8], "euclidean", lists=8, subspaces=16)


@query("neighbour_descent")
def neighbour_descent(spark, sf_dir):
    return rounded(graph.neighbour_descent(train(spark, sf_dir), 16, iterations=5), "dist")


@query("graph_pruned")
def graph_pruned(spark, sf_dir):
    t = train(spark, sf_dir)
    return rounded(graph.pruned(graph.neighbour_descent(t, 8), t), "dist")


@query("random_baseline")
def random_baseline(spark, sf_dir):
    return families.search("random", train(spark, sf_dir), probes(spark, sf_dir), 10)


@query("knn_padded", f"""WITH {_PAIRS}, s AS (SELECT qid, id, {_EUCLID} AS dist FROM t, q WHERE label = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM s),
    w AS (SELECT qid, count(*) AS n, list(id ORDER BY rank) AS ids FROM r WHERE rank <= 100 GROUP BY qid)
    SELECT qid, CAST(100 - n AS INTEGER) AS n_padded, CAST(list_sum(ids) - (100 - n) AS BIGINT) AS id_sum FROM w""")
def knn_padded(spark, sf_dir):
    near = exact.knn(probes(spark, sf_dir), train(spark, sf_dir), 100, "euclidean", pred.predicate("label = 0"))
    w = exact.wide(near, 100)
    return w.select("qid", F.size(F.filter("distances", lambda d: d == float("inf"))).alias("n_padded"), F.aggregate("neighbors", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))


@query("norm_expansion_rank", _knn_sql(_EUCLID, 10).replace("round(dist, 6) + 0.0 AS dist", "id % 2 AS parity").replace("SELECT qid, CAST(rank", "SELECT qid, CAST(rank"))
def norm_expansion_rank(spark, sf_dir):
    pairs = train(spark, sf_dir).crossJoin(F.broadcast(probes(spark, sf_dir).select("qid", F.col("embedding").alias("q"))))
    key = dist.expansion_key(F.col("embedding"), F.col("q"))
    return exact.top_k(pairs.select("qid", "id", key.alias("dist")), 10).select("qid", "rank", "id", (F.col("id") % 2).alias("parity"))


@query("dot_to_cosine", f"""WITH {_PAIRS}, m AS (SELECT max(list_dot_product(v, v)) AS m FROM t)
    SELECT id, CAST(len(v) + 1 AS INTEGER) AS dim, round(sqrt(greatest(m - list_dot_product(v, v), 0)), 4) AS extra FROM t, m""")
def dot_to_cosine(spark, sf_dir):
    a = dist.augment_items(train(spark, sf_dir))
    return a.select("id", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", -1), 4).alias("extra"))


_RECALL = f"""WITH {_PAIRS}, s AS (SELECT qid, id, label, {_ANGULAR} AS dist FROM t, q),
    truth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM s) WHERE rank <= 10),
    run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM s WHERE label <> 2) WHERE rank <= 10)"""


def _truth_and_run(spark, sf_dir):
    t, q = train(spark, sf_dir), probes(spark, sf_dir)
    return exact.knn(q, t, 10), exact.knn(q, t, 10, "angular", pred.predicate("label != 2"))


@query("recall", _RECALL + """SELECT qid, round(sum(CASE WHEN run.dist <= b.bound + 1e-3 THEN 1 ELSE 0 END) / 10.0, 6) AS recall
    FROM (SELECT qid, dist AS bound FROM truth WHERE rank = 10) b JOIN run USING (qid) GROUP BY qid""")
def recall(spark, sf_dir):
    truth, run = _truth_and_run(spark, sf_dir)
    return rounded(met.recall(run, truth, 10), "recall")


@query("recall_summary", _RECALL + """SELECT round(avg(r), 6) AS mean_recall, round(stddev_pop(r), 6) AS std_recall FROM (
    SELECT qid, sum(CASE WHEN run.dist <= b.bound + 1e-3 THEN 1 ELSE 0 END) / 10.0 AS r FROM (SELECT qid, dist AS bound FROM truth WHERE rank = 10) b JOIN run USING (qid) GROUP BY qid)""")
def recall_summary(spark, sf_dir):
    truth, run = _truth_and_run(spark, sf_dir)
    return rounded(met.summary(met.recall(run, truth, 10)), "mean_recall", "std_recall")


@query("epsilon_recall", _RECALL + """SELECT qid, round(sum(CASE WHEN run.dist <= b.bound * 1.01 THEN 1 ELSE 0 END) / 10.0, 6) AS recall
    FROM (SELECT qid, dist AS bound FROM truth WHERE rank = 10) b JOIN run USING (qid) GROUP BY qid""")
def epsilon_recall(spark, sf_dir):
    truth, run = _truth_and_run(spark, sf_dir)
    return rounded(met.epsilon_recall(run, truth, 10, 0.01), "recall")


@query("relative_error", _RECALL + "SELECT round((SELECT sum(dist) FROM run) / (SELECT sum(dist) FROM truth), 6) AS relative_error")
def relative_error(spark, sf_dir):
    truth, run = _truth_and_run(spark, sf_dir)
    return rounded(met.relative_error(run, truth), "relative_error")


@query("id_recall", _RECALL + "SELECT truth.qid, round(count(run.id) / count(*), 6) AS recall FROM truth LEFT JOIN run ON truth.qid = run.qid AND truth.id = run.id GROUP BY truth.qid")
def id_recall(spark, sf_dir):
    truth, run = _truth_and_run(spark, sf_dir)
    return rounded(met.id_recall(run, truth), "recall")


@query("tfidf_terms", """WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT doc_id, term, round(tf * (ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1)) + 1), 6) AS tfidf FROM tf JOIN df USING (term)""")
def tfidf_terms(spark, sf_dir):
    return rounded(datasets.tfidf_terms(table(spark, sf_dir, "documents")), "tfidf")


@query("tfidf_projection")
def tfidf_projection(spark, sf_dir):
    return datasets.random_projection(datasets.tfidf_terms(table(spark, sf_dir, "documents")), 16)


@query("gaussian_blobs")
def gaussian_blobs(spark, sf_dir):
    return datasets.gaussian_blobs(spark, 1000, 8)


@query("random_sets")
def random_sets(spark, sf_dir):
    return datasets.random_sets(spark, 500, 100, 10)


@query("train_test_split")
def train_test_split(spark, sf_dir):
    return datasets.split(train(spark, sf_dir), "id", 0.1).select("id", "is_test")


_RATED = "SELECT user_id AS u, CAST(json_extract(props, '$.k') AS INTEGER) AS i, value AS r FROM events"


@query("item_sets", f"""WITH r AS ({_RATED}) SELECT u AS user, list_sort(list(i)) AS elements FROM r WHERE r >= 3 GROUP BY u HAVING count(*) >= 5""".replace("list_sort(list(i)) AS elements", "CAST(count(*) AS BIGINT) AS n, CAST(sum(i) AS BIGINT) AS total"))
def item_sets(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("int").alias("item"), F.col("value").alias("rating"))
    s = datasets.item_sets(r, 3.0, 5)
    return s.select("user", F.size("elements").cast("long").alias("n"), F.aggregate("elements", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("centred_vectors", f"""WITH {_PAIRS}, f AS (SELECT id, unnest(range(0, 64)) AS i, unnest(v) AS x FROM t), m AS (SELECT i, avg(x) AS m FROM f GROUP BY i)
    SELECT id, CAST(i AS INTEGER) AS i, round(x - m, 6) AS x FROM f JOIN m USING (i)""")
def centred_vectors(spark, sf_dir):
    c = datasets.centred(train(spark, sf_dir))
    return rounded(c.select("id", F.posexplode("embedding").alias("i", "x")), "x")
