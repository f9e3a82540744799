import gzip
import struct
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import names
from nearfield.operators import curves, datasets, grid, runs
from nearfield.operators.components import components, contractions
from nearfield.sources import files, tables
from nearfield.streaming import static_index


def test_pareto_equals_a_loop(spark):
    pts = [(("a", "b")[i % 2], ((i * 37) % 101) / 100, ((i * 53) % 97) / 10) for i in range(200)] + [("a", 0.0, 5.0), ("a", None, 1.0)]
    got = curves.pareto(spark.createDataFrame(pts, "alg string, x double, y double"), ["alg"], "x", "y").collect()
    want = set()
    for a in ("a", "b"):
        best = None
        for _, x, y in sorted([p for p in pts if p[0] == a and p[1] and p[2]], key=lambda p: (-p[2], -p[1])):
            if best is None or x > best:
                want.add((a, x, y))
                best = x
    assert {tuple(r)[:3] for r in got} == want


def test_levels(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.3)], "selectivity double")
    assert sorted(r[0] for r in curves.levels(df, [1, 2, 5, -1]).collect()) == [0.2, 0.3]
    assert curves.levels(df.limit(0), [0, -1]).count() == 0
    other = spark.createDataFrame([(0.9,)], "selectivity double")
    assert curves.shared_levels(df, other).count() == 4


def test_correlation_levels(spark):
    df = spark.createDataFrame([(0.4,), (-0.4,), (0.3,), (None,), (float("nan"),)], "c double")
    assert [r[0] for r in df.select(curves.level_of(F.col("c"))).collect()] == ["high", "low", "average", "average", "average"]


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(names.query_name(F.lit(7), F.lit(True))) == "qm0007" and one(names.query_name(F.lit(12345), F.lit(False))) == "qr12345"
    assert one(names.query_number(F.lit("qr0012"))) == 12
    assert one(names.segment_size(F.lit("x-seg16384"))) == 16384 and one(names.segment_size(F.lit(None).cast("string"))) == 1024
    assert one(names.sanitised(F.lit('[{"M": 5}, 100]'))) == "M_5_100"
    assert names.flag("Yes") and not names.flag("0") and names.flag(None, True)
    assert one(names.path_level(F.lit("a/b/c"), 2)) == "b"


def test_grids(spark):
    assert len(grid.expand([["a"], {"M": [1, 2]}])) == 2
    assert grid.expand({"M": [1, 2], "ef": 3}) == [{"M": 1, "ef": 3}, {"M": 2, "ef": 3}]
    assert grid.substitute(["@metric", {"d": "@dimension"}], {"metric": "angular", "dimension": 64}) == ["angular", {"d": 64}]
    assert grid.grid(spark, m=[1, 2], k=[3, 4, 5]).count() == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 300), (200, 300), (5, 5), (7, 8), (7, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in (100, 200, 300)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_components(spark):
    chain = spark.range(1000).selectExpr("id AS a", "id + 1 AS b")
    assert len(contractions(chain)) <= 12
    assert components(chain).agg(F.min("root"), F.max("root"), F.count("*")).first() == (0, 0, 1001)
    star = spark.range(1, 2000).selectExpr("id AS a", "0L AS b")
    assert len(contractions(star)) <= 2
    assert components(star, least=False).select("root").distinct().count() == 1


def test_runs_are_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("small", 0, 1, 10, "x", 0, 0.5), ("small", 1, 1, 10, "x", 0, 0.7)], "size string, att_idx int, filter_id int, k int, algorithm string, qid int, dist double")
    path = str(tmp_path / "runs")
    runs.store(df, path)
    runs.store(df.where("att_idx = 1").withColumn("dist", F.lit(0.9)), path)
    assert sorted(r.dist for r in runs.load(spark, path).collect()) == [0.5, 0.9]
    assert runs.load(spark, path, att_idx=0).first().dist == 0.5
    with pytest.raises(Exception, match="catalogue"):
        runs.attach_selectivity(df, spark.createDataFrame([(0, 0.5)], "filter_id int, selectivity double")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i2f", 2, x, x + 1) for x in (1.0, 3.0)))
    assert [r.embedding for r in files.fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("i").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "b.idx.gz").write_bytes(gzip.compress(bytes([0, 0, 8, 3]) + struct.pack(">iii", 2, 1, 2) + bytes([1, 2, 3, 4])))
    many = np.concatenate([np.full((50, 1), 3, "<i4").view("<f4"), np.arange(150, dtype="<f4").reshape(50, 3)], axis=1)
    many.tofile(str(tmp_path / "many.fvecs"))
    got = files.fvecs(spark, str(tmp_path / "many.fvecs"), range_bytes=100).orderBy("i").collect()
    assert [r.i for r in got] == list(range(50)) and got[49].embedding == [147.0, 148.0, 149.0]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.txt", "one\ntwo\r\n")
        z.writestr("b.bin", "x")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "z.zip", "skip.zip")
        (tmp_path / "c.txt").write_text("three")
        t.add(tmp_path / "c.txt", "c.txt")
    assert [(r.member, r.line, r.value) for r in files.archived_lines(spark, str(tmp_path / "z.zip"), ".txt").orderBy("line").collect()] == [("in/a.txt", 0, "one"), ("in/a.txt", 1, "two")]
    assert [r.value for r in files.archived_lines(spark, str(tmp_path / "t.tar.gz"), ".txt").collect()] == ["three"]
    assert [r.embedding for r in files.idx(spark, str(tmp_path / "b.idx.gz")).orderBy("i").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "w.txt").write_text("cat 1 2.5\ndog 3 4\n")
    assert files.word_vectors(spark, str(tmp_path / "w.txt")).where("word = 'cat'").first().embedding == [1.0, 2.5]
    (tmp_path / "r.txt").write_text("1::10::4\n2::10::2\n")
    assert files.ratings(spark, str(tmp_path / "r.txt"), "::").count() == 2
    (tmp_path / "bow.txt").write_text("3\n4\n2\n1 1 5\n2 3 1\n")
    assert files.bag_of_words(spark, str(tmp_path / "bow.txt")).count() == 2
    (tmp_path / "bits.txt").write_text("1 0 1\n")
    assert files.bit_lines(spark, str(tmp_path / "bits.txt")).first().embedding == [True, False, True]


def test_tables(spark, tmp_path):
    spark.createDataFrame([("t1", [0.5, 1.0], 7.5)], "title_id string, storyline_vec array<double>, avgRating double").write.parquet(str(tmp_path / "m"))
    row = tables.scan_train(spark, str(tmp_path / "m"), "movies")
    assert tables.dimension(row) == 2 and row.first().avgrating == 7.5 and row.first().genre is None
    with pytest.raises(ValueError):
        tables.scan_train(spark, str(tmp_path / "m"), "books")


def test_datasets(spark):
    a = datasets.gaussian_blobs(spark, 50, 4).orderBy("id").collect()
    assert a == datasets.gaussian_blobs(spark, 50, 4).repartition(7).orderBy("id").collect()
    s = datasets.random_sets(spark, 20, 30, 5)
    assert s.where(F.size(F.array_distinct("elements")) != 5).count() == 0
    r = spark.createDataFrame([(1, i, 4.0) for i in range(3)] + [(2, 1, 1.0)], "user int, item int, rating double")
    assert [x.user for x in datasets.item_sets(r, 3.0, 3).collect()] == [1]
    share = datasets.split(spark.range(5000), "id", 0.1).agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.07 < share < 0.13
    c = datasets.centred(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "id int, embedding array<double>")).orderBy("id").collect()
    assert c[0].embedding == [-1.0, -2.0]
    items, _ = datasets.factorised(spark.createDataFrame([(u, i, float((u * i) % 3 + 1)) for u in range(6) for i in range(5)], "user int, item int, rating double"), 2)
    assert items.count() == 5


def test_query_stream(spark, tmp_path):
    q = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "qid long, embedding array<double>")
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    run = static_index.search_stream(stream, lambda b: b.select("qid"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_all_metrics_of_small_distances(spark, tmp_path):
    """The SQL divides however small the true distances are, as in tables of many copies."""
    import duckdb

    from nearfield.plans import registry

    for i, values in enumerate(([0.01 * (j % 3 + 1) for j in range(600)], [0.0] * 599 + [1.0])):
        rows = [(j, ("a", "b")[j // 50 % 2], v) for j, v in enumerate(values)]
        spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(str(tmp_path / f"{i}/events.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/{i}/events.parquet/*.parquet')")
        want = sorted(con.execute(registry.ORACLES["all_metrics"]).fetchall())
        assert len(want) == 2 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in registry.QUERIES["all_metrics"](spark, str(tmp_path / str(i))).collect())
