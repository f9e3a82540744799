import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distance as d


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs):
    return F.array(*[F.lit(x) for x in xs])


@pytest.mark.parametrize(
    "name, a, b, expected",
    [
        ("euclidean", [0, 1, 0], [2, 0, 0], math.sqrt(5)),
        ("hamming", [1, 1, 0, 0], [1, 0, 0, 1], 0.5),
        ("hamming", [True, True, False, False], [True, False, False, True], 0.5),
        ("angular", [5, 0], [0, 3], 1),
        ("angular", [5, 0], [1, 0], 0),
        ("angular", [7, 0], [-8, 0], 2),
    ],
)
def test_fixed_values(spark, name, a, b, expected):
    assert value(spark, d.metric(name)(vec(*a), vec(*b))) == pytest.approx(expected)


@pytest.mark.parametrize("a, b, expected", [([1, 2, 3, 4], [], 0), ([1, 2, 3, 4], [1, 2, 3, 4], 1), ([1, 2, 3, 4], [1, 2], 0.5), ([1, 2], [5, 6], 0)])
def test_jaccard_similarity(spark, a, b, expected):
    col = lambda x: vec(*x) if x else F.array().cast("array<int>")
    assert value(spark, d.jaccard_similarity(col(a), col(b))) == expected


def test_zero_vector_has_no_angle(spark):
    assert value(spark, d.angular(vec(0.0, 0.0), vec(1.0, 0.0))) is None
    assert value(spark, d.repair_zero(vec(0.0, 0.0, 0.0, 0.0))) == [0.5] * 4
    assert value(spark, d.normalise(vec(3.0, 4.0))) == [0.6, 0.8]


def test_unknown_metric():
    with pytest.raises(ValueError):
        d.metric("cosmic")


def test_points_as_text(spark):
    assert value(spark, d.parse_floats(F.lit(" 1 2.5 "))) == [1.0, 2.5]
    assert value(spark, d.parse_ints(F.lit("3 3 1"))) == [3, 1]
    assert value(spark, d.parse_bits(F.lit("1 0 1"))) == [True, False, True]
    assert value(spark, d.true_positions(vec(True, False, True))) == [0, 2]
    assert value(spark, d.decode_sparse(vec(1, 2, 3, 4, 5), F.lit(4), F.lit(2))) == [3, 4]
    assert value(spark, d.pad(vec(1.0), 3)) == [1.0, 0.0, 0.0]
    assert value(spark, d.packed_hamming(vec(5), vec(6), 4)) == 0.5


@pytest.mark.parametrize("name", ["angular", "euclidean", "hamming"])
def test_kernels_equal_expressions(spark, name):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-2, 3, (3, 6)).astype(float), rng.integers(-2, 3, (4, 6)).astype(float)
    a[:, 0], b[:, 0] = 1, 1
    got = d.distances(name, a, b)
    for i in range(3):
        for j in range(4):
            assert got[i, j] == pytest.approx(value(spark, d.metric(name)(vec(*a[i].tolist()), vec(*b[j].tolist()))))


def test_augmented_products_rank_like_cosine(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 4.0])], "id long, embedding array<double>")
    rows = [r["embedding"] for r in d.augment_items(df).orderBy("id").collect()]
    assert [round(sum(x * x for x in r), 9) for r in rows] == [25.0, 25.0]
