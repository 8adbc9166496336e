from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import vectors as V


def one(spark, a, b, make):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    return df.select(make(F.col("a"), F.col("b"))).first()[0]


def test_cosine_matches_numpy(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        a, b = rng.normal(size=(2, 9))
        want = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        assert one(spark, a.tolist(), b.tolist(), V.cosine_similarity) == pytest.approx(want)
        assert one(spark, a.tolist(), b.tolist(), V.cosine_distance) == pytest.approx(1 - want)


def test_zero_vector_is_unlike_everything(spark):
    assert one(spark, [0.0, 0.0], [1.0, 0.0], V.cosine_similarity) == 0
    assert one(spark, [0.0, 0.0], [1.0, 0.0], V.cosine_distance) == 1


def test_length_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match="vectors differ in length: 1 and 2"):
        one(spark, [1.0], [1.0, 0.0], V.cosine_similarity)


def test_unit(spark):
    assert one(spark, [3.0, 4.0], [], lambda a, _: V.unit(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0, 0.0], [], lambda a, _: V.unit(a)) == [0.0, 0.0, 0.0]


def test_text_form(spark):
    assert one(spark, [0.5, -2.0], [], lambda a, _: V.format_vector(a)) == "[0.5,-2.0]"
    assert one(spark, [0.5, -2.0], [], lambda a, _: V.parse_vector(V.format_vector(a))) == [0.5, -2.0]


def test_dimension_check(spark):
    assert one(spark, [1.0, 2.0], [], lambda a, _: V.checked_dimension(a, 2)) == [1.0, 2.0]
    with pytest.raises(Exception, match="expected 3 dimensions, got 2"):
        one(spark, [1.0, 2.0], [], lambda a, _: V.checked_dimension(a, 3))


def test_means(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    got = {r.k: (r.centroid, r.member_count) for r in V.mean_by(df, ["k"], "v").collect()}
    assert got == {"a": ([2.0, 3.0], 2), "b": ([5.0, 6.0], 1)}
    assert V.mean_of_all(df, "v").first().centroid == [3.0, 4.0]
    with pytest.raises(Exception, match="Nothing has been added"):
        V.mean_of_all(df.filter("k = 'none'"), "v").collect()
