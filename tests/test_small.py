"""Small helpers, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.functions import arrays
from bandlake.operators import metrics, probes, ranking
from bandlake.sources import readers


def test_random_series_are_standard_normal_and_repeatable(spark):
    x = np.array([r["series"] for r in readers.random_series(spark, 400, 16).orderBy("sample_id").collect()])
    again = np.array([r["series"] for r in readers.random_series(spark, 400, 16).orderBy("sample_id").collect()])
    assert x.shape == (400, 16) and np.array_equal(x, again) and abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05
    assert abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) < 0.2
    assert not np.array_equal(x, np.array([r["series"] for r in readers.random_series(spark, 400, 16, seed=1).orderBy("sample_id").collect()]))


def test_clusters_of_separate_groups(spark):
    rnd = np.random.default_rng(1)
    centres = np.array([[0, 0, 9.0], [9, 0, 0], [0, 9, 0]])
    rows = [(i, (centres[i % 3] + rnd.normal(size=3) * 0.3).tolist()) for i in range(90)]
    found = probes.cluster_positions(spark.createDataFrame(rows, "id int, x array<double>"), "id", "x", k=3).collect()
    of = {r["id"]: r["cluster"] for r in found}
    assert len({of[0], of[1], of[2]}) == 3 and all(of[i] == of[i % 3] for i in range(90))
    assert all(np.allclose(r["features"], rows[r["id"]][1]) for r in found)


def test_weight_summary(spark):
    w = np.random.default_rng(2).normal(size=50)
    r = metrics.weight_summary(spark.createDataFrame([(float(v),) for v in w], "weight double")).first()
    assert [r["mean"], r["std"], r["max"], r["min"]] == pytest.approx([w.mean(), w.std(), w.max(), w.min()])


def test_cumulative_best(spark):
    values = [3.0, 4.0, 2.0, 2.0, 5.0, 1.0]
    rows = ranking.cumulative_best(spark.createDataFrame(list(enumerate(values)), "step int, loss double"), "step", "loss").orderBy("step").collect()
    assert [r["best"] for r in rows] == np.minimum.accumulate(values).tolist() and [r["is_best"] for r in rows] == [True, False, True, False, False, True]


def test_class_numbers(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("z",), ("c",)], "l string")
    assert [r[0] for r in df.select(arrays.class_number(F.col("l"), ["c", "a", "b", "a"])).collect()] == [1, 0, None, None, 2]


def test_segments_are_joined_in_time(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "a array<double>, b array<double>")
    assert df.select(F.concat("a", "b")).first()[0] == [1.0, 2.0, 3.0]
