"""Confusions, band-mean probes and places, against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.operators import aggregates, metrics, probes
from tests.test_operators import newton


def samples(n=120, seed=3, steps=16):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = ["low", "mid", "none"][i % 3]
        t = np.arange(steps)
        x = rnd.normal(size=(2, steps)) * 0.4
        if label != "none":
            x += np.cos(2 * np.pi * (1 if label == "low" else 5) * t / steps + rnd.uniform(0, 6))
        rows += [(i, label, f, x[f].tolist()) for f in range(2)]
    return rows


SHAPE = "id int, label string, feature int, series array<double>"


def test_each_label_comes_first_once(spark):
    rows = [("a", t, p, (i * 7) % 5) for i, (t, p) in enumerate((t, p) for t in "xyz" for p in "xyz")] + [("b", "x", "x", 4)]
    got = metrics.targets_first(spark.createDataFrame(rows, "v string, y_true string, y_pred string, n int"), ["v"]).collect()
    assert len(got) == 27 + 1
    for target in "xyz":
        order = [target, *(k for k in "xyz" if k != target)]
        own = {(r.row, r.column): r.n for r in got if r.v == "a" and r.target == target}
        assert own == {(order.index(t), order.index(p)): n for v, t, p, n in rows if v == "a"}


def test_confusion_relations(spark):
    df = spark.createDataFrame([*samples(), (900, None, 0, [0.0] * 16)], SHAPE)
    got = probes.confusion_relations(df, "label", "id", n_bands=3, feature="feature").persist()
    tables = {}
    for r in got.where("target = 'low'").collect():
        tables.setdefault((r["variant"], r["band"]), {})[r["y_true"], r["y_pred"]] = r["n"]
    assert set(tables) == {("time", -1), ("spectrum", -1), ("band", 0), ("band", 1), ("band", 2)} and all(sum(t.values()) == 24 for t in tables.values())
    hits = {k: sum(n for (a, b), n in t.items() if a == b) / 24 for k, t in tables.items()}
    assert hits["spectrum", -1] > 0.8 and hits["band", 0] > 0.5 and hits["band", 0] > hits["band", 2] and hits["spectrum", -1] > hits["time", -1]
    # the bands' tables are those of the bands on their own
    flat = probes.flatten_samples(df.where("label is not null").select("id", "label", "feature", F.expr("series")).withColumn("series", probes.transforms.rfft_magnitude(F.col("series"))), "id", "label", ["feature"])
    data = probes.split_features(flat, "label", "id", "features")
    said = probes.predictions(data, probes.fit_probes(data, [probes.Probe("0", None, ((0, 3),), 9, 2)]))
    own = {(r.label, r.prediction): r.n for r in said.groupBy("label", "prediction").agg(F.count("*").alias("n")).collect()}
    assert {k: v for k, v in tables["band", 0].items() if v} == own
    got.unpersist()


def test_band_mean_probes(spark):
    rows = samples()
    df = spark.createDataFrame([*rows, *((900 + i, "rare", f, [1.0] * 16) for i in range(2) for f in range(2))], SHAPE)
    got = probes.band_mean_probes(df, "label", "id", band_width=3, feature="feature").collect()
    assert {r.label for r in got} == {"low", "mid", "none"} and {r.band for r in got} == {0, 1, 2} and {r.n for r in got} == {40}
    spectra = {(i, f): np.abs(np.fft.rfft(x)) / 4 for i, _, f, x in rows}
    means = {k: m.reshape(3, 3).mean(axis=1) for k, m in spectra.items()}
    label = {i: y for i, y, _, _ in rows}
    for r in got:
        assert r.magnitude == pytest.approx(np.mean([means[i, f][r.band] for (i, f) in means if label[i] == r.label]))
    acc = {r.label: r.accuracy for r in got}
    assert acc["low"] > 0.9 and acc["mid"] > 0.9
    by = {(r.label, r.band): r.weight for r in got}
    assert by["low", 0] == 1 and by["mid", 1] == 1 and all(min(by[k, b] for b in range(3)) == 0 for k in ("low", "mid"))
    with pytest.raises(ValueError, match="no whole band"):
        probes.band_mean_probes(df, "label", "id", band_width=30, feature="feature")


def test_sums_reach_the_driver_once(spark, monkeypatch):
    """More tasks than are added at a time: the same coefficients."""
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 3))
    y = (x[:, 0] + rnd.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(str(b), a.tolist(), False) for a, b in zip(x, y, strict=True)], "label string, features array<double>, is_test boolean").repartition(9)
    monkeypatch.setattr(probes, "TASKS", 2)
    found = probes.summed(df.select("label", "features"), lambda stream: {k: v for k, v in [(0, sum(np.array([b.num_rows, 1.0]) for b in stream))] if np.ndim(v)})
    assert found[0][0] == 200 and found[0][1] >= 8
    fitted = probes.fit_probes(df, [probes.Probe("a", "1", ((0, 3),))], scale=False)
    assert np.allclose(fitted.weights[0][0], newton(x, y), atol=1e-4)


def test_places_are_those_of_one_window(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 100).alias("v")).repartition(7)
    got = {r["id"]: r["at"] for r in aggregates.ordered_places(df, [F.col("v").desc(), F.col("id")], "at").collect()}
    want = {i: k for k, i in enumerate(sorted(range(500), key=lambda i: (-(i * 37 % 100), i)), 1)}
    assert got == want
