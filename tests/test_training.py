import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.functions import transforms
from bandlake.operators import training

SHAPE = "id int, features array<array<double>>, labels array<string>"


def rows(n, seed, dims=3, lengths=(1, 2, 5, 9)):
    """Labels follow the slow part of the first series; a fast part hides it."""
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(n):
        size = int(rnd.choice(lengths))
        slow = np.repeat(rnd.normal(size=(dims, 1)), size, axis=1)
        fast = rnd.normal(size=(dims, size)) * 0.3
        labels = ["up" if v > 0 else "down" for v in slow[0]]
        if i % 7 == 0:
            labels[0] = None
        out.append((i, (slow + fast).tolist(), labels))
    return out


def numeric(f, w, at, h=1e-6):
    e = np.zeros_like(w)
    e[at] = h
    return (f(w + e) - f(w - e)) / (2 * h)


@pytest.mark.parametrize(("n", "size"), [(1, 4), (5, 3), (6, 8), (7, 0)])
def test_gradient_equals_finite_differences(n, size):
    rnd = np.random.default_rng(n)
    m, dims, classes = 4, 3, 3
    x, y = rnd.normal(size=(m, dims, n)), rnd.integers(-1, classes, (m, n))
    w = rnd.normal(size=size + classes * (dims + 1))
    f = lambda v: training.loss_and_gradient(y, x, v[:size], v[size:].reshape(classes, dims + 1))
    got = f(w)
    assert got[2] == (y >= 0).sum()
    for at in range(len(w)):
        assert got[3 + at] == pytest.approx(numeric(lambda v: f(v)[0], w, at), abs=1e-5)


def test_learnt_filters_act_as_the_operator_does(spark):
    """Pooled, then the sigmoid: for logits -4, 8, -4, 8 pooled to two that is 0.88."""
    logits = np.array([-4.0, 8.0, -4.0, 8.0])
    assert transforms.openness(logits, 2, True) == pytest.approx([0.8808, 0.8808], abs=1e-4)
    x = np.random.default_rng(1).normal(size=(2, 5))
    df = spark.createDataFrame([(x.tolist(),), (None,), ([],)], "x array<array<double>>")
    got = [r[0] for r in df.select(transforms.filter_lanes(F.col("x"), logits, True)).collect()]
    basis = transforms.dct_basis(5)
    assert np.allclose(got[0], (x @ basis.T * transforms.openness(logits, 5, True)) @ basis) and got[1] is None and got[2] == []


def reference_run(learn, check, dealt, size, epochs, batches, seed, rate=0.05, decay=0.5, early_stop=1):
    """The loop by dense matrices, text by text."""
    classes = ["down", "up"]
    dims = 3
    bound = 1 / np.sqrt(dims)
    w = np.concatenate([np.ones(size), np.random.default_rng(seed).uniform(-bound, bound, len(classes) * (dims + 1))])
    m, v, t, plateau, history = np.zeros_like(w), np.zeros_like(w), 0, np.inf, []

    def text(x, labels, w):
        x, n = np.array(x), len(labels)
        c = w[size:].reshape(2, dims + 1)
        pool = np.zeros((n, size))
        for i in range(n if size else 0):
            lo, hi = i * size // n, -(-(i + 1) * size // n)
            pool[i, lo:hi] = 1 / (hi - lo)
        basis = transforms.dct_basis(n)
        gate = 1 / (1 + np.exp(-pool @ w[:size])) if size else np.ones(n)
        move = basis.T @ np.diag(gate) @ basis
        seen = x @ move.T
        z = c[:, :-1] @ seen + c[:, -1:]
        p = np.exp(z) / np.exp(z).sum(axis=0)
        loss, hits, known, g = 0.0, 0, 0, np.zeros_like(w)
        for i, label in enumerate(labels):
            if label is None:
                continue
            k = classes.index(label)
            loss -= np.log(p[k, i])
            hits += p[:, i].argmax() == k
            known += 1
            dz = p[:, i].copy()
            dz[k] -= 1
            gc = np.concatenate([np.outer(dz, seen[:, i]), dz[:, None]], axis=1)
            g[size:] += gc.reshape(-1)
            if size:
                back = c[:, :-1].T @ dz
                by_gate = np.array([(back[:, None] * (x @ np.outer(basis[f], basis[f])[:, i : i + 1])).sum() for f in range(n)])
                g[:size] += pool.T @ (by_gate * gate * (1 - gate))
        return loss, hits, known, g

    for epoch in range(1, epochs + 1):
        sums = np.zeros(3)
        for b in np.random.default_rng([seed, epoch]).permutation(batches):
            each = [text(x, y, w) for i, x, y in learn if dealt[i] == b]
            known = sum(e[2] for e in each)
            if not known:
                continue
            sums += [sum(e[0] for e in each), sum(e[1] for e in each), known]
            g = sum(e[3] for e in each) / known
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        each = [text(x, y, w) for _, x, y in check]
        known = sum(e[2] for e in each)
        loss = sum(e[0] for e in each) / known
        history.append((epoch, sums[0] / sums[2], sums[1] / sums[2], loss, sum(e[1] for e in each) / known, rate))
        if loss < plateau * (1 - 1e-4):
            plateau = loss
        else:
            rate *= decay
        losses = [h[3] for h in history]
        if len(losses) - 1 - losses.index(min(losses)) > early_stop:
            break
    return w, history


@pytest.mark.parametrize("size", [0, 4])
def test_history_equals_a_plain_loop_and_runs_go_on(spark, tmp_path, size):
    learn, check = rows(40, 1), rows(15, 2)
    a, b = (spark.createDataFrame(x, SHAPE) for x in (learn, check))
    y = F.transform("labels", lambda v: F.coalesce(F.array_position(F.array(F.lit("down"), F.lit("up")), v), F.lit(0)).cast("int") - 1)
    dealt = {r["id"]: r["b"] for r in a.select("id", F.pmod(F.xxhash64(y, F.col("features"), F.lit(5)), F.lit(3)).alias("b")).collect()}
    options = {"filter_size": size, "batches": 3, "rate": 0.05, "seed": 5}
    state, best = training.train(a, b, epochs=6, path=str(tmp_path / "run"), **options)
    w, history = reference_run(learn, check, dealt, size, 6, 3, 5)
    got = [tuple(h[k] for k in ("epoch", "train_loss", "train_accuracy", "valid_loss", "valid_accuracy", "rate")) for h in state.history]
    assert len(got) == len(history) and np.allclose(got, history, atol=1e-9, rtol=1e-9) and np.allclose(state.weights, w, atol=1e-9)
    # interrupted after two epochs, then resumed
    part = str(tmp_path / "part")
    training.train(a, b, epochs=2, path=part, **options)
    again, best_again = training.train(a, b, epochs=6, path=part, resume=True, **options)
    assert np.array_equal(again.weights, state.weights) and again.history == state.history and np.array_equal(best_again.weights, best.weights)
    stored = training.load_state(spark, part, "best")
    assert np.array_equal(stored.weights, best.weights) and np.array_equal(training.load_state(spark, part).weights, state.weights)
    assert len(training._epochs(spark, part)) <= 2
    with pytest.raises(ValueError, match="stored state"):
        training.train(a, b, path=part, resume=True, **(options | {"seed": 6}))
    lines = [r["line"] for r in training.log_lines(training.history_table(spark, state)).orderBy("epoch", "order").collect()]
    assert lines[0].startswith("epoch 1: train loss") and sum("best so far" in x for x in lines) == 1


def test_plateaus_and_early_stop(spark):
    """Labels that nothing foretells: the rate falls and training ends."""
    rnd = np.random.default_rng(4)
    noise = lambda n: spark.createDataFrame([(i, rnd.normal(size=(2, 3)).tolist(), rnd.choice(["a", "b"], 3).tolist()) for i in range(n)], SHAPE)
    state, best = training.train(noise(12), noise(12), epochs=25, batches=2, rate=0.5, early_stop=2, seed=1)
    losses = [h["valid_loss"] for h in state.history]
    assert len(losses) < 25 and len(losses) - 1 - losses.index(min(losses)) == 3 and best.history[-1]["epoch"] == state.best_epoch
    assert state.history[-1]["rate"] < 0.5


def test_predictions_and_mismatches(spark):
    data = spark.createDataFrame([*rows(60, 3), (900, None, None), (901, [], []), (902, [[], [], []], [])], SHAPE)
    state, best = training.train(data, data, epochs=12, batches=2, rate=0.2)
    said = training.predict(data, best).collect()
    assert {r["id"] for r in said if not r["predicted"]} == {900, 901, 902}
    hits = [p == t for r in said if r["predicted"] for p, t in zip(r["predicted"], r["labels"], strict=True) if t]
    assert np.mean(hits) > 0.8 and abs(np.mean(hits) - best.history[-1]["valid_accuracy"]) < 1e-9
    with pytest.raises(ValueError, match="1 texts"):
        training.train(spark.createDataFrame([(1, [[1.0, 2.0]], ["a"]), (2, [[1.0]], ["b"])], SHAPE), data)


def test_pieces_train_as_their_series(spark):
    """Rows of pieces, whose series the steps make, give the history and weights of stored series; no stored table holds hidden states."""
    from urllib.parse import urlparse

    from bandlake.functions.subwords import Vocabulary, byte_symbols
    from bandlake.operators import encoding, text_probe
    from bandlake.session import shared_folder

    names = [*byte_symbols(), *(s + "</w>" for s in byte_symbols()), "red</w>", "run</w>", "jump"]
    v = Vocabulary({p: k for k, p in enumerate(names)}, len(names), len(names) + 1)
    encoder = encoding.PieceEncoder(v, np.random.default_rng(3).normal(size=(len(v), 6)))
    rnd, words = np.random.default_rng(6), ["red", "blue", "run", "jumps"]
    line = lambda n: [words[k] for k in rnd.integers(0, 4, n)]
    data = [(i, [" ".join(w)], ["a" if x in ("red", "run") else None if i % 9 == 0 else "b" for x in w], "token") for i, w in ((i, line(1 + i % 7)) for i in range(40))]
    data += [(100 + i, [" ".join(line(3)), " ".join(line(i))], ["ab"[i % 2]], "sequence") for i in range(9)] + [(200, [""], ["a"], "sequence"), (201, [None], ["b"], "sequence"), (202, None, ["b"], "sequence")]
    df = spark.createDataFrame(data, "id int, texts array<string>, labels array<string>, level string").repartition(3)
    made, series = text_probe.token_rows(text_probe.piece_rows(df, encoder)), text_probe.token_rows(text_probe.encode(df, encoder))
    assert {f.name: f.dataType.simpleString() for f in made.schema}["pieces"] == "struct<ids:array<int>,special:array<boolean>>"
    again = encoder.with_features(made, specials=False)
    assert {r.id: (r.labels, r.features) for r in again.collect()} == {r.id: (r.labels, r.features) for r in series.collect()}
    for size in (0, 4):
        options = {"filter_size": size, "epochs": 3, "batches": 3, "rate": 0.05}
        plain, best = training.train(series.where("id % 3 > 0"), series.where("id % 3 = 0"), **options)
        folder = urlparse(shared_folder(spark)).path
        before = set(os.listdir(folder))
        state, best_state = training.train(made.where("id % 3 > 0"), made.where("id % 3 = 0"), encoder=encoder, **options)
        assert state.classes == plain.classes and np.allclose(state.weights, plain.weights, atol=1e-10) and np.allclose(best_state.weights, best.weights, atol=1e-10)
        assert [pytest.approx(h, abs=1e-10) for h in plain.history] == state.history
        shapes = [spark.read.parquet(f"{folder}/{d}").schema.simpleString() for d in set(os.listdir(folder)) - before]
        assert len(shapes) == 2 and not any("double" in s for s in shapes)


def test_pieces_are_spread_over_cores(spark, monkeypatch):
    """A batch has files for all cores, though its rows take few bytes; every row is in one of them."""
    rows = spark.range(0, 200, 1, 1).select(F.array(F.lit(0)).alias("y"), F.struct(F.array_repeat(F.col("id").cast("int"), 5).alias("ids"), F.array_repeat(F.lit(False), 5).alias("special")).alias("pieces"))
    assert training.parts_of(rows) == 1 and training.parts_of(rows.limit(0)) == 1
    monkeypatch.setattr(training, "LEAST_PIECES", 100)
    parts = training.parts_of(rows, 2)
    assert parts == spark.sparkContext.defaultParallelism == 4
    monkeypatch.setattr(training, "MOST_PIECES", 50)
    assert training.parts_of(rows, 2) == 10
    share = F.pmod(F.floor(F.col("pieces.ids")[0] / 4).cast("int"), F.lit(2))
    found = training.spread(rows, parts, share, 2).select(F.spark_partition_id().alias("p"), F.col("pieces.ids")[0].alias("id")).collect()
    sizes = {p: [r.id for r in found if r.p == p] for p in range(8)}
    assert sorted(r.id for r in found) == list(range(200)) and all(len({i // 4 % 2 for i in x}) == 1 and len(x) == 25 for x in sizes.values())


@pytest.mark.parametrize("n", [1, 3, 9])
def test_learnt_filters_come_before_pooling(n):
    """Loss and gradient of pooled series are those of series that are filtered at their own length, then pooled."""
    rnd = np.random.default_rng(n)
    m, dims, classes, size = 5, 3, 2, 4
    x, y = rnd.normal(size=(m, dims, n)), rnd.integers(0, classes, (m, 1))
    w = rnd.normal(size=size + classes * (dims + 1))

    def slow(v):
        basis, c = transforms.dct_basis(n), v[size:].reshape(classes, dims + 1)
        seen = ((x @ basis.T * transforms.openness(v[:size], n, True)) @ basis).mean(axis=2)
        z = seen @ c[:, :-1].T + c[:, -1]
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(m), y[:, 0]]).sum()

    got = training.loss_and_gradient(y, x.mean(axis=2, keepdims=True), w[:size], w[size:].reshape(classes, dims + 1), True, n)
    assert got[0] == pytest.approx(slow(w)) and got[2] == m
    for at in range(len(w)):
        assert got[3 + at] == pytest.approx(numeric(slow, w, at), abs=1e-5)


def test_tasks_pool_after_the_learnt_filter(spark):
    """Predictions and scores of a pooled task with a learnt filter are those of whole series, filtered by their lengths, then pooled."""
    from bandlake.operators import text_probe as tp

    rnd = np.random.default_rng(8)
    data = [(i, [" ".join(f"w{k}" for k in rnd.integers(0, 6, 1 + i % 9))], ["a" if i % 9 > 3 else "b"], "sequence") for i in range(60)] + [(99, [""], ["a"], "sequence")]
    df = spark.createDataFrame(data, "id int, texts array<string>, labels array<string>, level string")
    pooled, whole = tp.encode(df, "hashed", "auto(4)", "mean"), tp.encode(df, "hashed", "nofilter()")
    assert {r.id: r.pooled_from for r in pooled.collect()} == {r.id: len(r.features[0]) if r.features else 0 for r in whole.collect()}
    options = {"filter_size": 4, "epochs": 3, "batches": 2, "rate": 0.5}
    state, best = training.train(tp.token_rows(pooled), tp.token_rows(pooled), **options)
    c, said = best.classifier, {r.id: r.predicted for r in training.predict(tp.token_rows(pooled), best).collect()}
    assert len(said) == 60 and len({round(float(v), 6) for v in best.filter}) > 1
    for r in whole.where("id < 99").collect():
        x = np.array(r.features)
        basis = transforms.dct_basis(x.shape[1])
        seen = ((x @ basis.T * transforms.openness(best.filter, x.shape[1], True)) @ basis).mean(axis=1)
        assert said[r.id] == [best.classes[int((c[:, :-1] @ seen + c[:, -1]).argmax())]]
    found = tp.run_tasks({"t": (df, df)}, ["auto(4)"], (42,), pooling="mean", epochs=3, batches=2, rate=0.5).first()
    assert found.accuracy == pytest.approx(np.mean([said[r[0]] == r[2] for r in data if r[0] in said]))
