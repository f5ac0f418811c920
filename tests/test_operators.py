import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.functions import text as T
from bandlake.operators import aggregates, corpus, metrics, probes, ranking, training


def test_splits(spark):
    df = spark.range(503).selectExpr("id", "cast(id % 3 as string) as label", "id div 10 as track")
    split = ranking.stratified_split(df, "label", "id").collect()
    assert len(split) == 503 and {k: sum(r.is_test for r in split if r.label == k) for k in "012"} == {"0": 34, "1": 34, "2": 33}
    groups = ranking.group_split(df, "track").collect()
    sides = {}
    for r in groups:
        sides.setdefault(r.track, set()).add(r.is_test)
    assert all(len(s) == 1 for s in sides.values()) and sum(True in s for s in sides.values()) == 11
    assert sum(r.is_dev for r in ranking.first_share(df, "id", 0.1).collect()) == 50
    ranks = sorted(r["rank"] for r in ranking.hashed_rank(df.withColumn("a", F.lit(1)), ["a"], "id").collect())
    assert ranks == list(range(1, 504))


def newton(x, y, c=1.0):
    x = np.c_[x, np.ones(len(x))]
    s = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1) / c, 1e-9)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (s * p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (s * (p - y)) + ridge * w)
    return w


def test_probes_match_a_direct_solver(spark):
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((400, 6)) * [1, 5, 1, 1, 0, 1]
    y = (x[:, 0] + 0.3 * x[:, 1] + rnd.standard_normal(400) > 1).astype(int)
    df = spark.createDataFrame([(i, str(y[i]), x[i].tolist()) for i in range(400)], "id int, label string, features array<double>")
    data = probes.split_features(df, "label", "id", "features").persist()
    fitted = probes.fit_probes(data, [probes.Probe("all", "1", ((0, 6),)), probes.Probe("some", "1", ((0, 1), (3, 5))), probes.Probe("few", "7", ((0, 6),))])
    assert fitted.skipped == ["few"]
    train = data.where("not is_test").toPandas()
    xt, yt = np.stack(train["features"]), (train["label"] == "1").to_numpy().astype(int)
    dev = np.where(xt.std(axis=0) > 0, xt.std(axis=0), 1)
    z = (xt - xt.mean(axis=0)) / dev
    assert np.allclose(fitted.weights[0], newton(z, yt), atol=1e-5) and np.allclose(fitted.weights[1], newton(z[:, [0, 3, 4]], yt), atol=1e-5)
    found = {r.probe: r for r in probes.evaluate(data, fitted).collect()}
    assert found["all"].accuracy > 0.75 > 0 and found["all"].n == data.where("is_test").count()
    multi = probes.multinomial_probe(data)
    assert multi.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] > 0.75


def test_band_probe_finds_the_band(spark):
    rnd = np.random.default_rng(1)
    t = np.arange(32)
    rows = [(i, "low" if i % 2 else "high", (np.cos(2 * np.pi * (2 if i % 2 else 11) * t / 32 + rnd.random() * 6) + 0.3 * rnd.standard_normal(32)).tolist()) for i in range(200)]
    found = probes.band_probe(spark.createDataFrame(rows, "id int, label string, series array<double>"), "label", "id").collect()
    best = {(r.kind, r.band): r.accuracy for r in found if r.target == "low"}
    assert best["full", 0] == 1.0 == best["auto", 0] and best["band", 0] == 1.0 == best["band", 2] and best["band", 1] < 1


def test_metrics_on_unseen_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c"), ("b", "b")], "t string, p string")
    table = metrics.confusion(df, "t", "p")
    assert table.count() == 9 and table.agg(F.sum("n")).first()[0] == 4
    s = metrics.scores(table).first()
    assert s.accuracy == 0.5 and np.isclose(s.macro_f1, (2 / 3 + 0.5 + 0) / 3)
    flat = spark.createDataFrame([(0, 0, 0.5), (0, 1, -0.5)], "feature_idx int, k int, weight double")
    assert [r.weight for r in metrics.weight_profile(flat).collect()] == [0.0, 0.0]


def test_correlation_and_lookup(spark):
    energy = spark.createDataFrame([(i, float(i)) for i in range(12)], "track_id int, e double")
    bpm = spark.createDataFrame([(i, 2.0 * i) for i in range(9)] + [(9, float("nan")), (9, 18.0), (10, None)], "track_id int, bpm double")
    joined = aggregates.lookup_join(energy, bpm, "track_id", "bpm")
    assert joined.count() == 12
    r = aggregates.correlation(joined, "e", "bpm").first()
    assert r.n == 10 and np.isclose(r.r, 1)
    assert aggregates.correlation(joined.limit(5), "e", "bpm").first().r is None


def test_corpus(spark):
    df = spark.createDataFrame([(1, "a b", "X Y"), (2, "c", "X")], "id int, text string, label string")
    assert {r.level for r in corpus.labelled(df, "id", ["text"], "label").collect()} == {"token"}
    assert {r.level for r in corpus.labelled(df.where("id = 2"), "id", ["text", "text"], "label").collect()} == {"multiple"}
    line = spark.createDataFrame([("(S (NP (DT The) (NN dog)) (-LRB- -LRB-) (VBZ runs))",)], "value string")
    assert tuple(corpus.convert_parses(line).first()) == ("The dog ( runs", "DT NN -LRB- VBZ")
    reviews = spark.createDataFrame([("en", "train", "good", 5, "book")], "lang string, split string, review_body string, stars int, product_category string")
    assert {(r.view, r.label) for r in corpus.convert_reviews(reviews).collect()} == {("sentiment", "+"), ("topic", "book")}
    entities = spark.createDataFrame([(["New", "York"], [5, 6])], "tokens array<string>, ner_tags array<int>")
    assert tuple(corpus.convert_entities(entities).first()) == ("New York", "B-LOC I-LOC")
    questions = spark.createDataFrame([(i, {"en": f"q{i}", "zh_cn": f"z{i}"}, {"en": ("t", f"a{i}" if i else None), "zh_cn": ("t", f"b{i}")}) for i in range(6)], "id int, queries map<string,string>, answers map<string,struct<type:string,text:string>>")
    pairs = corpus.convert_questions(questions).collect()
    assert {r.lang for r in pairs} == {"en", "zh"} and sum(r.label == "1" for r in pairs) == 10 == sum(r.label == "0" for r in pairs)
    assert all((r.text1[1:] == str(r.id)) == (r.label == "1") for r in pairs)
    deps = spark.createDataFrame([(["a b", "c"], ["nsubj:pass", "root"], ["N", "V"])], "words array<string>, relations array<string>, tags array<string>")
    assert tuple(corpus.convert_dependencies(deps).first()) == ("ab c", "nsubj root")
    files = spark.createDataFrame([(f"x/20news-{s}/sci/{n}", b"caf\xe9") for s in ("train", "test") for n in (1, 2, 3, 4, 5, "readme")], "path string, content binary")
    news = corpus.convert_newsgroups(files).collect()
    assert sorted(r.split for r in news) == ["dev"] + ["test"] * 5 + ["train"] * 4 and news[0].text == "café"
    chords = spark.createDataFrame([("t", "p", 1.0, 2.0, "C:maj7")], "track_id string, audio_path string, time double, duration double, value string")
    assert tuple(corpus.convert_chords(chords).first())[2:] == (1.0, 3.0, "C:maj", "C:maj7")
    with pytest.raises(Exception):
        corpus.evaluate(df, df).collect()
    p = spark.createDataFrame([([0.5, 0.7],), ([50.0],)], "a array<double>").select(T.percent(F.col("a")).alias("p")).collect()
    assert [list(r.p) for r in p] == [[50.0, 70.0], [50.0]]


def test_wide_and_multinomial_probes(spark):
    """Quasi-Newton steps end where Newton steps do; multinomial probes match a direct solver; samples of many features are flattened."""
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((240, 3, 8))
    y = (x[:, 0, 2] + x[:, 2, 5] + 0.7 * rnd.standard_normal(240) > 0).astype(int) + (x[:, 1, 1] > 0.8)
    rows = [(i, f, str(y[i]), x[i, f].tolist()) for i in range(240) for f in range(3)]
    df = spark.createDataFrame(rows, "id int, feature_idx int, label string, series array<double>")
    flat = probes.flatten_samples(df, "id", "label", ["feature_idx"])
    assert np.allclose([r.features for r in flat.orderBy("id").collect()], x.reshape(240, 24))
    data = probes.split_features(flat, "label", "id", "features").persist()
    wanted = [probes.Probe("one", "1", ((0, 8),), 8, 3), probes.Probe("all", None, ((0, 24),)), probes.Probe("band", None, ((2, 4), (5, 6)), 8, 3)]
    assert wanted[2].positions().tolist() == [2, 3, 5, 10, 11, 13, 18, 19, 21]
    newton_, quasi = probes.fit_probes(data, wanted), probes.fit_probes(data, wanted, max_width=0)
    for a, b in zip(newton_.weights, quasi.weights, strict=True):
        assert np.allclose(a - a.mean(axis=0) * (len(a) > 1), b - b.mean(axis=0) * (len(b) > 1), atol=1e-3)
    # gradient of the multinomial objective at the solution, computed directly
    train = data.where("not is_test").toPandas()
    z = np.c_[(np.stack(train["features"]) - newton_.mean) / newton_.scale, np.ones(len(train))]
    hot = np.array([[v == c for c in newton_.classes] for v in train["label"]], float)
    s = hot @ (len(hot) / (len(newton_.classes) * hot.sum(axis=0)))
    p = np.exp(z @ newton_.weights[1].T)
    g = (s[:, None] * (p / p.sum(axis=1, keepdims=True) - hot)).T @ z + newton_.weights[1] * np.append(np.ones(24), 0)
    assert np.abs(g).max() < 1e-4
    found = {r.probe: r for r in probes.evaluate(data, newton_).collect()}
    said = probes.predictions(data, newton_).where("probe = 'all'").collect()
    assert found["all"].accuracy == np.mean([r.label == r.prediction for r in said]) and found["all"].accuracy > 0.6 and found["all"].n == len(said)


def test_probes_have_no_width_limit(spark):
    rnd = np.random.default_rng(6)
    x = rnd.standard_normal((80, 3000))
    df = spark.createDataFrame([(i, "ab"[int(x[i, 7] > 0)], (x[i] + 3 * (x[i, 7] > 0)).tolist()) for i in range(80)], "id int, label string, series array<double>")
    found = probes.band_probe(df, "label", "id", transform="haar", band_width=1500).collect()
    assert {(r.kind, r.band) for r in found} == {("full", 0), ("band", 0), ("band", 1), ("cumulative", 0), ("cumulative", 1), ("auto", 0)} and max(r.accuracy for r in found) == 1.0


def test_layers_features_and_pipeline(spark):
    rnd = np.random.default_rng(7)
    rows = [(i, f"{i % 3}", layer, f, (rnd.standard_normal(16) + (i % 3 if layer == 2 else 0)).tolist()) for i in range(90) for layer in (0, 2) for f in range(2)]
    df = spark.createDataFrame(rows, "id int, label string, layer int, feature_idx int, series array<double>")
    found = {(r.layer, r.target): r.accuracy for r in probes.layer_probes(df, "label", "id", "layer", ["feature_idx"]).collect()}
    assert len(found) == 6 and found[2, "2"] > 0.9 > found[0, "2"]
    assert probes.resolve_layers([-1, 0, 12, -13], 13) == [0, 12]
    with pytest.raises(ValueError):
        probes.resolve_layers([13], 13)
    one = df.where("layer = 2 and feature_idx = 0")
    kinds = {r.variant: r.accuracy for r in probes.feature_probes(one, "label", "id").collect()}
    assert set(kinds) == {"time", "dct", "mel", "log", "haar"} and kinds["dct"] > 0.7
    bins = {(r.target, r.k): r.accuracy for r in probes.bin_profiles(one, "label", "id").collect()}
    assert len(bins) == 27 and bins["2", 0] > 0.9
    got = {(r.metric, r.target): r.value for r in probes.run_pipeline(df.where("layer = 2"), {"label": "label", "id": "id", "feature": "feature_idx", "band_width": 4}).collect()}
    assert ("full_0", "2") in got and ("auto_0", "2") in got and got["full_0", "2"] > 0.9
    multi = {r.metric: r.value for r in probes.run_pipeline(one, {"label": "label", "id": "id", "probe": "multiclass"}).collect()}
    assert set(multi) == {"accuracy", "macro_f1", "weighted_f1"}
    with pytest.raises(ValueError, match="colour"):
        probes.run_pipeline(one, {"label": "label", "id": "id", "colour": 1})


def test_filter_is_learnt(spark):
    """Labels depend on the slow part of a series beside a fast one: the filter opens for it, and its gradient is that of the loss."""
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(60):
        t = np.arange(12 + i % 5)
        slow, fast = np.cos(np.pi * t / len(t) + i), 2 * rnd.standard_normal() * np.cos(np.pi * t * 0.9)
        rows.append((i, (slow > 0).astype(int).astype(str).tolist(), [(slow + fast).tolist(), fast.tolist()]))
    df = spark.createDataFrame(rows, "id int, labels array<string>, features array<array<double>>").persist()
    logits, weights, classes, losses = training.learn_filter(df, 8, steps=40)
    assert classes == ["0", "1"] and losses[-1] < 0.5 * losses[0]
    said = training.label_tokens(df, logits, weights, classes).orderBy("id").collect()
    right = [a == b for r in said for a, b in zip(r.labels, r.predicted, strict=True)]
    assert np.mean(right) > 0.9


def test_null_groups_and_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (4, "b"), (None, None)], "id int, label string")
    assert ranking.stratified_split(df, "label", "id").count() == 5 == ranking.group_split(df, "label").count()
    assert ranking.first_share(df, "id", 0.5).count() == 5
    for seed in (None, 7):
        assert sorted(r.batch for r in ranking.batches(df, "id", 2, seed).collect()) == [0, 0, 1, 1, 2]
    clustered = spark.range(1000).selectExpr("if(id = 999, 1000000000, id) as id")
    assert sorted(r.batch for r in ranking.batches(clustered, "id", 100).where("id < 200").collect()) == [0] * 100 + [1] * 100


def test_negatives_are_whole(spark):
    rows = [(i, "g", "same") for i in range(50)] + [(100 + i, "g", f"other {i}") for i in range(3)] + [(200, "h", "alone"), (300, None, "x"), (301, None, "y"), (400, "g", None)]
    df = spark.createDataFrame(rows, "id int, grp string, text string")
    text = {i: t for i, _, t in rows}
    found = corpus.negatives(df, "id", "grp", "text", 3).collect()
    per = {}
    for r in found:
        per.setdefault(r.id, set()).add(text[r.negative_id])
        assert text[r.id] != text[r.negative_id]
    assert all(len(per[i]) == 3 for i in [*range(50), 100, 101, 102]) and per[300] == {"y"} and 200 not in per and 400 not in per


def test_band_layouts_by_definition():
    from bandlake.functions import bands

    assert bands.allocated(512, 5, exact=False) == [(0, 103), (102, 204), (204, 306), (306, 408), (408, 511)]
    for n in range(1, 40):
        for count in range(1, n + 1):
            exact = bands.allocated(n, count)
            assert [k for lo, hi in exact for k in range(lo, hi)] == list(range(n))
            sizes = [hi - lo for lo, hi in exact]
            wide = [b for b, s in enumerate(sizes) if s > n // count]
            left = (len(wide) + 1) // 2
            assert len(wide) == n % count and wide == [*range(left), *range(count - len(wide) + left, count)]
            assert [lo for lo, _ in bands.allocated(n, count, exact=False)] == [b * (n // count) for b in range(count)]


def test_text_probe(spark, tmp_path):
    from bandlake.operators import text_probe as tp

    rnd = np.random.default_rng(2)
    words, kinds = ["red", "blue", "run", "jump"], {"red": "ADJ", "blue": "ADJ", "run": "VERB", "jump": "VERB"}

    def texts(n, shift):
        out = []
        for i in range(n):
            w = [words[j] for j in rnd.integers(0, 4, 6)]
            out.append((i + shift, [" ".join(w)], [kinds[x] for x in w], "token"))
        return spark.createDataFrame(out, "id int, texts array<string>, labels array<string>, level string")

    train, valid = texts(40, 0), texts(15, 100)
    scores, said = tp.text_probe(train, valid)
    assert scores.first().accuracy == 1.0 and said.count() == 90 and {r.prediction for r in said.collect()} == {"ADJ", "VERB"}
    assert tp.text_probe(train, valid, "auto(4)")[0].first().accuracy > 0.9
    assert tp.text_probe(train, valid, "band(16, 12, 15)")[0].first().accuracy < 1.0
    pairs = spark.createDataFrame([(i, ["red red", "run" if i % 2 else "jump"], ["yes" if i % 2 else "no"], "multiple") for i in range(30)], "id int, texts array<string>, labels array<string>, level string")
    found, guesses = tp.text_probe(pairs, pairs, pooling="mean", repeats=2)
    assert [r.accuracy for r in found.collect()] == [1.0, 1.0] and guesses.count() == 60
    for bad in ({"classifier": "tree"}, {"pooling": "max"}, {"encoder": "none"}):
        with pytest.raises(ValueError, match="unknown"):
            tp.text_probe(train, valid, **bad)
    with pytest.raises(ValueError, match="not in the training"):
        tp.text_probe(train, pairs)
    # ids that are shared or missing, under a filter too
    odd = train.limit(5).withColumn("id", F.when(F.col("id") < 2, 7).when(F.col("id") < 4, None).otherwise(F.col("id")))
    for text in ("nofilter()", "band(16, 0, 3)"):
        found = tp.encode(odd, filter_text=text)
        assert found.count() == 5 and {len(r.features) for r in found.collect()} == {8} and {len(x) for r in found.collect() for x in r.features} == {6}
    with pytest.raises(ValueError, match="1 texts have other numbers"):
        tp.text_probe(train.unionByName(spark.createDataFrame([(900, ["red"], ["ADJ", "VERB"], "token")], train.schema)), valid)


def test_seeds_count_and_tasks_are_not_run_twice(spark, tmp_path):
    from bandlake.operators import text_probe as tp

    rnd = np.random.default_rng(5)
    make = lambda n: spark.createDataFrame([(i, [" ".join(w)], [("a" if x < "w5" else "b") if rnd.random() < 0.7 else "a" for x in w], "token") for i in range(n) for w in [[f"w{k}" for k in rnd.integers(0, 10, 5)]]], "id int, texts array<string>, labels array<string>, level string")
    tasks, path = {"noisy": (make(30), make(30))}, str(tmp_path / "runs")
    options = {"epochs": 2, "batches": 2, "rate": 0.02, "path": path}
    got = tp.run_tasks(tasks, ["nofilter()"], (1, 2, 3), **options).collect()
    again = tp.run_tasks(tasks, ["nofilter()"], (1, 2, 3), **options).collect()
    assert len(got) == 3 and len({(r.accuracy, r.macro_f1) for r in got}) == 3 and got == again
    learnt = tp.run_tasks(tasks, ["auto(4)", "band(8, 0, 2)"], (1,), **(options | {"path": None})).collect()
    assert [(r["filter"], r.seed) for r in learnt] == [("auto(4)", 1), ("band(8, 0, 2)", 1)]


def test_tasks_have_means_and_deviations_over_seeds(spark):
    """Each run's scores, beside them their mean and deviation over the seeds of its task and filter, in the query too."""
    from bandlake import catalog
    from bandlake.operators import text_probe as tp

    rnd = np.random.default_rng(5)
    make = lambda n: spark.createDataFrame([(i, [" ".join(w)], [("a" if x < "w5" else "b") if rnd.random() < 0.7 else "a" for x in w], "token") for i in range(n) for w in [[f"w{k}" for k in rnd.integers(0, 10, 5)]]], "id int, texts array<string>, labels array<string>, level string")
    found = tp.run_tasks({"noisy": (make(30), make(30))}, ["nofilter()", "band(8, 0, 2)"], (1, 2, 3), epochs=1, batches=2, rate=0.02).collect()
    query = catalog.QUERIES["turn_role_filters"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 6 and len(query) == 6 and {r["accuracy_std"] > 0 for r in found} >= {True}
    for rows, near in ((found, 1e-12), (query, 2e-4)):
        for r in rows:
            for score in ("accuracy", "macro_f1", "weighted_f1"):
                each = [x[score] for x in rows if (x["task"], x["filter"]) == (r["task"], r["filter"])]
                assert r[f"{score}_mean"] == pytest.approx(np.mean(each), abs=near) and r[f"{score}_std"] == pytest.approx(np.std(each), abs=near)


def test_text_probe_over_pieces(spark, tmp_path):
    from bandlake.functions.subwords import Vocabulary, byte_symbols
    from bandlake.operators import encoding
    from bandlake.operators import text_probe as tp

    names = [*byte_symbols(), *(s + "</w>" for s in byte_symbols()), "red</w>", "run</w>", "jump"]
    v = Vocabulary({p: k for k, p in enumerate(names)}, len(names), len(names) + 1)
    encoder = encoding.PieceEncoder(v, np.random.default_rng(3).normal(size=(len(v), 6)))
    words, kinds = ["red", "blue", "run", "jumps"], {"red": "ADJ", "blue": "ADJ", "run": "VERB", "jumps": "VERB"}
    rnd = np.random.default_rng(6)
    rows = [(i, [" ".join(w)], [kinds[x] for x in w], "token") for i in range(30) for w in [[words[k] for k in rnd.integers(0, 4, 5)]]]
    df = spark.createDataFrame(rows, "id int, texts array<string>, labels array<string>, level string")
    cache = encoding.EncodingCache(spark, str(tmp_path / "c"))
    scores, said = tp.text_probe(df, df, encoder=encoder, cache=cache)
    n = {"red": 1, "blue": 4, "run": 1, "jumps": 2}
    assert said.count() == sum(n[w] for r in rows for w in r[1][0].split()) and scores.first().accuracy == 1.0 and cache.added == 0


def test_saved_probes(spark, tmp_path):
    from bandlake.operators import text_probe as tp

    data = spark.createDataFrame([(str(i % 2), [float(i % 2), float(i)], i % 5 == 0) for i in range(40)], "label string, features array<double>, is_test boolean")
    fitted = probes.fit_probes(data, [probes.Probe("all", None, ((0, 2),)), probes.Probe("b", "1", ((0, 1),))])
    tp.save_fitted(spark, fitted, str(tmp_path / "f"))
    again = tp.load_fitted(spark, str(tmp_path / "f"))
    assert sorted(map(str, probes.evaluate(data, again).collect())) == sorted(map(str, probes.evaluate(data, fitted).collect()))


def test_steps_dont_split_again(spark):
    """The rows of a fit are computed once, not at every step."""
    from bandlake.operators.probes import Probe, fit_probes

    seen = spark.sparkContext.accumulator(0)

    def counted(stream):
        for batch in stream:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(80).selectExpr("cast(id % 3 as string) as label", "array(cast(id % 7 as double), cast(id % 5 as double)) as features", "id % 5 = 0 as is_test")
    data = rows.mapInArrow(counted, rows.schema)
    fit_probes(data, [Probe("all", None, ((0, 2),))])
    assert seen.value == 80 and not data.storageLevel.useMemory
