import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bandlake.llm.catalog import QUERIES
from bandlake.llm import quality as q
from bandlake.llm import toxicity as x
from bandlake.llm.quality import quality
from bandlake.llm.toxicity import toxicity

SF = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string, score string, label string", "doc_id long, quality int, toxic int"


def auc(rows):
    ordered = sorted(rows)
    ranks = [i for i, (_, y) in enumerate(ordered) if y]
    p, n = len(ranks), len(rows) - len(ranks)
    return (sum(ranks) - p * (p - 1) / 2) / (p * n)


@pytest.mark.parametrize(("name", "label", "least"), [("op9_toxicity", "toxic", 0.95), ("op6_quality_classifier", "quality", 0.98)])
def test_held_out_accuracy(spark, name, label, least):
    found = QUERIES[name](spark, SF)
    assert found.count() == 10000
    rows = found.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert auc([(r.score, r[label]) for r in rows]) > least
    assert sum(r.predicted == r[label] for r in rows) / len(rows) > 0.94


@pytest.mark.parametrize("f", [toxicity, quality])
def test_edges(spark, f):
    docs = [(i, ["fine words here and there", "vile nasty trash!!", None, ""][i % 4] + f" {i}" if i % 4 < 2 else [None, ""][i % 2], "x", "y") for i in range(80)]
    docs += [(None, "fine", None, None), (3, "", "x", "y"), (200, "long " * 30000, "x", "y")]
    labels = [(i, 1 - i % 2, i % 2) for i in range(0, 60)] + [(None, 1, 1), (61, None, None), (5, 0, 1)]
    d, empty = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    for lab in (spark.createDataFrame(labels, LABELS), empty, spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)):
        rows = f(d, lab).collect()
        assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert f(spark.createDataFrame([], DOCS), empty).count() == 0


def plain_terms(text):
    """Words, pairs, runs of punctuation and marks of a text, counted in plain Python."""
    words = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")
    low = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
    return Counter(["w " + w for w in low] + [f"p {a} {b}" for a, b in zip(low, low[1:], strict=False)] + ["m " + m for m in re.findall(r"[!-/:-@\[-`{-~]+", text or "")] + ["again" for a, b in zip(low, low[1:], strict=False) if a == b] + ["capitals" for w in words if len(w.encode()) > 1 and re.fullmatch("[A-Z]+", w)])


TEXTS = ["Eins zwei, zwei DREI!! vier", "zwei zwei zwei", "é été É, à la mer!! OK OK", "", None, "a", "vier drei zwei -- eins", "Eins zwei, zwei drei!! vier", "mer la à", "nie gesehen"]


def test_terms_and_nearest_neighbours():
    t = pa.table({"text": TEXTS})
    row, _, count = q.terms(t)
    for i, text in enumerate(TEXTS):
        assert np.allclose(sorted(count[row == i]), sorted(math.sqrt(n) for n in plain_terms(text).values()))
    votes = np.array([i % 2 for i in range(len(TEXTS))])
    model = q.fit([x or "" for x in TEXTS], votes, rank=6, k=4, least=1)
    # the same by full matrices: tf-idf, exact SVD, all cosines sorted by (similarity, place)
    every = sorted(set().union(*(plain_terms(x) for x in TEXTS)))
    n_of = {w: sum(w in plain_terms(x) for x in TEXTS) for w in every}
    m = np.array([[math.sqrt(plain_terms(x)[w]) * (math.log((1 + len(TEXTS)) / (1 + n_of[w])) + 1) for w in every] for x in TEXTS])
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    m = unit(m)
    v = unit(m @ np.linalg.svd(m, full_matrices=False)[2][:6].T)
    got = q.score(model, t)
    for i in range(len(TEXTS)):
        c = v @ v[i]
        near = sorted(range(len(TEXTS)), key=lambda j: (-round(c[j], 6), j))[:4]
        w = np.maximum(0, c[near]) ** 8
        want = (w * votes[near]).sum() / w.sum() if w.sum() > 1e-9 else votes.mean()
        assert abs(got[i] - want) < 1e-3, (i, got[i], want)


def test_ties_are_ordered_by_place():
    c = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.0, 0.0, 0.0, 0.0, 0.0], [0.1, 0.2, 0.3, 0.4, 0.5]])
    assert q.nearest(c, 3).tolist() == [[0, 1, 2], [0, 1, 2], [2, 3, 4]]


def test_words_matter():
    a, b = "the sun is on the sea " * 3, "our dog sat by our cat " * 3  # equal word lengths, no word in common
    model = q.fit([a, b] * 5, np.array([1, 0] * 5), k=3, least=1)
    assert q.score(model, pa.table({"text": [a, b]})).tolist() == [1.0, 0.0]


def test_features_are_the_distinct_character_ngrams():
    texts = ["Ünïcödé ist schön\tUND groß", "ABCDEFG abcdefg", "short", "", None, "日本語のテキストです、日本語の", "a" * 50]
    for sizes in [(2,), (6, 8)]:
        for text, h in zip(texts, x.features(pa.table({"text": texts}), sizes), strict=True):
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c == "\t" else c for c in text or "")
            assert len(set(h.tolist())) == len(h) == len({text[i : i + n] for n in sizes for i in range(len(text) - n + 1)})


def test_scores_are_the_linear_function_of_scaled_ngrams():
    texts = [f"{'vile trash talk' if i % 3 == 0 else 'lovely morning walk'} number {i * i}" for i in range(120)]
    y = np.array([int(i % 3 == 0) for i in range(120)])
    model = x.fit(texts, y)
    for text, got in zip(texts, x.score(model, pa.table({"text": texts})), strict=True):
        known = [h for h in next(x.features(pa.table({"text": [text]}), model.sizes)).tolist() if model.weight[h] != 0]
        want = 1 / (1 + math.exp(-(model.bias + sum(float(model.weight[h]) for h in known) / math.sqrt(max(1, len(known))))))
        assert abs(got - want) < 1e-5
    # weights have the sign of the n-grams' log-count ratios
    grams = {n: [next(x.features(pa.table({"text": [n]}), (6,)))[0], label] for n, label in (("vile t", 1), ("lovely", 0))}
    assert all((model.weight[h] > 0) == bool(label) for h, label in grams.values())


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i} " + "z" * (1000 if i == 3 else 1), "s", "l") for i in range(300)] + [(1, "same", "s", "l")] * 50, DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(7)], LABELS)
    texts, y = x.training_rows(docs, labels, "toxic", "doc_id", "text", 20)
    assert len(texts) == len(y) == 20 and texts == x.training_rows(docs.repartition(5), labels, "toxic", "doc_id", "text", 20)[0]
    texts, _ = x.training_rows(docs, labels, "toxic", "doc_id", "text", 1000, 500)
    assert 0 < sum(map(len, texts)) <= 500


def test_toxicity_is_fitted_by_a_task(spark, monkeypatch):
    texts = [f"{'vile trash talk' if i % 3 == 0 else 'lovely morning walk'} number {i * i}" for i in range(200)] + [None]
    docs = spark.createDataFrame([(i, text, "s", "l") for i, text in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(len(texts))], LABELS)
    want = x.fit(*x.training_rows(docs, labels, "toxic", "doc_id", "text", 150))
    monkeypatch.setattr(x, "fit", None)  # the driver neither gets the texts nor fits; workers import their own
    monkeypatch.setattr(x, "training_rows", None)
    got = x.fitted(docs, labels, "toxic", "doc_id", "text", 150)
    assert (got.weight == want.weight).all() and (got.bias, got.sizes) == (want.bias, want.sizes) and want.weight.any()
    assert x.toxicity(docs, labels).count() == x.toxicity(docs.repartition(3), labels).count() == len(texts)
    assert x.drop_toxic(docs, labels).count() == x.toxicity(docs, labels).where("predicted = 0").count() < len(texts)
