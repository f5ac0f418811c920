import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.llm import components, katz
from bandlake.llm.catalog import QUERIES
from bandlake.llm.katz import katz_scores

SHAPE = "doc_id long, text string, score double, train boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BEGIN, END = "<begin>", "<end>"


def tokens_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [END]


class Brute:
    """Katz backoff by dictionaries, probabilities by recursion."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            ts = [BEGIN] * (order - 1) + tokens_of(text)
            for i in range(order - 1, len(ts)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(ts[i - k + 1 : i + 1])] += 1
        self.total = sum(self.counts[1].values())
        self.vocabulary = {g[0] for g in self.counts[1]}
        self.d = [None] + [self.ratios(Counter(c.values())) for c in self.counts[1:]]
        self.after = [{} for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, c in self.counts[k].items():
                self.after[k].setdefault(g[:-1], {})[g[-1]] = c

    @staticmethod
    def ratios(n):
        for top in (5, 4, 3, 2):
            if all(n[r] for r in range(1, top + 2)):
                a = (top + 1) * n[top + 1] / n[1]
                if a < 1:
                    d = {r: ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, top + 1)}
                    if all(0 < x < 1 for x in d.values()):
                        return d
        off = min(n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5, 0.999)
        return {r: (r - off) / r for r in range(1, 6)}

    def kept(self, k, c):
        return c * self.d[k].get(c, 1.0)

    def p(self, w, context):
        """context: the tokens before w."""
        k = len(context) + 1
        seen = self.after[k].get(tuple(context), {})
        c = sum(seen.values())
        if not c:
            return self.p(w, context[1:]) if context else 1.0
        less = sum(self.kept(k, x) for x in seen.values())
        whole = c if c - less > 1e-9 else c + 1
        if w in seen:
            return self.kept(k, seen[w]) / whole
        rest = 1 - less / whole
        return rest / (1 - sum(self.p(x, context[1:]) for x in seen)) * self.p(w, context[1:]) if context else rest

    def score(self, text, order):
        ts = [BEGIN] * (order - 1) + tokens_of(text)
        return sum(math.log10(self.p(ts[i], tuple(ts[i - order + 1 : i]))) for i in range(order - 1, len(ts)))


def corpus(seed=1, n=60):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(40)] + ["The", "the", "Ünd", "ünd", "日本"])
    odds = 1 / np.arange(1, len(words) + 1)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 25), p=odds / odds.sum()))) for i in range(n)]
    return [*rows, (None, "the the the"), (1000, None), (1001, ""), (1002, "\t \n"), (1003, "never seen words"), (7, "w1\x0bw2\fw3"), *rows[:4], *[(2000 + i, "copied words " * 9) for i in range(12)]]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], SHAPE).repartition(4)


@pytest.mark.parametrize(("order", "limit", "groups"), [(1, None, 3), (2, None, None), (2, 4, 5), (3, 6, 3)])
def test_matches_recursion_over_dictionaries(spark, monkeypatch, order, limit, groups):
    monkeypatch.setattr(components, "BATCH_BYTES", 1500)
    monkeypatch.setattr(components, "GROUP_BYTES", 4000)
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    found = katz_scores(table(spark, rows), held_out=F.crc32(F.col("doc_id").cast("string")) % 4 == 2, order=order, limit=limit, groups=groups).collect()
    model = Brute([t for i, t in rows if not held(i)], order)
    n, v = model.total, len(model.vocabulary)
    want = []
    for i, t in rows:
        ts = tokens_of(t)
        c = [model.counts[1][(w,)] for w in ts]
        want.append((str(i), len(ts), sum(x > 0 for x in c), held(i), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c), model.score(t, order)))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"], r["base_score"], r["score"]) for r in found)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_reference_probabilities_add_to_one(order):
    model = Brute([t for _, t in corpus()], order)
    for context in list(model.after[order])[:80]:
        assert sum(model.p(w, context) for w in [*model.vocabulary, "<unknown>"]) == pytest.approx(1, abs=1e-9)


def test_discounts():
    n = np.array([0, 1000, 300, 140, 80, 55, 40])
    d = katz.discounts(n)
    assert len(d) == 6 and (d[1:] > 0).all() and (np.diff(d[1:]) > 0).all()
    # what Katz's discounts take in all is the number of n-grams seen once
    assert (np.arange(1, 6) * n[1:6] * (1 - d[1:])).sum() == pytest.approx(n[1])
    assert katz.discounts(np.array([0, 0, 0, 0, 0, 0, 0]))[1] == 0.5 and len(katz.discounts(np.array([0, 9, 3, 2, 0, 0, 0]))) in (3, 6)


def test_without_rows_and_without_training(spark):
    assert katz_scores(table(spark, [])).count() == 0
    rows = katz_scores(table(spark, [(1, "a b"), (2, None)]), held_out=F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(0, 0, 0.0, 0.0)] * 2


def test_query_foretells_held_out_texts_better_than_single_tokens(spark):
    found = QUERIES["op12_katz_scores"](spark, "/root/testdata/sf0.001").where("held_out and n_tokens > 30").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).first()
    assert found["n"] > 10 and found["s"] > found["b"]
