import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandlake.llm.source_divergence import opponent, shares, source_divergence

SHAPE = "doc_id long, lang string, source string, text string, value long, block long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, smooth=5, top=50):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]) for _, lang, source, text in rows]
    pairs, terms = set(), set()
    for lang in {d[0] for d in docs}:
        has, every, by = Counter(), Counter(), defaultdict(Counter)
        for x, s, ws in docs:
            if x == lang:
                has.update(set(ws))
                by[s].update(ws)
        kept = {w for w, n in has.items() if n >= least}
        for s in by:
            by[s] = Counter({w: n for w, n in by[s].items() if w in kept})
            every.update(by[s])
        share = lambda c: {w: 1 + 10**9 * (c[w] + smooth) // (sum(c.values()) + smooth * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in by.items()}, share(every)
        key = lambda x: (-x[0], x[1].encode())
        for s in by:
            far = sorted(((sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in by if o != s), key=key)
            pairs |= {(lang, s, o, v, i) for i, (v, o) in enumerate(far, 1)}
            more = sorted(((p[s][w] - q[w], w) for w in kept if by[s][w] and p[s][w] > q[w]), key=key)[:top]
            terms |= {(lang, s, w, v, i) for i, (v, w) in enumerate(more, 1)}
    return pairs, terms


def corpus(seed=3, n=160):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "straße", "Éclair", "x1y", "the", "THE", "日本", "a-b", "ÄÖ", "\U0001f600", "zeta", "\x7f", "q"]
    rows = []
    for i in range(n):
        source = f"s{rng.integers(9)}" if rng.random() > 0.4 else "hot"
        rows.append((i, ["en", "de", None, ""][rng.integers(4)], None if rng.random() < 0.05 else source, " ".join(rng.choice(words, rng.integers(0, 12)))))
    return [*rows, (None, "en", "bare", None), (1, "xx", "only", ""), (2, "yy", "a", "!!"), (3, "yy", "b", "..."), *rows[:5]]


def collected(found):
    return [{(r["lang"], r["source"], r["item"], r["value"], r["rank"]) for r in f.collect()} for f in found]


@pytest.mark.parametrize("options", [{}, {"shard_terms": 3, "block_bytes": 1, "least_blocks": 2}, {"least_blocks": 5, "top": 3}])
def test_matches_brute_force_whatever_the_shards_and_blocks(spark, options):
    rows = corpus()
    df = spark.createDataFrame([(*r, 7, 9) for r in rows], SHAPE).repartition(5)
    pairs, terms = source_divergence(df, least_docs=8, **options)
    want = brute(rows, 8, top=options.get("top", 50))
    assert collected((pairs, terms)) == list(want)
    assert pairs.count() == len(want[0]) and any(r[0] == "yy" and r[3] == 0 for r in want[0])


def test_without_rows(spark):
    assert [f.count() for f in source_divergence(spark.createDataFrame([], SHAPE))] == [0, 0]


@given(st.lists(st.integers(0, 10**15), min_size=1, max_size=5), st.integers(0, 10**15), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_shares_are_exact(counts, more, digits):
    total = max(1, sum(counts) + more)
    assert shares(np.array(counts, np.int64), total, digits).tolist() == [1 + 10**digits * c // total for c in counts]


def test_every_two_blocks_meet_once(spark):
    for n in (1, 2, 3, 4, 5, 8, 9):
        met = Counter()
        rounds = max(1, n + n % 2 - 1)
        df = spark.range(n).select("id", *(opponent(F.col("id"), r, F.lit(n).cast("long")).alias(f"r{r}") for r in range(rounds)))
        for row in df.collect():
            for r in range(rounds):
                o = row[f"r{r}"]
                if n > 1 and o is not None and o < n:
                    met[frozenset((row["id"], o))] += 1
        assert all(len(k) == 2 and v == 2 for k, v in met.items()) and len(met) == n * (n - 1) // 2
