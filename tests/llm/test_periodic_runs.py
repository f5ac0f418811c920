import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bandlake.llm.catalog import QUERIES
from bandlake.llm.periodic_runs import find_runs, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def rows_of(doc_id, text, planted=True):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_matches_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    words = ["a", "b", "ç", "日本", "The", "the", "x,", " "]
    rows = [(None, "b b b b b b"), (0, None), (1, ""), (2, " \t\n"), (3, "a " * 6), (4, "x x x x x"), (4, "x x x x x"), (10**14, "z\x0bz\fz\rz z\nz")]
    for i in range(10, 260):
        unit = rnd.choices(words, k=rnd.randrange(1, 20))
        line = rnd.choices(words, k=rnd.randrange(30)) + unit * rnd.randrange(1, 9) + unit[: rnd.randrange(len(unit))] + rnd.choices(words, k=rnd.randrange(30))
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(line)))
    spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, runs string, best long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    want = [rows_of(*r) for r in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 100 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in want)


def test_empty_table_and_other_limits(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "p q p q p q r r r r")], "doc_id long, text string")
    row = periodic_runs(df, least=4, exponent=3).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 6, 2), (6, 4, 1)] and row["collapsed_text"] == "p q r" and tuple(row["best"]) == (6, 4, 1)
    with pytest.raises(ValueError):
        find_runs(np.arange(9), exponent=2)


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 40)), max_size=6), st.integers(3, 5), st.sampled_from([1, 6, 9]))
@settings(max_examples=400, deadline=None)
def test_runs_are_all_maximal_ones(parts, exponent, least):
    w = [u[i % len(u)] for u, n in parts for i in range(n)]
    assert find_runs(np.array(w, np.int64), least, exponent) == brute(w, least, exponent)


@pytest.mark.parametrize("sections", [64, 200])
def test_long_texts_are_searched_in_sections(monkeypatch, sections):
    monkeypatch.setattr("bandlake.llm.periodic_runs.SECTION", sections)
    rnd = random.Random(2)
    unit = [rnd.randrange(50) for _ in range(120)]
    w = [unit[i % 120] for i in range(1500)] + [7] * 300 + ([1] * 30 + [2]) * 12
    assert find_runs(np.array(w, np.int64)) == brute(w)


def test_time_follows_the_length():
    """Half a million equal words, and blocks of them between others: quadratic work would take minutes."""
    for w in ([5] * 500_000, ([1] * 1000 + [2]) * 400):
        assert len(find_runs(np.array(w, np.int64))) in (1, 401)
