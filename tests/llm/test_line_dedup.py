import random

from hypothesis import given, settings
from hypothesis import strategies as st

from bandlake.llm.line_dedup import edits_within, line_dedup

SCHEMA = "doc_id long, text string, n_lines string, line int"


def edit_within(a, b, k):
    return bool(edits_within([a], [b], k)[0])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=1500, deadline=None)
@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12), st.integers(0, 4))
def test_edit_distance(a, b, k):
    assert edit_within(a, b, k) == (distance(a, b) <= k)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=20, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.sampled_from(["a", "b", "", "ab"])), max_size=5), st.integers(1, 3))
def test_edit_distance_of_near_lines(a, edits, k):
    b = a
    for p, x in edits:
        b = b[:p] + x + b[p + 1 :]
    assert edit_within(a, b, k) == (distance(a, b) <= k)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=9), st.text("abé", max_size=9)), max_size=30), st.integers(0, 3), st.sampled_from([1, 50, 1 << 20]))
def test_many_pairs_at_once(pairs, k, cells):
    assert edits_within([a for a, _ in pairs], [b for _, b in pairs], k, cells).tolist() == [distance(a, b) <= k for a, b in pairs]


def brute(rows, edits=2, least=20):
    blank = " \t\r\x0b\f"
    places = [(i if i is not None else -(1 << 63), p, x.strip(blank), k) for k, (i, t, *_) in enumerate(rows) for p, x in enumerate((t or "").split("\n")) if x.strip(blank)]
    names = sorted({x for *_, x, _ in places})
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = [x for x in names if len(x) >= least]
    for a in long:
        for b in long:
            if a < b and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                root[find(a)] = find(b)
    low = {}
    for i, p, x, _ in places:
        low[find(x)] = min((i, p), low.get(find(x), (i, p)))
    gone = {(k, p) for i, p, x, k in places if (i, p) > low[find(x)]}
    out = []
    for k, (i, t, *_) in enumerate(rows):
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone)
        out.append((i, sum(1 for *_, q in places if q == k), sum(1 for q, _ in gone if q == k), kept))
    return sorted(out, key=str)


def test_matches_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(12, 45))) for _ in range(25)]

    def near():
        x = rnd.choice(base)
        for _ in range(rnd.choice([0, 1, 2, 3])):
            p = rnd.randrange(len(x))
            x = x[:p] + rnd.choice(["", "z", "zq", "日"]) + x[p + rnd.randrange(2) :]
        return rnd.choice(["", "", "  "]) + x

    rows = [(i * 7 % 101, "\n".join(near() for _ in range(rnd.randrange(5))), "x", 1) for i in range(60)]
    rows += [(200, None, "x", 1), (201, "", "x", 1), (202, "\n \n", None, None), (203, rows[0][1], "x", 1), (203, rows[0][1], "x", 1), (None, base[0], "x", 1), (204, "long line " * 4000 + "\n" + "long line " * 4000, "x", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    found = line_dedup(spark.read.parquet(str(tmp_path / "d")))
    assert found.columns == ["doc_id", "text", "line", "n_lines", "n_removed", "removed_places"]
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in found.collect()), key=str)
    assert got == brute(rows)


def test_lines_that_begin_and_end_in_f(spark):
    lines = ["of", "o", "if", "i", "elf", "el", "fall", "all", "f", "ff", "\fof\f", "f", "\f", " \fcalf of a long line that ends in f", "cal"]
    rows = [(1, "\n".join(lines), "x", 1), (2, "el\nelf\nf\nfine\nine", "x", 1)]
    got = line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got), key=str) == brute(rows)
    assert {r.doc_id: r.removed_places for r in got} == {1: [10, 11], 2: [0, 1, 2]}


def test_rows_without_an_id(spark):
    """They are told apart by their texts: each loses its own repeated lines only."""
    a, b = "a first line of twenty characters", "another line that is long enough"
    rows = [(None, f"{a}\n{b}", "x", 1), (None, f"something else here at length\n{b}", "x", 1), (4, f"{b}\nthe last of all these long lines", "x", 1)]
    got = {r.text for r in line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "the last of all these long lines" in got and f"{a}\n{b}" in got | {f"{a}\n{b}"} and len(got) == 3
    # b stands at place 1 of both rows without an id, so neither removes the other's
    assert got == {f"{a}\n{b}", f"something else here at length\n{b}", "the last of all these long lines"}


def test_many_near_lines_and_empty_table(spark):
    stem = "a line that a great many documents have, number "
    rows = [(i, stem + f"{i:03d}"[::-1], "x", 1) for i in range(300)]
    got = line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got if r.n_removed == 0) == [0]
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
