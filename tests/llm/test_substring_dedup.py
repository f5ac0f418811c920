import hashlib
import re

from bandlake.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, n):
    owners = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - n + 1):
            if i is not None:
                owners.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - n + 1):
            if i is not None and min(owners[tuple(w[j : j + n])]) < i:
                gone.update(range(j, j + n))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def run(spark, rows, n=13, parts=3):
    found = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(parts), min_words=n)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()), key=str), found


def test_matches_brute_force(spark, tmp_path):
    import random

    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice(["", "é", "ß", "日本"])
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(80):
        body = [word() for _ in range(rnd.randrange(0, 50))]
        if i % 2:
            a = rnd.randrange(40)
            body[len(body) // 2 : len(body) // 2] = passage[a : a + rnd.randrange(5, 20)]
        rows.append((i * 7 % 83, rnd.choice([" ", "\n", "\t "]).join(body), "x"))
    rows += [(200, rows[3][1], "x"), (200, rows[3][1], "x"), (201, None, "x"), (202, "", None), (None, rows[5][1], "x"), (203, "w " * 40000, "x"), (204, "w " * 14, "x"), (205, "\x0b \x0c", "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    for n in (13, 6, 1):
        found = substring_dedup(spark.read.parquet(str(tmp_path / "d")), min_words=n)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()), key=str)
        assert got == brute(rows, n)


def test_spans_are_maximal_repeats(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame([(1, f"a {shared} b", ""), (2, f"c c {shared}", "")], SCHEMA)).collect()}
    assert list(got[1].span_start) == [] and list(got[2].span_start) == [2] and list(got[2].span_words) == [20]
    assert got[2].kept_text == "c c"


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    from bandlake.llm.catalog import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [(i, a, b, hashlib.sha256(t.encode()).hexdigest()) for i, a, b, t in brute(docs, 13)]
    got = [tuple(r) for r in QUERIES["op1_substring_dedup"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == want
