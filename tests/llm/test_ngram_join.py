import random
import re

from bandlake.llm.ngram_join import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"


def sets(t, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n=5, percent=75):
    s = [sets(t, n) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, x in enumerate(s):
        for g in x:
            where.setdefault(g, []).append(i)
    for i, x in enumerate(s):
        for j in {j for g in x for j in where[g] if j < i}:
            k = len(x & s[j])
            if 100 * k >= percent * (len(x) + len(s[j]) - k) and find(i) != find(j):
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s[i]), low.get(find(i))) for i, (d, *_) in enumerate(rows)), key=str)


def check(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    got = sorted((tuple(r) for r in ngram_join(spark.read.parquet(path))[0].collect()), key=str)
    assert got == brute(rows)


def test_matches_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    vocabulary = [a + b for a in "abcdefgh" for b in "xyzöß"]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(6, 60))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i * 11 % 163, " ".join(w).title() if i % 9 == 0 else "\n".join(w), "x"))
    rows += [(300, None, None), (301, "", "x"), (302, "\t ", "x"), (303, "one two", "x"), (304, "ONE two", "x"), (305, "two one", "x"), (306, "w " * 30000, "x"), (306, "w " * 30000, "x"), (None, rows[0][1], "x"), (307, "q " * 9, "x")]
    check(spark, str(tmp_path / "d"), rows)


def test_large_groups_of_near_copies(spark, tmp_path):
    """A chain and a large group whose members link with few of the others."""
    rnd = random.Random(6)
    core = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(core)
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(60)] = f"r{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w), "x"))
    chain = [f"k{i}" for i in range(200)]
    rows += [(1000 + i, " ".join(chain[i * 3 : i * 3 + 60]), "x") for i in range(40)]
    check(spark, str(tmp_path / "d"), rows)


def test_empty_table(spark):
    assert ngram_join(spark.createDataFrame([], SCHEMA))[0].count() == 0
