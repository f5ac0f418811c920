import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.functions import subwords
from bandlake.functions.subwords import Vocabulary, byte_symbols, cut_longest, pieces, read_vocabulary
from bandlake.operators import encoding

FILE = "/opt/tokenizers/word_bpe_49k.json"


def small(*more):
    symbols = byte_symbols()
    names = [*symbols, *(s + "</w>" for s in symbols), *more]
    return Vocabulary({p: k for k, p in enumerate(names)}, len(names), len(names) + 1)


def brute(vocabulary, text):
    """(piece string, start, end) of an ASCII text."""
    out, at = [], 0
    while at < len(text):
        kind = lambda c: "L" if c.isalpha() else "N" if c.isdigit() else " " if c.isspace() else "P"
        to = at + 1
        while kind(text[at]) in "LP" and to < len(text) and kind(text[to]) == kind(text[at]):
            to += 1
        word = text[at:to].lower()
        i = 0
        while i < len(word) and kind(text[at]) != " ":
            fits = [j for j in range(i + 1, len(word) + 1) if (word[i:j] + ("</w>" if j == len(word) else "")) in vocabulary.pieces]
            j = max(fits)
            out.append((word[i:j] + ("</w>" if j == len(word) else ""), at + i, at + j))
            i = j
        at = to
    return out


def test_pieces_and_offsets(spark):
    v = small("re", "run</w>", "ru", "nn", "ing</w>", "runn", "é".encode().decode("latin-1"))
    back = {k: p for p, k in v.pieces.items()}
    texts = ["Running, rerun  RUN-7x", "", "a\tb 12", None, "été İx 日"]
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)] + [(9, None), (10, ["run re", "running"])], "id int, texts array<string>")
    rows = {r["id"]: r["p"] for r in df.select("id", pieces(F.col("texts"), v).alias("p")).collect()}
    for i in (0, 1, 2):
        p = rows[i]
        got = [(back[k], a, b) for k, a, b, s in zip(p["ids"], p["start"], p["end"], p["special"]) if not s]
        assert got == brute(v, texts[i])
        assert p["ids"][0] == v.begin and p["ids"][-1] == v.end and p["special"].count(True) == 2
    assert rows[9] is None and len(rows[3]["ids"]) == 2
    p = rows[4]  # offsets are of characters, whatever their bytes
    assert [(a, b) for a, b, s in zip(p["start"], p["end"], p["special"]) if not s][-3:] == [(7, 8)] * 3
    p = rows[10]
    assert p["word"] == [-1, 0, 1, 1, -1, 0, 0, -1] and p["text"] == [0, 0, 0, 0, 0, 1, 1, 1] and [back.get(k) for k in p["ids"]][5:7] == ["runn", "ing</w>"]
    cut = df.where("id = 10").select(pieces(F.col("texts"), v, 6)["ids"]).first()[0]
    assert len(cut) == 6 and cut.count(v.end) == 2


def test_cut_longest():
    def brute(sizes, room):
        sizes = list(sizes)
        while sum(sizes) > max(0, room):
            sizes[max(i for i, s in enumerate(sizes) if s == max(sizes))] -= 1
        return sizes

    rnd = np.random.default_rng(1)
    for _ in range(400):
        sizes, room = rnd.integers(0, 30, rnd.integers(1, 5)).tolist(), int(rnd.integers(-2, 60))
        assert cut_longest(sizes, room) == brute(sizes, room)


def test_vocabularies(spark, tmp_path):
    with pytest.raises(ValueError, match="no pieces"):
        Vocabulary({"a": 0}, 1, 2)
    if os.path.exists(FILE):
        v = read_vocabulary(spark, FILE)
        assert len(v) == 49408 and [k for k, _ in subwords.Splitter(v).vocabulary.match("running")] == [v.pieces["running</w>"]]


def test_vectors_are_sums_of_information(spark):
    v = small("red", "red</w>", "blue</w>", "sea</w>")
    rows = [["red sea", "blue"], ["blue sea sea"], ["red red"], None, [None, ""]]
    df = spark.createDataFrame([(t,) for t in rows], "texts array<string>")
    got = encoding.train_vectors(df, v, dims=16, window=2, seed=7)
    ids = [r["i"] for r in df.select(pieces(F.col("texts"), v)["ids"].alias("i")).collect() if r["i"]]
    counts = {}
    for x in ids:
        for i in range(len(x)):
            for j in range(i + 1, min(len(x), i + 3)):
                for a, b in ((x[i], x[j]), (x[j], x[i])):
                    counts[a, b] = counts.get((a, b), 0) + 1
    single, total = {}, sum(counts.values())
    for (a, _), n in counts.items():
        single[a] = single.get(a, 0) + n
    bits = {r["y"]: r["h"] for r in spark.createDataFrame([(k,) for k in single], "y int").select("y", F.xxhash64("y", F.lit(7)).alias("h")).collect()}
    for a in single:
        want = np.zeros(16)
        for (x, b), n in counts.items():
            if x == a:
                want += max(0.0, np.log(n * total / (single[a] * single[b]))) * np.array([2 * (bits[b] >> d & 1) - 1 for d in range(16)])
        assert np.allclose(got[a], want / np.linalg.norm(want))


def test_a_second_run_encodes_nothing(spark, tmp_path):
    v = small("red</w>", "sea</w>")
    encoder = encoding.PieceEncoder(v, np.random.default_rng(3).normal(size=(len(v), 4)))
    first = spark.createDataFrame([(1, ["red sea"]), (2, ["red"]), (2, ["red"]), (None, ["red sea"]), (3, None), (4, ["red", "sea"])], "id int, texts array<string>")
    cache = encoding.EncodingCache(spark, str(tmp_path / "cache"))
    found = cache.encode(first, encoder)
    plain = encoder.rows(first)
    key = lambda r: (str(r["id"]), str(r["texts"]), str(r["features"]), str(r["pieces"]))
    assert sorted(map(key, found.collect())) == sorted(map(key, plain.collect())) and cache.added == 3
    again = encoding.EncodingCache(spark, str(tmp_path / "cache"))
    assert again.encode(first, encoder).count() == 6 and again.added == 0
    more = first.unionByName(spark.createDataFrame([(9, ["red sea red"])], "id int, texts array<string>"))
    assert again.encode(more, encoder).where("features is not null").count() == 6 and again.added == 1
    other = encoding.PieceEncoder(v, encoder.vectors + 1)
    assert other.name != encoder.name and again.encode(first, other).count() == 6 and again.added == 3
    assert again.encode(first, encoder, limit=3).count() == 6 and again.added == 3


def test_hidden_states_and_labels(spark):
    v = small("red</w>", "sea</w>")
    encoder = encoding.PieceEncoder(v, np.random.default_rng(3).normal(size=(len(v), 3)), fade=0.4, mix=0.7)
    ids = np.array([5, 9, 100, 5])
    x = encoder.vectors[ids]
    want = np.array([np.tanh(x[i] + 0.7 * sum((0.4 ** abs(i - j)) * x[j] for j in range(4) if j != i)) for i in range(4)]).T
    assert np.allclose(encoder.hidden(ids), want)
    df = spark.createDataFrame([(["red zz", "sea"], ["A", "B", "C"])], "texts array<string>, labels array<string>")
    kept = encoding.content(encoder.rows(df))
    row = kept.withColumn("l", encoding.piece_labels(F.col("labels"), F.col("pieces.word"), F.col("pieces.text"))).first()
    assert row["l"] == ["A", "B", "B", "C"] and len(row["features"]) == 3 and {len(s) for s in row["features"]} == {4} and not any(row["pieces"]["special"])


def test_pieces_take_few_bytes():
    """A task holds machine integers, not objects, for the pieces of its texts."""
    import tracemalloc

    splitter = subwords.Splitter(small("re"))
    text = "rerun area 7 " * 20_000
    n = len(splitter.split("rerun area 7 ")) * 20_000
    tracemalloc.start()
    found = splitter.columns(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in found] == [n] * 4 and peak < 40 * n
    splitter._word("a" * 5000)
    assert "a" * 5000 not in splitter.known


def test_states_are_handed_on_in_blocks(spark, monkeypatch):
    """A task hands on bounded blocks of hidden states, the same as those of each text on its own."""
    v = small("re")
    vectors = encoding.train_vectors(spark.createDataFrame([(["rerun area"],)], "texts array<string>"), v, dims=4)
    encoder = encoding.PieceEncoder(v, vectors)
    sizes = np.array([3, 0, 5, 5, 40, 1])
    ids = np.arange(sizes.sum()) % len(v)
    each = np.split(ids, np.cumsum(sizes)[:-1])
    assert np.array_equal(encoder.states(ids, sizes), np.concatenate([encoder.hidden(x).T for x in each]))
    slow = []
    for line in each:
        x, around = vectors[line], np.zeros((len(line), 4))
        for to, state in ((range(len(line)), np.zeros(4)), (range(len(line) - 1, -1, -1), np.zeros(4))):
            for i in to:
                around[i] += state
                state = encoder.fade * (state + x[i])
        slow.append(np.tanh(x + encoder.mix * around))
    assert np.allclose(encoder.states(ids, sizes), np.concatenate(slow), rtol=0, atol=1e-14)
    monkeypatch.setattr(encoding, "BLOCK_BYTES", 10 * 32)
    found = list(encoding.blocks(sizes, 32))
    assert [a for a, _ in found] == np.cumsum([0, *(n for _, n in found)])[:-1].tolist() and sum(n for _, n in found) == len(sizes)
    assert all(n == 1 or n * sizes[a : a + n].max() <= 10 for a, n in found)


def test_python_gets_bounded_batches(spark):
    """Stored tables and sums hand Python a few megabytes at a time, not 10,000 rows; the session is as before afterwards."""
    import pyarrow as pa

    from bandlake.operators.probes import summed
    from bandlake.session import BATCH_BYTES, stored

    def largest(stream):
        sizes = [b.nbytes for b in stream]
        return {0: np.array([float(max(sizes) > 2 * BATCH_BYTES), len(sizes)])} if sizes else {}

    def told(stream):
        for b in stream:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    wide = spark.range(0, 3000, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: x.cast("double") + F.col("id")).alias("x"))
    over, batches = summed(wide, largest)[0]
    assert over == 0 and batches > 2
    assert stored(wide.mapInArrow(told, "n long"), "told").agg(F.max("n")).first()[0] <= 2 * BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
