import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from bandlake.llm import mixing
from bandlake.llm.mixing import mix_sources

SCHEMA = "doc_id long, source string, mix_block string, n int"


def edf(weights, sizes, block):
    """The schedule by plain simulation with exact fractions: [(source, turn, phase)]."""
    left, turn, out = dict(sizes), Counter(), []
    phase, began, now = 0, 0, Counter()
    while any(left.values()):
        total = sum(Fraction(weights[s]) for s in left if left[s])
        w = {s: Fraction(weights[s]) / total for s in left if left[s]}
        order = sorted(w, key=lambda s: (-w[s], s))
        t = len(out) - began
        ready = [(math.ceil((now[s] + 1) / w[s]), i) for i, s in enumerate(order) if math.floor(now[s] / w[s]) <= t]
        s = order[min(ready)[1]]
        out.append((s, turn[s], phase))
        turn[s] += 1
        now[s] += 1
        left[s] = max(0, left[s] - block)
        if not left[s]:
            phase, began, now = phase + 1, len(out), Counter()
    return out


def rows(sizes):
    return [(i, s, "x", 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]


def frame(spark, weights):
    return spark.createDataFrame(list(weights.items()), "source string, weight double")


def deviation(slots, weights):
    """The largest distance, over all prefixes, of a source's blocks from its exact part."""
    total = sum(map(Fraction, weights.values()))
    w = {s: Fraction(x) / total for s, x in weights.items()}
    seen, most = Counter(), 0
    for t, s in enumerate(slots):
        seen[s] += 1
        most = max(most, *(abs(seen[n] - x * (t + 1)) for n, x in w.items())) if t % 50 < 10 or t < 3000 else most
    return most


def test_schedule_and_deviation(spark):
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "d": 1.0}
    sizes = {"a": 900, "b": 401, "c": 130, "d": 302}
    found = mix_sources(spark.createDataFrame(rows(sizes), SCHEMA), frame(spark, weights), block=4).collect()
    assert len(found) == sum(sizes.values()) and all(r.in_mix for r in found)
    mixed = sorted({(r.mix_block, r.source) for r in found})
    want = edf(weights, sizes, 4)
    assert [t for t, _ in mixed] == list(range(len(want))) and [s for _, s in mixed] == [s for s, _, _ in want]
    for phase in range(4):
        own = [s for s, _, p in want if p == phase]
        alive = {s for s, _, p in want if p >= phase}
        assert deviation(own, {s: w for s, w in weights.items() if s in alive}) < 1
    assert sorted(r.mix_position for r in found) == list(range(len(found)))
    assert [r.mix_block for r in sorted(found, key=lambda r: r.mix_position)] == sorted(r.mix_block for r in found)
    sizes_of = Counter(r.mix_block for r in found)
    assert sorted(n for n in sizes_of.values() if n != 4) == [1, 2, 2]


def test_a_small_source_does_not_end_the_mix(spark):
    for n in (1, 5, 30):
        sizes = {"a": 10_000, "b": 10_000, "c": n}
        found = mix_sources(spark.createDataFrame(rows(sizes), SCHEMA))
        got = found.groupBy("source").agg(F.count("mix_position").alias("n"), F.countDistinct("mix_position").alias("d"), F.max("mix_block").alias("last")).collect()
        assert {r.source: (r.n, r.d) for r in got} == {s: (k, k) for s, k in sizes.items()}
        slots = [r.source for r in found.select("mix_block", "source").distinct().orderBy("mix_block").collect()]
        w = {s: math.sqrt(k) for s, k in sizes.items()}
        end = slots.index("c") if n < 8 else max(i for i, s in enumerate(slots) if s == "c")
        assert deviation(slots[: end + 1], w) < 1 and deviation(slots[end + 1 :], {"a": 1, "b": 1}) < 1


@pytest.mark.parametrize("weights", [{"a": 0.9997, "b": 0.0003}, {"a": 2**0.5, "b": 3**0.5, "c": 0.0101, "d": math.pi, "e": 1e-3}, {f"s{i}": 1 / (i + 1) for i in range(40)}])
def test_arbitrary_weights_stay_below_one_block(spark, weights):
    slots = 20_000 if len(weights) < 10 else 4_000
    shares = [(f"={s}", round(w * 10 ** mixing.digits(len(weights), slots)), 10**9) for s, w in weights.items()]
    plan = mixing.schedule(spark.createDataFrame(shares, "source string, parts long, size long"), slots, 1).orderBy("slot").collect()
    assert [r.slot for r in plan] == list(range(slots))
    assert deviation([r.source[1:] for r in plan], weights) < 1


def test_rare_source_gets_its_part(spark):
    weights = {"a": 0.9997, "b": 0.0003}
    found = mix_sources(spark.createDataFrame(rows({"a": 60_000, "b": 30}), SCHEMA), frame(spark, weights), block=1)
    b = sorted(r.mix_position for r in found.where("source = 'b'").collect())
    assert found.where("in_mix").count() == 60_030 and all(j / 0.0003 - 1 <= p <= (j + 1) / 0.0003 + 1 for j, p in enumerate(b[:18]))


def test_every_source_and_edges(spark):
    data = rows({"hot": 300, "b": 20, "c": 9}) + [(None, None, None, None), (None, None, None, None), (5, "hot", "x", 1), (5, "hot", "x", 1), (7, "", "x", 1), (8, "", "x", 1)]
    found = mix_sources(spark.createDataFrame(data, SCHEMA), block=2).collect()
    assert len(found) == len(data) and [f for f in found[0].__fields__] == ["doc_id", "source", "n", "mix_block", "mix_position", "in_mix"]
    places = [r.mix_position for r in found if r.in_mix]
    assert sorted(places) == list(range(len(data)))
    # null and '' are two sources: each has a block of its own
    assert len({r.mix_block for r in found if r.source is None}) == len({r.mix_block for r in found if r.source == ""}) == 1 and {r.mix_block for r in found if r.source is None} != {r.mix_block for r in found if r.source == ""}
    some = mix_sources(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([("hot", 1.0), ("b", 0.0), ("zz", 3.0), (None, None), ("c", float("nan"))], "source string, weight double")).collect()
    assert len(some) == len(data) and {r.source for r in some if r.in_mix} == {"hot"} and sum(r.in_mix for r in some) == 302
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_sources_and_growing_blocks(spark, monkeypatch):
    many = mix_sources(spark.range(1_500).selectExpr("id as doc_id", "cast(id as string) as source"), block=1)
    assert many.where("in_mix").count() == 1_500
    monkeypatch.setattr(mixing, "SLOTS", 100)
    found = mix_sources(spark.range(10_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source")).where("in_mix").groupBy("mix_block").count().collect()
    assert len(found) <= 102 and sum(r["count"] for r in found) == 10_000 and sum(r["count"] != 100 for r in found) <= 2
