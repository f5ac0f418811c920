import random

from bandlake.llm import components


def test_components_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK_EDGES", 40)
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 120)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(90)] + [(7, 7), (5, -3), (5, -3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(frame.where("a < -9")).count() == 0


def test_written_tables_are_deleted(spark):
    components.delete_written(spark)
    a, b = components.written(spark.range(3), "a"), components.written(spark.range(2), "b")
    assert a.count() + b.count() == 5 and components.delete_written(spark) == 2 and components.delete_written(spark) == 0
