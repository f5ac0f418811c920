import numpy as np
import pytest

from bandlake.llm.catalog import QUERIES
from bandlake.llm.vector_dedup import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, component_id string"


def brute(rows, threshold=0.98):
    ok = [i for i, (_, x, label, *_) in enumerate(rows) if label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    links = {i: [] for i in range(len(rows))}
    for label in {rows[i][2] for i in ok}:
        own = [i for i in ok if rows[i][2] == label]
        x = np.array([np.array(rows[i][1], np.float32) for i in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                links[own[a]].append(own[b])
    low = {}
    for i in range(len(rows)):
        if i not in low:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            low |= dict.fromkeys(group, min(rows[j][0] for j in group))
    return {r[0]: (len(links[i]), low[i]) for i, r in enumerate(rows)}


def compare(got, want, least):
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= least * sum(w[0] for w in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) >= least


@pytest.mark.parametrize("shard_nodes", [4096, 150])
def test_recall_against_brute_force(spark, shard_nodes):
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal((120, 32))
    x = base[rnd.integers(0, 120, 900)] + 0.11 * rnd.standard_normal((900, 32)) * rnd.random((900, 1))
    big = rnd.standard_normal(32) + 0.02 * rnd.standard_normal((300, 32))
    same = np.repeat(rnd.standard_normal((1, 32)), 200, axis=0)
    rows = [(i, [float(np.float32(v)) for v in r], int(i % 3), "x", "y") for i, r in enumerate([*x, *big, *same])]
    rows += [(5000, None, 1, "x", "y"), (5001, [], 1, "x", "y"), (5002, [0.0] * 32, 1, "x", "y"), (5003, [float("nan")] * 32, 1, "x", "y"), (5004, rows[0][1], None, "x", "y"), (5005, [None] + rows[0][1][1:], 0, "x", "y"), (5006, [float("inf")] * 32, 1, None, None)]
    found = vector_dedup(spark.createDataFrame(rows, SCHEMA), shard_nodes=shard_nodes).collect()
    assert len(found) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in found)
    compare({r.vec_id: (r.n_links, r.component_id) for r in found}, brute(rows), 0.98)


def test_repeated_rows_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    found = vector_dedup(spark.createDataFrame([(1, v, 1, "", ""), (1, v, 1, "", ""), (None, v, 1, "", ""), (2, v, 2, "", "")], SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in found) == [("1", 2, 1), ("1", 2, 1), ("2", 0, 2), ("None", 2, 1)]
    assert vector_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    compare({r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op5_embedding_near_dedup"](spark, sf).collect()}, brute(rows), 0.97)
