"""Embedding near-dedup on hierarchical navigable small-world graphs, one per shard.

Only vectors of one label are compared. Equal vectors are one node. The nodes of a label are dealt by a hash to
shards of a bounded size, and each shard's graph is built once and written. A task then takes two shards of a label, and the nodes of
each query the graph of the other in blocks, so every shard is queried by every node and no task holds more than two shards. A link counts for both
ends, whichever found it. A query whose beam ends among linked nodes is asked again with a wider beam, and one that still does is finished by exact
products; all beams widen while an audit against exact cosines finds less than `recall` of the links. Cosines are verified in double
precision, and the links of a task are reduced to stars before they are united into components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.llm.components import connected_components, written
from bandlake.llm.wordbytes import mix64

SHARD_NODES, SHARD_BYTES = 4096, 32 << 20
DEGREE, BUILD_BEAM, BEAM, WIDEST = 16, 32, 32, 128
AUDIT = 64
BROADCAST_LABELS = 100_000


class Graph:
    """A navigable small-world graph over unit vectors; nodes enter in batches, each batch linked by searches of the graph so far.

    `order` numbers the nodes, those of the highest layer first, so that every layer is a prefix of the nodes; `layers` are their neighbours (-1: none).
    """

    def __init__(self, x: np.ndarray, order: np.ndarray | None = None, layers: list[np.ndarray] | None = None, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 1):
        n = len(x)
        if layers is not None:
            self.order, self.x, self.layers = order, x[order].astype(np.float32), layers
            return
        level = (-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(degree)).astype(np.int64)
        self.order = np.argsort(-level, kind="stable")
        self.x = x[self.order].astype(np.float32)
        self.layers = []
        for k in range(int(level.max()) if n else -1, -1, -1):
            self.layers.insert(0, self._layer(int((level >= k).sum()), degree * (2 if k == 0 else 1), beam))

    def _layer(self, m: int, degree: int, beam: int) -> np.ndarray:
        """Neighbours of the first m nodes; the layers above are there already and show where searches start."""
        near = np.full((m, degree), -1, np.int32)
        done = min(m, 1)
        while done < m:
            new = np.arange(done, min(m, done * 2, done + 1024), dtype=np.int32)
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -2)
            within = new[np.argsort(-own, axis=1)[:, :degree]]
            if done <= 4 * beam:
                found = np.argsort(-(self.x[new] @ self.x[:done].T), axis=1)[:, :beam].astype(np.int32)
            else:
                start = self._descend(self.x[new])
                found, _ = self._search(near[:done], self.x[new], beam, np.where(start < done, start, 0))
            chosen = self._diverse(new, np.concatenate([found, within], axis=1), degree // 2)
            near[new, : chosen.shape[1]] = chosen
            self._back(near, new, chosen)
            done = int(new[-1]) + 1
        return near

    def _back(self, near: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        """Adds each new node to the neighbours it chose; where these are too many, the diverse ones stay."""
        degree = near.shape[1]
        i, c = np.nonzero(chosen >= 0)
        to, source = chosen[i, c], new[i]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        first = np.searchsorted(to, to)
        place = np.arange(len(to)) - first
        for at in range(0, int(place.max()) + 1 if len(place) else 0, degree):
            now = (place >= at) & (place < at + degree)
            node, row = np.unique(to[now], return_inverse=True)
            extra = np.full((len(node), degree), -1, np.int32)
            extra[row, place[now] - at] = source[now]
            near[node] = self._diverse(node, np.concatenate([near[node], extra], axis=1), degree)

    def _diverse(self, ids: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates the nearest, without those nearer to one chosen before than to the node; filled up with the nearest."""
        found = np.sort(found, axis=1)
        bad = (found < 0) | (found == ids[:, None])
        bad[:, 1:] |= found[:, 1:] == found[:, :-1]
        out = np.full((len(ids), most), -1, np.int32)
        for at in range(0, len(ids), 256):
            part, v = slice(at, at + 256), self.x[ids[at : at + 256]]
            cosine = np.where(bad[part], np.float32(-3), np.einsum("bcd,bd->bc", self.x[np.maximum(found[part], 0)], v))
            top = np.argsort(-cosine, axis=1, kind="stable")[:, : 2 * most]
            near, cosine = np.take_along_axis(found[part], top, axis=1), np.take_along_axis(cosine, top, axis=1)
            w = self.x[np.maximum(near, 0)]
            between = w @ w.transpose(0, 2, 1)
            highest, kept, count = np.full(cosine.shape, -4, np.float32), np.zeros(cosine.shape, bool), np.zeros(len(near), np.int64)
            for a in range(near.shape[1]):
                take = (count < most) & (highest[:, a] <= cosine[:, a]) & (cosine[:, a] > -3)
                kept[:, a], count = take, count + take
                highest = np.where(take[:, None], np.maximum(highest, between[:, a]), highest)
            rank = np.argsort(np.where(cosine > -3, ~kept * near.shape[1], 4 * near.shape[1]) + np.arange(near.shape[1]), axis=1)[:, :most]
            out[part, : rank.shape[1]] = np.where(np.take_along_axis(cosine, rank, axis=1) > -3, np.take_along_axis(near, rank, axis=1), -1)
        return out

    def _search(self, near: np.ndarray, q: np.ndarray, beam: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of each query's beam in one layer, best first; -1 where there are fewer."""
        m = len(q)
        nodes = np.full((m, beam), -1, np.int32)
        cosine = np.full((m, beam), -2, np.float32)
        open_ = np.zeros((m, beam), bool)
        seen = np.zeros((m, len(near)), bool)
        rows = np.arange(m)
        nodes[:, 0], cosine[:, 0], open_[:, 0] = start, np.einsum("ij,ij->i", q, self.x[start]), True
        seen[rows, start] = True
        active = rows
        while len(active):
            best = np.argmax(open_[active], axis=1)  # beams are sorted: the first open node is the best
            ok = open_[active, best]
            active, best = active[ok], best[ok]
            if not len(active):
                break
            open_[active, best] = False
            next_ = near[nodes[active, best]]
            fresh = (next_ >= 0) & ~seen[active[:, None], np.maximum(next_, 0)]
            r, c = np.nonzero(fresh)
            seen[active[r], next_[r, c]] = True
            value = np.full(next_.shape, -2, np.float32)
            value[r, c] = np.einsum("ij,ij->i", q[active[r]], self.x[next_[r, c]])
            all_c = np.concatenate([cosine[active], value], axis=1)
            all_n = np.concatenate([nodes[active], np.where(fresh, next_, -1)], axis=1)
            all_o = np.concatenate([open_[active], fresh], axis=1)
            top = np.argsort(-all_c, axis=1, kind="stable")[:, :beam]
            cosine[active] = np.take_along_axis(all_c, top, axis=1)
            nodes[active] = np.take_along_axis(all_n, top, axis=1)
            open_[active] = np.take_along_axis(all_o, top, axis=1)
        return nodes, cosine

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """Where each query enters the lowest layer that is being built or searched."""
        start = np.zeros(len(q), np.int32)
        for near in reversed(self.layers):
            start = self._search(near, q, 4, start)[0][:, 0]
        return start

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes as numbered by the caller, cosines) of each query's beam."""
        start = np.zeros(len(q), np.int32)
        for near in reversed(self.layers[1:]):
            start = self._search(near, q, 4, start)[0][:, 0]
        nodes, cosine = self._search(self.layers[0], q, min(beam, len(self.x)), start)
        return np.where(nodes >= 0, self.order[np.maximum(nodes, 0)], -1), cosine


def mark_links(graph: Graph, data: np.ndarray, q: np.ndarray, threshold: float, recall: float, hits: np.ndarray, same: bool) -> tuple[int, int]:
    """Sets hits[query, node] for cosines >= threshold; (links of the audited queries, those of them that were found).

    Audited are AUDIT queries drawn at random and as many of those that found links, without links to themselves."""
    loose = np.float32(threshold - 1e-4)
    rnd = np.random.default_rng(3)
    beam = BEAM
    while True:
        for at in range(0, len(q), 512):
            todo, wide = np.arange(at, min(len(q), at + 512)), beam
            while len(todo):
                nodes, cosine = graph.query(q[todo].astype(np.float32), wide)
                full = (cosine[:, -1] >= loose) & (nodes.shape[1] < len(data))  # ends among linked nodes
                r, c = np.nonzero((cosine >= loose) & (nodes >= 0) & ~full[:, None])
                a, b = todo[r], nodes[r, c]
                ok = np.einsum("ij,ij->i", q[a], data[b]) >= threshold
                hits[a[ok], b[ok]] = True
                todo = todo[full]
                if wide >= WIDEST and len(todo):
                    hits[todo] |= q[todo] @ data.T >= threshold
                    break
                wide = max(WIDEST, wide)
        linked = np.flatnonzero(hits.any(axis=1))
        sample = np.unique(np.concatenate([rnd.permutation(len(q))[:AUDIT], rnd.permutation(linked)[:AUDIT]]))
        exact = q[sample] @ data.T >= threshold
        if same:
            exact[np.arange(len(sample)), sample] = False
        total, found = int(exact.sum()), int((exact & hits[sample]).sum())
        if found >= recall * total or beam >= len(data):
            return total, found
        beam *= 2


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n nodes reaches by the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root, low.copy())
        low = low[low]
        if (low == root).all():
            return root
        root = low


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, recall: float = 0.99, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall, one row per input row.

    n_links counts the other rows of the label with cosine >= threshold that were found; component_id is the smallest id
    reachable by links, kept says that it is the row's own. audit_recall is the share of the audited queries' links that were found, over all shards, null if they
    have none. A null label, and a vector that is null, empty, zero or holds a null or
    a non-finite component, links with nothing, as do vectors of different lengths. Rows of one vector are linked with each other.
    Rows with null ids take part; a component's id is the smallest that isn't null. Other columns are not read.
    A shard has at most shard_nodes nodes and SHARD_BYTES of vectors.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).cast("string").alias("label"))
    whole = "label is not null and size(x) > 0 and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(x, v -> v <> 0)"
    rows = rows.withColumn("node", F.when(F.coalesce(F.expr(whole), F.lit(False)), F.xxhash64("label", F.transform("x", lambda v: v + F.lit(0.0)))))
    rows = written(rows, "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("label").alias("label"), F.first("x").alias("x"), F.min("vec_id").alias("low"))
    nodes = written(nodes.withColumn("width", F.size("x")), "nodes")
    # the shards of a label: as many as its nodes need (labels that need several are nodes / shard_nodes at most)
    most = F.greatest(F.lit(1), F.least(F.lit(shard_nodes), F.floor(F.lit(SHARD_BYTES / 8) / F.col("width"))))
    counts = written(nodes.groupBy("label", "width").agg(F.count("*").alias("n")).select("label", "width", F.ceil(F.col("n") / most).cast("long").alias("shards")).where("shards > 1"), "labels")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LABELS else counts
    sharded = nodes.join(counts, ["label", "width"], "left").withColumn("shards", F.coalesce("shards", F.lit(1).cast("long"))).withColumn("home", F.pmod(F.xxhash64("node", F.lit(5)), F.col("shards")))

    def build(t: pa.Table) -> pa.Table:
        width = t["width"][0].as_py()
        node = np.asarray(t["node"])
        by = np.argsort(mix64(node.view(np.uint64)))
        x = np.asarray(t["x"].combine_chunks().flatten()).reshape(-1, width)[by]
        scaled = x / np.abs(x).max(axis=1, keepdims=True)
        q = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        graph = Graph(q)
        sizes = [v for near in graph.layers for v in near.shape]
        blobs = {"q": q, "node": node[by], "copies": np.asarray(t["copies"]).astype(np.int64)[by], "order": graph.order.astype(np.int64), "near": np.concatenate([v.ravel() for v in graph.layers])}
        return pa.table({"label": t["label"][:1], "width": t["width"][:1], "shards": t["shards"][:1], "home": t["home"][:1], "sizes": pa.array([sizes], pa.list_(pa.int32())), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()}})

    shape = "label string, width int, shards long, home long, sizes array<int>, q binary, node binary, copies binary, order binary, near binary"
    shards = written(sharded.groupBy("label", "width", "home").applyInArrow(build, shape), "vector-shards")
    # every two shards of a label meet once; a shard also meets itself
    met = shards.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).withColumn("one", F.least("home", "other")).withColumn("two", F.greatest("home", "other"))

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("home")
        sides = []
        for i in range(t.num_rows):
            of = {k: np.frombuffer(t[k][i].as_py(), kind) for k, kind in (("q", np.float64), ("node", np.int64), ("copies", np.int64), ("order", np.int64), ("near", np.int32))}
            shapes = np.asarray(t["sizes"][i].as_py()).reshape(-1, 2)
            cuts = np.cumsum(shapes[:, 0] * shapes[:, 1])[:-1]
            q = of["q"].reshape(-1, t["width"][i].as_py())
            sides.append((q, Graph(q, of["order"], [v.reshape(-1, d) for v, (_, d) in zip(np.split(of["near"], cuts), shapes, strict=True)]), of["node"], of["copies"]))
        (x, graph, node, copies), (y, other, node_y, copies_y) = sides[0], sides[-1]
        same = len(sides) == 1
        hits = np.zeros((len(x), len(y)), bool)
        audited = np.array(mark_links(other, y, x, threshold, recall, hits, same))
        if same:
            hits |= hits.T
            np.fill_diagonal(hits, False)
        else:
            back = np.zeros((len(y), len(x)), bool)
            audited += mark_links(graph, x, y, threshold, recall, back, same)
            hits |= back.T
        a, b = np.nonzero(hits)
        links = [np.bincount(a, copies_y[b], len(x))] if same else [np.bincount(a, copies_y[b], len(x)), np.bincount(b, copies[a], len(y))]
        names = node if same else np.concatenate([node, node_y])
        root = stars(a, b if same else b + len(x), len(names))
        links = np.concatenate(links).astype(np.int64)
        some, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(names)))
        none = np.zeros(len(tied), np.int64)
        return pa.table({
            "a": np.concatenate([names[some], names[tied], [0]]), "b": np.concatenate([names[some], names[root[tied]], [0]]), "n": np.concatenate([links[some], none, [0]]),
            "audited": np.concatenate([some * 0, none, audited[:1]]), "found": np.concatenate([some * 0, none, audited[1:]]),
        })

    found = written(met.groupBy("label", "width", "one", "two").applyInArrow(search, "a long, b long, n long, audited long, found long"), "vector-links")
    components = connected_components(found.where("a <> b").select("a", "b"))
    links = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = nodes.select("node", "copies", "low").join(links, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(named.join(lows, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies"), "vector-classes")
    # nodes with over a thousandth of the rows, a thousand at most, are broadcast; the others' rows are few each
    often = rows.count() // 1000
    ids = rows.select("vec_id", "node")
    marked = ids.join(F.broadcast(named.where(F.col("copies") > often).select("node", F.col("n_links").alias("top_links"), F.col("component_id").alias("top"), F.lit(True).alias("common"))), "node", "left")
    rest = marked.where("common is null").join(named.where(F.col("copies") <= often).drop("copies"), "node", "left")
    out = marked.where("common").select("vec_id", F.col("top_links").alias("n_links"), F.col("top").alias("component_id")).unionByName(rest.select("vec_id", "n_links", "component_id"))
    audit = found.agg((F.sum("found") / F.nullif(F.sum("audited"), F.lit(0))).alias("audit_recall"))
    done = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return done.crossJoin(F.broadcast(audit))
