"""Language-model scores by Katz backoff.

The probability of a token after its context is a Good-Turing discounted relative frequency if the two were seen together in training, else the context's
backoff weight times the probability after the context without its first token, down to single tokens and one unknown token. Weights are normalised
exactly: what the discounts of a context leave is shared among the tokens it wasn't seen with.

n-grams are counted in groups partitioned by context, order by order. A batch of documents sends each of its distinct n-grams once, with its training count and the probability
of its shorter form; a group adds counts, discounts them, weighs its contexts and answers each batch with counts, denominators and weights. Answers of an order are a stored table that the next order
reads. A context with more occurrences than a group should hold is split by its tokens; the parts' sums make its weight, and there are fewer such contexts than groups.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.llm.components import sizes_for, written
from bandlake.llm.packing import _join, _planes, _width, expand, pack, squeeze, unpack
from bandlake.llm.wordbytes import Words, batches, mix64, text_bytes

CUTOFF = 5
END, BEGIN = np.uint64(0x9B1A615C3D0E2F47), np.uint64(0x5D2E8C0F71A3B695)
ROWS = "fragment long, batch string, kind int, blob binary, sums array<long>"
HEADER, LIGHT, HEAVY, TALLY, SUMS = range(5)


def discounts(n: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    """d[r], the share that stays of a count r = 1..cutoff (d[0] is 1, as for all larger counts), from n[r], the number of n-grams seen r times, r up to cutoff + 1.

    Katz's form of the Good-Turing estimate for the largest cutoff for which all of it is between 0 and 1. If there is none (too few n-grams, or copies
    that make counts odd) n1 / (n1 + 2 n2) is taken from each count, a half without n-grams seen once.
    """
    for k in range(cutoff, 1, -1):
        if (n[1 : k + 2] > 0).all():
            common = (k + 1) * n[k + 1] / n[1]
            r = np.arange(1, k + 1)
            d = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - common) / (1 - common) if common < 1 else np.zeros(k)
            if ((d > 0) & (d < 1)).all():
                return np.concatenate([[1.0], d])
    off = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    r = np.arange(1, cutoff + 1)
    return np.concatenate([[1.0], (r - min(off, 0.999)) / r])


def kept(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return count * d[np.where(count < len(d), count, 0)]


def weigh(total: np.ndarray, discounted: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, backoff weight) of contexts: of their count, the sum of their discounted counts and of the shorter forms' probabilities of what they were seen with.
    If discounts leave nothing, the denominator is one more than the count. A context that wasn't seen has weight 1."""
    whole = np.where(total - discounted > 1e-9, total, total + 1.0)
    rest = np.where(total > 0, 1 - discounted / np.maximum(whole, 1), 1.0)
    return whole, rest / np.maximum(1 - seen, 1e-15)


def single(count: np.ndarray, tally: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Probabilities of single tokens; those never seen are one unknown token together."""
    total = float(tally[0])
    whole, rest = weigh(np.array([total]), np.array([float(tally[2])]), np.zeros(1))
    if total == 0:
        return np.ones(len(count))
    return np.where(count > 0, kept(count, d) / whole[0], rest[0])


def _coded(x: np.ndarray) -> bytes:
    """Numbers as their distinct values and places among them."""
    values, at = np.unique(x, return_inverse=True)
    at = at.astype(np.uint64)
    return squeeze(struct.pack("<QQB", len(x), len(values), w := _width(at)) + values.tobytes() + _planes(at, w))


def _decoded(blob: bytes, kind: type) -> np.ndarray:
    raw = expand(blob)
    n, m, w = struct.unpack_from("<QQB", raw)
    values = np.frombuffer(raw, kind, m, 17)
    return values[_join(np.frombuffer(raw, np.uint8, offset=17 + 8 * m), n, w).astype(np.int64)]


def _framed(*parts: bytes) -> bytes:
    return struct.pack(f"<B{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def _unframed(blob: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<B", blob)
    sizes = struct.unpack_from(f"<{n}Q", blob, 1)
    ends = (1 + 8 * n + np.concatenate([[0], np.cumsum(sizes)])).tolist()
    return [blob[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _row(fragment: list, batch: list, kind: list, blob: list, sums: list | None = None) -> pa.RecordBatch:
    n = len(fragment)
    return pa.RecordBatch.from_arrays([pa.array(fragment, pa.int64()), pa.array(batch, pa.string()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary()), pa.array(sums or [None] * n, pa.list_(pa.int64()))], ["fragment", "batch", "kind", "blob", "sums"])


class Tokens:
    """The tokens of a batch: words, then one end a text."""

    def __init__(self, t: pa.Table):
        words = Words(*text_bytes(t["text"]))
        sizes = np.diff(words.first) + 1
        self.last = np.cumsum(sizes) - 1
        self.doc = np.repeat(np.arange(t.num_rows), sizes)
        self.token = np.full(int(sizes.sum()), END, np.uint64)
        self.token[np.arange(len(words.doc)) + words.doc] = words.hashes(lower=True)
        self.sizes = sizes
        self.train = np.asarray(t["train"].combine_chunks() if t["train"].num_chunks else pa.array([], pa.bool_())).astype(bool)[self.doc]
        self.place = np.arange(len(self.token)) - (self.last - sizes + 1)[self.doc]

    def before(self, order: int) -> np.ndarray:
        """A hash of the `order` - 1 tokens before each token; texts are preceded by begins."""
        if order == 1:
            return np.zeros(len(self.token), np.uint64)
        h = np.full(len(self.token), np.uint64(order))
        for back in range(1, order):
            at = np.arange(len(self.token)) - back
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.where(self.place >= back, self.token[np.maximum(at, 0)], BEGIN))
        return h

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, token, training count) of the distinct n-grams ordered by both, and the n-gram of each token. Of a token 48 bits tell it from others of a context."""
        context, token = self.before(order), self.token & np.uint64((1 << 48) - 1) if order > 1 else self.token
        by = np.lexsort((token, context)) if order > 1 else np.argsort(token, kind="stable")
        c, w = context[by], token[by]
        new = np.ones(len(by), bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(new) - 1
        return c[new], w[new], np.bincount(number, weights=self.train, minlength=int(new.sum())).astype(np.int64), number

    def first(self, number: np.ndarray, m: int) -> np.ndarray:
        """A token of each of the m n-grams."""
        at = np.zeros(m, np.int64)
        at[number] = np.arange(len(number))
        return at


def _dealt(key: np.ndarray, groups: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _parts(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places) of ascending places."""
    by = np.argsort(group, kind="stable")
    for p in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
        if len(p):
            yield int(group[p[0]]), p


class Model:
    """What all tasks know of the orders so far: tallies, discounts and the split contexts' weights."""

    def __init__(self, groups: int, limit: int):
        self.groups, self.limit, self.train_docs = groups, limit, 0
        self.tally: dict[int, np.ndarray] = {}  # tokens, distinct n-grams, discounted tokens
        self.discount: dict[int, np.ndarray] = {}
        self.split: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # contexts in order, denominators, weights

    def take_tally(self, order: int, sums: list[int]) -> None:
        """sums: tokens, distinct n-grams, then the numbers of n-grams seen once to CUTOFF + 1 times."""
        n = np.concatenate([[0], np.array(sums[2:], np.float64)])
        d = self.discount[order] = discounts(n)
        r = np.arange(1, len(d))
        self.tally[order] = np.array([sums[0], sums[1], sums[0] - float((r * n[1 : len(d)] * (1 - d[1:])).sum())])

    def routes(self, context: np.ndarray, token: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, whether the context is split) of n-grams whose contexts were seen so often."""
        heavy = seen > self.limit
        part = token % (seen.astype(np.uint64) // np.uint64(self.limit) + np.uint64(1))
        return _dealt(np.where(heavy, mix64(context + part * np.uint64(0xD6E8FEB86659FD93)), context), self.groups), heavy


def _answers(model: Model, tokens: Tokens, rows: list[tuple[int, int, int, bytes]], upto: int) -> tuple[np.ndarray, list, np.ndarray]:
    """(probability, training count) of the batch's tokens at the order `upto`, from the answers of all orders: rows are (order, fragment, kind, blob). Also the counts
    of single tokens."""
    probability, context_seen, first_counts = None, None, None
    for order in range(1, upto + 1):
        context, token, own, number = tokens.distinct(order)
        m = len(context)
        whole, weight, count = np.ones(m), np.ones(m), np.zeros(m, np.int64)
        told = {(f, kind): blob for o, f, kind, blob in rows if o == order}
        if order == 1:
            group, heavy = _dealt(token, model.groups), np.zeros(m, bool)
        else:
            at = tokens.first(number, m)
            seen = context_seen[at]
            group, heavy = model.routes(context, token, seen)
        for kind in (LIGHT, HEAVY):
            some = np.flatnonzero(heavy == (kind == HEAVY))
            for g, p in _parts(group[some]):
                p = some[p]
                c, w, a = _unframed(told[g, kind])
                count[p] = _decoded(c, np.int64)
                if order > 1 and kind == LIGHT:
                    own = np.cumsum(np.concatenate([[True], context[p][1:] != context[p][:-1]])) - 1
                    whole[p], weight[p] = _decoded(w, np.int64)[own], _decoded(a, np.float64)[own]
        if order == 1:
            value = single(count, model.tally[1], model.discount[1])
            first_counts = count[number]
        else:
            if heavy.any():  # their groups knew parts of the contexts only
                known, wholes, weights = model.split[order]
                k = np.searchsorted(known, context[heavy])
                whole[heavy], weight[heavy] = wholes[k], weights[k]
            value = np.where(count > 0, kept(count, model.discount[order]) / whole, weight * probability[at])
        probability, seen_now = value[number], count[number]
        # the context of the next order is the n-gram that ends one token before
        context_seen = np.where(tokens.place > 0, np.concatenate([[0], seen_now[:-1]]), model.train_docs)
    return probability, context_seen, first_counts


def _tally(count: np.ndarray) -> list[int]:
    some = count[count > 0]
    return [int(some.sum()), len(some), *np.bincount(some[some <= CUTOFF + 1], minlength=CUTOFF + 2)[1:].tolist()]


def _sum_by(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the values of the same key for each place, order of the keys)."""
    by = np.argsort(key, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = key[by][1:] != key[by][:-1]
    total = np.add.reduceat(value[by], np.flatnonzero(new)) if len(by) else value
    back = np.empty(len(by), np.int64)
    back[by] = np.cumsum(new) - 1
    return total, back


def _count_singles(t: pa.Table, fragment: int) -> pa.RecordBatch:
    """Totals of single tokens, told to each batch, and their tally."""
    parts = [unpack(x.as_py()) for x in t["blob"]]
    total, back = _sum_by(np.concatenate([k for k, _ in parts]), np.concatenate([v.astype(np.int64) for _, v in parts]))
    each = np.split(total[back], np.cumsum([len(k) for k, _ in parts])[:-1])
    names = t["batch"].to_pylist()
    return _row([fragment] * (len(names) + 1), [*names, None], [LIGHT] * len(names) + [SUMS], [*(_framed(_coded(x), b"", b"") for x in each), None], [None] * len(names) + [[1, *_tally(total)]])


def _tally_only(t: pa.Table, order: int) -> pa.RecordBatch:
    parts = [unpack(x.as_py()) for x in t["blob"]]
    total, _ = _sum_by(np.concatenate([k for k, _ in parts]), np.concatenate([v.astype(np.int64) for _, v in parts]))
    return _row([-1], [None], [SUMS], [None], [[order, *_tally(total)]])


def _requested(context: np.ndarray, token: np.ndarray, count: np.ndarray, lower: np.ndarray) -> bytes:
    new = np.ones(len(context), bool)
    new[1:] = context[1:] != context[:-1]
    runs = np.diff(np.append(np.flatnonzero(new), len(new))).astype(np.uint64)
    return _framed(pack(context[new], runs), squeeze(_planes(token, 6)), _coded(count), _coded(lower))


def _answer_group(t: pa.Table, fragment: int, order: int, discount: np.ndarray) -> pa.RecordBatch:
    """Counts of a group's n-grams, and their contexts' denominators and weights, told to each batch."""
    sent = []
    for blob in t["blob"]:
        a, b, c, d = _unframed(blob.as_py())
        keys, runs = unpack(a)
        context = np.repeat(keys, runs.astype(np.int64))
        sent.append((context, _join(np.frombuffer(expand(b), np.uint8), len(context), 6), _decoded(c, np.int64), _decoded(d, np.float64)))
    context, token, count, lower = (np.concatenate(x) for x in zip(*sent, strict=True))
    kinds = t["kind"].to_pylist()
    heavy = np.repeat(np.array(kinds) == HEAVY, [len(x[0]) for x in sent])
    by = np.lexsort((token, context))
    new = np.ones(len(by), bool)
    new[1:] = (context[by][1:] != context[by][:-1]) | (token[by][1:] != token[by][:-1])
    starts = np.flatnonzero(new)
    back = np.empty(len(by), np.int64)
    back[by] = np.cumsum(new) - 1
    count, context, lower, heavy = np.add.reduceat(count[by], starts), context[by][starts], lower[by][starts], heavy[by][starts]
    opens = np.ones(len(context), bool)
    opens[1:] = context[1:] != context[:-1]
    group, at = np.cumsum(opens) - 1, np.flatnonzero(opens)
    less = kept(count, discount)
    sums = [np.add.reduceat(x, at) for x in (count.astype(np.float64), less, np.where(count > 0, lower, 0.0))]
    whole, weight = weigh(*sums)
    blobs, at_ = [], 0
    for kind, (own, *_) in zip(kinds, sent, strict=True):
        k = back[at_ : at_ + len(own)]
        at_ += len(own)
        if kind == HEAVY:
            blobs.append(_framed(_coded(count[k]), b"", b""))
            continue
        # a denominator and, where an n-gram of the batch wasn't seen, a weight for each context
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        g = group[k[first]]
        lacks = np.add.reduceat(count[k] == 0, first) > 0
        blobs.append(_framed(_coded(count[k]), _coded(whole[g].astype(np.int64)), _coded(np.where(lacks, weight[g], 0.0))))
    names, frag = t["batch"].to_pylist(), [fragment] * len(kinds)
    split = np.flatnonzero(heavy[at])
    if len(split):
        # parts of split contexts
        names, frag, kinds = [*names, None], [*frag, fragment], [*kinds, HEAVY]
        blobs.append(_framed(context[at][split].tobytes(), *(s[split].tobytes() for s in sums)))
    return _row(frag, names, kinds, blobs)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, order: int = 2, limit: int | None = None, groups: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (log10 probability by single tokens, one added to each count) and score
    (log10 probability by Katz backoff of n-grams of `order` tokens) of every row.

    held_out is a Column; texts of rows where it is true aren't learnt from (default: none, a null counts as false). Tokens are runs without ASCII white space, A-Z lower-cased, and an end after
    each text, so a null, empty or blank text has one token. Contexts do not cross texts. Repeated rows count as texts each and get equal scores. Without training tokens every
    token is unknown, with probability 1. Other columns are not read. An n-gram is told from others by 64 bits of its context and 48 of its token.
    The input must give the same rows in the same order when a lost partition is computed again, as files do. `limit` is the count from which a context is split (default: the tokens of a group), `groups`
    the number of groups.
    """
    if order < 1:
        raise ValueError("order is at least 1")
    out = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~out).alias("train"))
    n_groups, group_bytes, size = sizes_for(docs)
    model = Model(groups or n_groups, limit or group_bytes // 6)

    def named(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
        part = TaskContext.get().partitionId()
        for seq, t in enumerate(batches(stream, "text", size)):
            yield f"{part}-{seq}", t

    def headers(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, t in named(stream):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            yield _row([0], [name], [HEADER], [sink.getvalue().to_pybytes()])

    def tally_rows(name: str, tokens: Tokens, order_: int) -> pa.RecordBatch:
        """Training n-grams of an order, to be counted by how often they were seen."""
        context, token, count, _ = tokens.distinct(order_)
        key = mix64(context + mix64(token))
        some = np.flatnonzero(count > 0)
        some = some[np.argsort(key[some], kind="stable")]
        parts = [(g, pack(key[some[p]], count[some[p]].astype(np.uint64))) for g, p in _parts(_dealt(key[some], model.groups))]
        return _row([model.groups + g for g, _ in parts], [name] * len(parts), [TALLY] * len(parts), [b for _, b in parts])

    def singles(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, t in named(stream):
            tokens = Tokens(t)
            _, token, count, _ = tokens.distinct(1)
            parts = [(g, pack(token[p], count[p].astype(np.uint64))) for g, p in _parts(_dealt(token, model.groups))]
            yield _row([g for g, _ in parts], [name] * len(parts), [LIGHT] * len(parts), [b for _, b in parts])
            if order > 1:
                yield tally_rows(name, tokens, 2)

    def count(t: pa.Table) -> pa.Table:
        fragment = t["fragment"][0].as_py()
        return pa.Table.from_batches([_tally_only(t, 2) if t["kind"][0].as_py() == TALLY else _count_singles(t, fragment)])

    def gathered(t: pa.Table) -> tuple[str, pa.Table, Tokens, list[tuple[int, int, int, bytes]]]:
        header, rows = None, []
        for o, f, kind, blob in zip(t["order"].to_pylist(), t["fragment"].to_pylist(), t["kind"].to_pylist(), t["blob"], strict=True):
            if kind == HEADER:
                header = pa.ipc.open_stream(blob.as_py()).read_all()
            else:
                rows.append((o, f, kind, blob.as_py()))
        return t["batch"][0].as_py(), header, Tokens(header), rows

    def with_headers(answers: list[DataFrame]) -> DataFrame:
        every = docs.mapInArrow(headers, ROWS).withColumn("order", F.lit(0))
        for k, a in enumerate(answers, 1):
            every = every.unionByName(a.where("batch is not null").withColumn("order", F.lit(k)))
        return every.drop("sums")

    def take_sums(table: DataFrame) -> None:
        """Tallies of a stored table, added by order."""
        found: dict[int, dict[int, int]] = {}
        for r in table.where(f"kind = {SUMS}").select(F.col("sums")[0].alias("order"), F.posexplode(F.slice("sums", 2, 99)).alias("i", "v")).groupBy("order", "i").agg(F.sum("v").alias("v")).collect():
            found.setdefault(r["order"], {})[r["i"]] = r["v"]
        for k, v in found.items():
            model.take_tally(k, [v[i] for i in range(len(v))])

    none = [0] * (CUTOFF + 3)
    model.train_docs = docs.where("train").count()
    for k in range(1, order + 1):
        model.take_tally(k, none)
    answers = [written(docs.mapInArrow(singles, ROWS).groupBy("fragment").applyInArrow(count, ROWS), "katz-1")]
    take_sums(answers[0])

    for k in range(2, order + 1):

        def ask(t: pa.Table) -> pa.Table:
            name, _, tokens, rows = gathered(t)
            lower, seen, _ = _answers(model, tokens, rows, k - 1)
            context, token, own, number = tokens.distinct(k)
            at = tokens.first(number, len(context))
            group, heavy = model.routes(context, token, seen[at])
            out = []
            for kind in (LIGHT, HEAVY):
                some = np.flatnonzero(heavy == (kind == HEAVY))
                parts = [(g, some[p]) for g, p in _parts(group[some])]
                out.append(_row([g for g, _ in parts], [name] * len(parts), [kind] * len(parts), [_requested(context[p], token[p], own[p], lower[at[p]]) for _, p in parts]))
            if k < order:
                out.append(tally_rows(name, tokens, k + 1))
            return pa.Table.from_batches(out)

        def answer(t: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_tally_only(t, k + 1) if t["kind"][0].as_py() == TALLY else _answer_group(t, t["fragment"][0].as_py(), k, model.discount[k])])

        asked = with_headers(answers).groupBy("batch").applyInArrow(ask, ROWS)
        answers.append(written(asked.groupBy("fragment").applyInArrow(answer, ROWS), f"katz-{k}"))
        take_sums(answers[-1])
        parts = [_unframed(bytes(r["blob"])) for r in answers[-1].where(f"batch is null and kind = {HEAVY}").select("blob").collect()]  # of fewer contexts than groups
        context, *sums = (np.concatenate([np.frombuffer(p[i], np.uint64 if i == 0 else np.float64) for p in parts]) if parts else np.zeros(0) for i in range(4))
        keys, back = np.unique(context, return_inverse=True)
        model.split[k] = (keys, *weigh(*(np.bincount(back, weights=s, minlength=len(keys)) for s in sums)))

    def score(t: pa.Table) -> pa.Table:
        _, header, tokens, rows = gathered(t)
        probability, _, count = _answers(model, tokens, rows, order)
        total, distinct = int(model.tally[1][0]), int(model.tally[1][1])
        base = np.log10((count + 1) / (total + distinct + 1))
        add = lambda x: np.bincount(tokens.doc, weights=x, minlength=header.num_rows)
        return pa.table({
            "doc_id": header["doc_id"], "held_out": pa.compute.invert(header["train"]), "n_tokens": tokens.sizes.astype(np.int64), "n_known": add(count > 0).astype(np.int64),
            "train_tokens": np.full(header.num_rows, total), "base_score": add(base), "score": add(np.log10(probability)),
        })

    return with_headers(answers).groupBy("batch").applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
