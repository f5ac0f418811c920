"""Mixing sources to target weights by Pfair scheduling.

A source with weight w (of all weights' sum) gets its j-th block of documents released at floor(j / w) and due at ceil((j + 1) / w), j
from 0. In every slot the released block with the earliest deadline goes first, so that after any number of slots a
source has had its weight's part of them, to less than one block. When a source has no rows left, its last block being as full as they make it, a new phase begins: the others
share the slots by their weights, with releases and deadlines counted from there. So every row of a source with a weight has its place, and the bound holds within each phase.

Releases and deadlines are computed in whole numbers: weights are
scaled by a power of ten, so weights of as many decimals are exact, and any others are so near that the whole mix is off by a
small fraction of a block. The schedule covers the whole mix, in a SQL fold over its slots; by default a block is a 50,000th of the rows, 8 at least, so that a mix has about
SLOTS blocks at any size. Documents are numbered within a source in the order of a hash, by 4,096
ranges of it instead of one window over a source. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandlake.llm.components import written

BLOCK, SLOTS = 8, 50_000
CHUNK = 256


def _name(source: Column) -> Column:
    """A source's name as a key: null and '' are different sources."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def digits(n_sources: int, slots: int) -> int:
    """Decimals of a weight below 10 that keep blocks x period within a long: (slots + n) * 10 * n * 10 ** digits < 2 ** 63."""
    return max(0, 17 - math.ceil(math.log10((slots + n_sources + 1) * max(1, n_sources))))


def schedule(shares: DataFrame, slots: int, block: int) -> DataFrame:
    """The first `slots` slots of the earliest-deadline-first schedule of shares(source, parts, size): slot, source, turn (of the source's blocks) and at (rows before it).

    A source's weight is its parts of the sum over the sources that have rows left, so they use every slot. A fold keeps each source's turn within the phase and rows left; a deadline tie
    goes to the larger share, then the smaller name. Slots are folded in chunks, whose results are put together once.
    """
    one = shares.where("size > 0").agg(F.array_sort(F.collect_list(F.struct((-F.col("parts")).alias("minus"), "source", "parts", "size"))).alias("s"), F.sum("parts").alias("period"))
    # j-th block of a source of `parts` in `period`: released at floor(j * period / parts), due at ceil((j + 1) * period / parts)
    due = "struct(-(-((get(st.turn, i) + 1) * st.period) div x.parts) + if((get(st.turn, i) + 1) * st.period % x.parts > 0, 1L, 0L) as due, i as i)"
    ready = "get(st.left, i) > 0 and get(st.turn, i) * st.period div x.parts <= t - st.began"
    pick = f"array_min(filter(transform(s, (x, i) -> if({ready}, {due}, cast(null as struct<due: bigint, i: int>))), y -> y is not null)).i"
    last = f"get(st.left, p) <= {block}"
    step = (
        f"transform(array({pick}), p -> struct(if({last}, transform(st.turn, v -> 0L), transform(st.turn, (v, i) -> if(i = p, v + 1, v))) as turn, transform(st.left, (v, i) -> if(i = p, v - {block}, v)) as left, "
        f"if({last}, st.period - get(s, p).parts, st.period) as period, if({last}, t + 1, st.began) as began, st.at + least(get(st.left, p), {block}L) as at, "
        f"concat(st.done, array(struct(t as slot, p as i, (get(s, p).size - get(st.left, p)) div {block} as turn, st.at as at))) as done))[0]"
    )
    entry = "struct<slot: bigint, i: int, turn: bigint, at: bigint>"
    none = f"cast(array() as array<{entry}>)"
    kept = "{0}.turn as turn, {0}.left as left, {0}.period as period, {0}.began as began, {0}.at as at"
    chunk = f"aggregate(sequence(c * {CHUNK}L, least(c * {CHUNK}L + {CHUNK - 1}, {slots - 1}L)), struct({kept.format('all')}, {none} as done), (st, t) -> {step})"
    start = f"struct(transform(s, x -> 0L) as turn, transform(s, x -> x.size) as left, period as period, 0L as began, 0L as at, cast(array() as array<array<{entry}>>) as done)"
    whole = f"aggregate(sequence(0L, {max(0, slots - 1) // CHUNK}L), {start}, (all, c) -> transform(array({chunk}), r -> struct({kept.format('r')}, concat(all.done, array(r.done)) as done))[0], all -> flatten(all.done))"
    if slots <= 0:
        whole = none
    folded = one.where("period > 0").select("s", F.expr(whole).alias("done"))
    return folded.select("s", F.inline("done")).select("slot", F.expr("get(s, i).source").alias("source"), "turn", "at")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, block: int | None = None, power: float = 0.5, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The input's columns and, for every row, mix_block (the slot of its block), mix_position (its place in the mix) and in_mix.

    weights(source, weight) gives target weights; a source without one, or with a weight that isn't positive and finite, is not in the mix: its rows have in_mix false and no block or position. Without
    weights, a source's weight is its number of rows to the power `power`, which tempers a large source, and every row is in the mix. A block has `block` rows, by default
    a SLOTS-th of all rows, BLOCK at least; a source's last block has the rows that are left. Once a source has none left the others go on by their weights.
    There may be any number of sources; the fold takes their number times that of the slots. Rows of one source are ordered by a hash of their id; equal ids, null ids
    and repeated rows are ordered by their whole row. A null source is a source of its own, apart from ''. Input columns named like a result are replaced. An empty table gives no rows.
    """
    docs = docs.drop("mix_block", "mix_position", "in_mix")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    named = docs.withColumn("_source", _name(F.col(source_col))).withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    named = named.withColumn("_row", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    counts = written(named.groupBy("_source", "_range").agg(F.count("*").alias("n")), "mix-counts")
    sizes = counts.groupBy(F.col("_source").alias("source")).agg(F.sum("n").alias("size"))
    if weights is None:
        shares = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        given = weights.select(_name(F.col("source")).alias("source"), F.col("weight").cast("double")).where("weight > 0 and weight < double('infinity')").groupBy("source").agg(F.max("weight").alias("weight"))
        shares = sizes.join(given, "source")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    block = block or max(BLOCK, -(-total // SLOTS))
    of = shares.agg(F.count("*").alias("n"), F.max("weight").alias("top")).first()
    scale = 10.0 ** (digits(of["n"], total // block + of["n"]) - math.floor(math.log10(of["top"]))) if of["n"] else 1.0
    shares = written(shares.withColumn("parts", F.greatest(F.lit(1).cast("long"), F.round(F.col("weight") * scale).cast("long"))), "mix-shares")
    # every slot is a block of a source
    slots = shares.agg(F.sum(F.expr(f"(size + {block} - 1) div {block}"))).first()[0] or 0
    plan = written(schedule(shares, slots, block), "mix-plan")
    offsets = counts.select("_source", "_range", F.expr("coalesce(sum(n) over (partition by _source order by _range rows between unbounded preceding and 1 preceding), 0L)").alias("before"))
    ranked = named.withColumn("_rank", F.expr("row_number() over (partition by _source, _range order by _key, _row)") - 1)
    ranked = ranked.join(offsets, ["_source", "_range"])
    numbered = ranked.withColumn("_n", F.col("before") + F.col("_rank")).withColumn("_turn", F.expr(f"_n div {block}"))
    slot = plan.select(F.col("source").alias("_source"), F.col("turn").alias("_turn"), F.col("slot").alias("mix_block"), "at")
    # about SLOTS rows and one for each source, unless a smaller `block` asks for more
    placed = numbered.join(F.broadcast(slot) if slots <= 4 * SLOTS else slot, ["_source", "_turn"], "left")
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns), "mix_block", F.expr(f"at + _n % {block}").alias("mix_position"), F.col("mix_block").isNotNull().alias("in_mix"))
