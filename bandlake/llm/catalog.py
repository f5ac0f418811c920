"""Registered queries of the llm operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.llm.arc_to_warc import arc_round_trip
from bandlake.llm.decontaminate import decontaminate
from bandlake.llm.katz import katz_scores
from bandlake.llm.license_scan import license_scan
from bandlake.llm.line_dedup import line_dedup
from bandlake.llm.mixing import mix_sources
from bandlake.llm.ngram_join import ngram_join
from bandlake.llm.periodic_runs import periodic_runs
from bandlake.llm.quality import quality
from bandlake.llm.source_divergence import source_divergence
from bandlake.llm.substring_dedup import substring_dedup
from bandlake.llm.toxicity import toxicity
from bandlake.llm.vector_dedup import vector_dedup

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))[0]


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arc_round_trip(spark, _table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op7_arc_to_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
     d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
     f as (select *, min(page_id) over (partition by payload_digest) as low from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> low then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> low then low end as refers_to
from f
"""


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("detections")


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "mix_block", "mix_position", "in_mix")


ORACLES["op4_mix_sources"] = """
with recursive d as (select doc_id, source, coalesce('=' || source, '') as src, row_number() over (partition by coalesce('=' || source, '') order by md5(cast(doc_id as varchar))) - 1 as n from documents),
b as (select greatest(8, (count(*) + 49999) // 50000) as block, count(*) as total from documents),
sizes as (select src, count(*) as size from d group by 1),
c as (select count(*) as n, max(pow(size, 0.5)) as top from sizes),
scaled as (select pow(10.0, greatest(0, 17 - ceil(log10((total // block + n + n + 1) * n))) - floor(log10(top))) as scale from b, c),
shares as (select src, size, greatest(1, cast(round(pow(size, 0.5) * scale) as bigint)) as parts from sizes, scaled),
one as (select list(struct_pack(src := src, parts := parts, size := size) order by parts desc, src) as s, cast(sum(parts) as bigint) as p from shares),
fold(t, s, p, block, turn, rest, began, pick, number, place, held) as (
  select cast(-1 as bigint), s, p, block, list_transform(s, lambda x: cast(0 as bigint)), list_transform(s, lambda x: x.size), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from one, b
  union all
  select t + 1, s, case when rest[k] <= block then p - s[k].parts else p end, block, case when rest[k] <= block then list_transform(turn, lambda v: cast(0 as bigint)) else list_transform(turn, lambda v, i: case when i = k then v + 1 else v end) end,
    list_transform(rest, lambda v, i: case when i = k then v - block else v end), case when rest[k] <= block then t + 2 else began end, k, (s[k].size - rest[k]) // block, place + held, least(block, rest[k])
  from (select *, cast(list_position(due, list_min(due)) as bigint) as k
        from (select *, list_transform(s, lambda x, i: case when rest[i] > 0 and turn[i] * p // x.parts <= t + 1 - began then ((turn[i] + 1) * p + x.parts - 1) // x.parts end) as due from fold where list_max(rest) > 0) a) b
),
plan as (select t as slot, s[pick].src as src, number as turn, place from fold where t >= 0)
select doc_id, source, cast(slot as bigint) as mix_block, cast(place + n % block as bigint) as mix_position, slot is not null as in_mix
from d cross join b left join plan on plan.src = d.src and plan.turn = n // block
"""


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).where("contaminated").drop("contaminated")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(_table(spark, sf_dir, "embeddings"))


ORACLES["op1_substring_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
m as (select k, min(doc_id) as low from g group by k),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from g join m using (k) where low < doc_id),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as j, unnest(ws) as x from w),
kept as (select doc_id, string_agg(x, ' ' order by j) as t, count(*) as n from words anti join gone using (doc_id, j) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
"""

ORACLES["op3_ngram_jaccard_join"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
o as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 75 * (a.n + b.n - o)),
sym as (select x, y from e union all select y, x from e),
r(x, c) as (select doc_id, doc_id from w union select sym.y, r.c from r join sym on sym.x = r.x)
select w.doc_id, coalesce(n, 0) as n_shingles, min(c) as component_id from w left join n using (doc_id) join r on r.x = w.doc_id group by all
"""

# the audited recall is 1 on tables this small, whose graphs find every link, and null without links between different vectors
ORACLES["op5_embedding_near_dedup"] = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings where label is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b, a.x <> b.x as differ from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.98),
r(vec_id, c) as (select vec_id, vec_id from embeddings union select e.b, r.c from r join e on e.a = r.vec_id),
low as (select vec_id, min(c) as component_id from r group by vec_id),
n as (select a as vec_id, count(*) as n_links from e group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, vec_id = component_id as kept, case when (select count(*) from e where differ) > 0 then cast(1 as double) end as audit_recall
from embeddings left join n using (vec_id) join low using (vec_id)
"""


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents, every tenth (by a checksum of the id) with words that repeat from a place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words").cast("long"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    planted = F.array_join(F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % p).cast("int")))), " ")
    return some.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_repeats(_table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


# crc32 bit by bit; a run of period q is a stretch of places whose words come again q words later, so pairs of equal words are joined and numbered
ORACLES["op11_periodic_runs"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
  lambda x, b: list_reduce(list_prepend(xor(x, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) as h from documents),
g as (select *, len(ws) as n, h // 10 as g, h % 10 = 0 and len(ws) > 0 as planted from d),
a as (select *, case when planted then g % n end as a from g),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
t as (select row_number() over () as r, doc_id, n, case when planted then list_transform(range(1, n + 1), lambda i: case when i - 1 < a then ws[i] else ws[1 + a + (i - 1 - a) % p] end) else ws end as ws from p),
w as (select r, n, unnest(range(0, n)) as i, unnest(ws) as x from t),
e as (select a.r, b.i - a.i as q, a.i, a.i - row_number() over (partition by a.r, b.i - a.i order by a.i) as island from w a join w b on a.r = b.r and a.x = b.x and b.i > a.i and 4 * (b.i - a.i) <= a.n),
s as (select r, q, min(i) as start, count(*) + q as length from e group by r, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (select r, start, length, min(q) as period from s group by all),
best as (select * from runs qualify row_number() over (partition by r order by length * 1000000000000 // period desc, start, period) = 1),
told as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by r),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (select r, string_agg(x, ' ' order by i) as x from w anti join gone using (r, i) group by r)
select doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(start as bigint) as start, cast(length as bigint) as length, cast(period as bigint) as period, cast(1000 * length // period as bigint) as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(x, '')) as collapsed_sha256
from t left join best using (r) left join told using (r) left join kept using (r)
"""


@query
def op12_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(_table(spark, sf_dir, "documents"), held_out=F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, terms = source_divergence(_table(spark, sf_dir, "documents"))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


ORACLES["op13_source_divergence"] = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
w as (select r, lang, source, unnest(ws) as term from d),
kept as (select lang, term, count(*) as n from w group by all having count(distinct r) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
v as (select lang, count(*) as v, sum(n) as total from kept group by lang),
own as (select lang, source, sum(n) as total from c group by all),
p as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n, cast(1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(own.total, 0) + 5 * v.v) as bigint) as p, cast(1 + (1000000000 * (kept.n + 5)) // (v.total + 5 * v.v) as bigint) as q
  from g join kept using (lang) join v using (lang) left join own using (lang, source) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(sum(abs(x.p - y.p)), 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (select lang, source, 'term' as part, term as item, p - q as value from p where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
