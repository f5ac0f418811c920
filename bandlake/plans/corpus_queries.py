"""Queries over labelled corpora, metrics and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.functions import arrays, bands, text, transforms
from bandlake.operators import corpus, metrics
from bandlake.plans.registry import query, rounded
from bandlake.session import table
from bandlake.streaming import series as streams

_TABLE = "c as (select quality as t, toxic as p, count(*) as n from labels group by all), l as (select distinct y from (select t as y from c union all select p from c)), g as (select a.y as y_true, b.y as y_pred, coalesce(n, 0) as n from l a cross join l b left join c on c.t = a.y and c.p = b.y)"
_REPORT = _TABLE + (
    ", r as (select y_true as label, cast(sum(n) as bigint) as support, sum(case when y_true = y_pred then n else 0 end) as tp from g group by 1), p as (select y_pred as label, sum(n) as predicted from g group by 1), "
    "f as (select label, case when predicted > 0 then tp / predicted else 0.0 end as precision, case when support > 0 then tp / support else 0.0 end as recall, case when support + predicted > 0 then 2.0 * tp / (support + predicted) else 0.0 end as f1, support from r join p using (label))"
)


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"with {_TABLE} select y_true, y_pred, cast(n as bigint) as n from g")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


@query(f"with {_TABLE} select y_true, y_pred, cast(n as bigint) as n, cast(dense_rank() over (order by case when y_true = 1 then 0 else 1 end, y_true) - 1 as integer) as row, cast(dense_rank() over (order by case when y_pred = 1 then 0 else 1 end, y_pred) - 1 as integer) as column from g")
def confusion_target_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.target_first(_confusion(spark, sf_dir), 1)


@query(f"with {_REPORT} select label, round(cast(precision as double), 6) as precision, round(cast(recall as double), 6) as recall, round(cast(f1 as double), 6) as f1, support from f")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_report(_confusion(spark, sf_dir)).select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"with {_REPORT} select round(cast(sum(recall * support) / sum(support) as double), 6) as accuracy, round(cast(avg(f1) as double), 6) as macro_f1, round(cast(sum(f1 * support) / sum(support) as double), 6) as weighted_f1 from f")
def f1_macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scores(_confusion(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")))


@query("with r as (select source, lang, avg(cast(quality as double)) as accuracy from documents join labels using (doc_id) group by all) select lang, round(avg(accuracy), 6) as mean, round(stddev_pop(accuracy), 6) + 0.0 as std, count(*) as n_runs from r group by lang")
def accuracy_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source", "lang").agg(F.avg("quality").alias("accuracy"))
    return metrics.across_runs(runs, ["lang"], "accuracy").select("lang", rounded("mean").alias("mean"), rounded("std").alias("std"), "n_runs")


@query(
    "with w as (select vec_id % 4 as f, unnest(range(0, 64)) as k, cast(unnest(embedding) as double) as w from embeddings), m as (select k, avg(abs(w)) as w from w group by k), b as (select min(w) as lo, max(w) as hi from m) select cast(k as integer) as k, round((w - lo) / (hi - lo), 6) as weight from m, b"
)
def weight_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("feature_idx"), F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "weight"))
    return metrics.weight_profile(weights).select("k", rounded("weight").alias("weight"))


# corpora


@query("with j as (select doc_id, case when toxic = 1 then 'toxic' else 'plain' end || case when quality = 0 then ' low' else '' end as label from labels), f as (select max(case when label like '% %' then 1 else 0 end) as token from j) select level, label, count(*) as n from (select case when token = 1 then 'token' else 'sequence' end as level, unnest(case when token = 1 then string_split(label, ' ') else [label] end) as label from j, f) group by all")
def corpus_label_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.when(F.col("toxic") == 1, "toxic").otherwise("plain"), F.when(F.col("quality") == 0, " low").otherwise(""))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.lit("").alias("text"), label.alias("label"))
    return corpus.labelled(rows, "doc_id", ["text"], "label").select("level", F.explode("labels").alias("label")).groupBy("level", "label").agg(F.count("*").alias("n"))


@query("select * from (select conv_id, turn, role, text as text0, lead(text) over w as text1, lead(role) over w as label from conversations window w as (partition by conv_id order by turn)) where role = 'user' and text1 is not null".replace("select *", "select conv_id, turn, text0, text1, label", 1))
def corpus_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.turn_pairs(table(spark, sf_dir, "conversations"))


@query(
    "with t as (select item_id % 2 as g, text as t, min(item_id) as id from benchmark where text is not null group by all), p as (select *, row_number() over (partition by g order by md5(cast(id as varchar) || '-42'), id) - 1 as a, count(*) over (partition by g) as size from t) "
    "select b.item_id as id, y.id as negative_id, cast(s as integer) as rank from benchmark b join p x on x.g = b.item_id % 2 and x.t = b.text, (select unnest(range(1, 3)) as s) q join p y on true where s < x.size and y.g = x.g and y.a = (x.a + s) % x.size"
)
def negative_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").withColumn("type", F.col("item_id") % 2)
    return corpus.negatives(items, "item_id", "type", "text", 2)


@query("with w as (select item_id, unnest(range(0, len(string_split(text, ' ')))) as word, unnest(string_split(text, ' ')) as w from benchmark), p as (select item_id, word, w, unnest(range(0, greatest(1, (length(w) + 3) // 4))) as piece from w) select item_id, cast(word as integer) as word, cast(piece as integer) as piece, substr(w, cast(piece * 4 + 1 as bigint), 4) as text, case when length(w) > 4 then 'long' else 'short' end as label from p")
def token_repeat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    labels = F.transform(words, lambda w: F.when(F.length(w) > 4, "long").otherwise("short"))
    return corpus.repeat_labels(table(spark, sf_dir, "benchmark"), words, labels, 4, ["item_id"]).select("item_id", "word", "piece", "text", "label")


@query("with x as (select quality as t, toxic as p from labels union all select quality, toxic from labels), l as (select distinct y from (select t as y from x union all select p from x)), s as (select y, (select count(*) from x where t = y and p = y) as tp, (select count(*) from x where t = y) as a, (select count(*) from x where p = y) as b from l) select round(cast((select avg(case when t = p then 1.0 else 0.0 end) from x) as double), 6) as accuracy, round(cast(avg(case when a + b > 0 then 2.0 * tp / (a + b) else 0 end) as double), 6) as macro_f1, cast(0 as bigint) as n_bad from s")
def sentence_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    truth = rows.select(F.col("doc_id").alias("id"), F.array("quality").alias("labels"))
    predicted = rows.select(F.col("doc_id").alias("id"), F.array("toxic", "toxic").alias("labels"))
    return corpus.evaluate(truth, predicted).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "n_bad")


_QUALITIES = ["maj7", "min7", "7", "sus4", "min/5", "b:c", "maj", "hdim7"]
_CHORD_SQL = "case item_id % 11 when 0 then 'N' when 1 then 'C' else (['C', 'D', 'E', 'F#', 'Bb'])[1 + item_id % 5] || ':' || ([" + ", ".join(f"'{q}'" for q in _QUALITIES) + f"])[1 + length(text) % {len(_QUALITIES)}] end"


@query(f"with p as (select item_id, {_CHORD_SQL} as original_chord from benchmark where text is not null), q as (select *, string_split(original_chord, ':') as s from p) select item_id, original_chord, case when original_chord = 'N' or len(s) <> 2 then 'N' when s[2] like 'maj%' or s[2] = '7' then s[1] || ':maj' when s[2] like 'min%' then s[1] || ':min' else 'N' end as chord_label from q")
def chord_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chord for each item, of a root by its number and a quality by its length, simplified."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    made = F.concat(pick(["C", "D", "E", "F#", "Bb"], F.col("item_id") % 5), F.lit(":"), pick(_QUALITIES, F.length("text") % len(_QUALITIES)))
    chord = F.when(F.col("item_id") % 11 == 0, "N").when(F.col("item_id") % 11 == 1, "C").otherwise(made)
    return table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", chord.alias("original_chord")).withColumn("chord_label", text.simplify_chord(F.col("original_chord")))


@query("with t as (select item_id, string_split(lower(text), ' ') as w from benchmark), x as (select item_id, d, unnest(range(0, len(w))) as t, unnest(w) as w, len(w) as n from t, (select unnest(range(0, 2)) as d)), v as (select item_id, d, t, n, cast(('0x' || substr(md5(w || '#' || d), 1, 8))::bigint as double) / 2147483648.0 - 1.0 as v from x) select item_id, cast(d as integer) as dim, round(avg(v), 6) + 0.0 as mean from v group by all")
def token_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over an item's tokens of each dimension of the stand-in embedding."""
    tokens = F.split(F.lower("text"), " ")
    series = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(corpus.hashed_embedding(tokens, 2)).alias("dim", "series"))
    return series.select("item_id", "dim", F.explode("series").alias("v")).groupBy("item_id", "dim").agg(rounded(F.avg("v")).alias("mean"))


@query(
    "with t as (select item_id, string_split(lower(text), ' ') as w from benchmark where text is not null), x as (select item_id, d, unnest(range(0, len(w))) as t, unnest(w) as w, len(w) as n from t, (select unnest(range(0, 2)) as d)), "
    "v as (select item_id, d, t, n, cast(('0x' || substr(md5(w || '#' || d), 1, 8))::bigint as double) / 2147483648.0 - 1.0 as v from x), "
    "c as (select v.item_id, v.d, k.t as k, v.n, sum(v.v * cos(pi() * (2 * v.t + 1) * k.t / (2 * v.n))) * case when k.t = 0 then sqrt(1 / cast(v.n as double)) else sqrt(2 / cast(v.n as double)) end as c from v join v k on k.item_id = v.item_id and k.d = v.d group by v.item_id, v.d, k.t, v.n), "
    "p as (select *, k * 64 // n as lo, ((k + 1) * 64 + n - 1) // n as hi from c), w as (select *, greatest(0, least(hi, 8) - lo) / cast(hi - lo as double) as low, greatest(0, hi - greatest(lo, 8)) / cast(hi - lo as double) as high from p) "
    "select item_id, cast(d as integer) as dim, round(sum(c * c * low * low), 6) + 0.0 as low, round(sum(c * c * high * high), 6) + 0.0 as high from w group by item_id, d"
)
def dsl_filter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each item's token series after a low and a high filter."""
    tokens = F.split(F.lower("text"), " ")
    series = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(corpus.hashed_embedding(tokens, 2)).alias("dim", "series"))
    energy = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    low, high = (transforms.frequency_filter(F.col("series"), bands.parse_filter(f)) for f in ("band(64, 0, 7)", "band(64, 8, 63)"))
    return series.select("item_id", "dim", low.alias("l"), high.alias("h")).select("item_id", "dim", rounded(energy("l")).alias("low"), rounded(energy("h")).alias("high"))


@query("select user_id, event_type, max(value) as value, count(*) as n from events group by all having count(*) >= 10")
def frequent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"), F.count("*").alias("n")).where("n >= 10")


@query("select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return star.select("c_custkey", "n_name", "r_name")


@query("select o_orderpriority, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from orders join lineitem on l_orderkey = o_orderkey where o_orderdate >= timestamp '1995-01-01' and l_quantity > 20 group by 1")
def order_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp'1995-01-01'").select("o_orderkey", "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 20").select("l_orderkey", "l_extendedprice", "l_discount")
    found = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    return found.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) + 0.0 as std from events group by all")
def daily_event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.windowed_stats(table(spark, sf_dir, "events"), "ts", "value", ["event_type"])
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query("select item_id, length(text) as n, translate(text, ' /', '__') as name, lpad(cast(item_id as varchar), 6, '0') || '.mp3' as file from benchmark")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    file = F.substring_index(arrays.audio_path(F.col("item_id"), "audio"), "/", -1)
    return items.select("item_id", F.length("text").cast("long").alias("n"), arrays.safe_name(F.col("text")).alias("name"), file.alias("file"))

