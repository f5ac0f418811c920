"""Queries that write files of each supported format from the tables, read them by the library's readers and convert them; SQL gives the same rows from the tables."""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.functions import arrays, text
from bandlake.operators import aggregates, corpus
from bandlake.plans.registry import embeddings, query, rounded
from bandlake.session import shared_folder, table
from bandlake.sources import readers, writers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with a text, as it is: line ends and all."""
    return table(spark, sf_dir, "benchmark").where("text is not null")


#: A text as one line of a format that has no line ends in its values.
_LINE = "regexp_replace(text, '[\\t\\r\\n]', ' ', 'g')"


@query(f"select t as text, array_to_string(list_transform(string_split(t, ' '), lambda w: cast(length(w) as varchar)), ' ') as label from (select text || ' \"q\"' as t from benchmark where text is not null)")
def corpus_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "csv")
    items = _items(spark, sf_dir).select(F.concat("text", F.lit(' "q"')).alias("text"))
    writers.write_corpus(items.withColumn("label", F.transform(F.split("text", " "), lambda w: F.length(w).cast("string"))), folder)
    return readers.read_corpus_csv(spark, folder)


@query("select cast(n_nationkey as bigint) as track_id, n_name as track_name, cast(n_regionkey as varchar) as set_region from nation")
def two_header_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "headers")
    body = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    head = spark.createDataFrame([(-2, ",track,set"), (-1, ",name,region")], "k int, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("k").select("value").write.text(folder)
    return readers.read_hierarchical_csv(spark, folder)


@query(f"select {_LINE} as text0, 'not ' || {_LINE} as text1, case item_id % 3 when 0 then 'entailment' when 1 then 'neutral' else 'contradiction' end as label from benchmark where text is not null")
def inference_pairs_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "tsv")
    line = F.regexp_replace("text", r"[\t\r\n]", " ")
    _items(spark, sf_dir).select(F.concat_ws("\t", (F.col("item_id") % 3).cast("string"), line, F.concat(F.lit("not "), line))).write.text(folder)
    pairs = readers.read_pairs_tsv(spark, folder).withColumn("label", F.col("label").cast("int"))
    return corpus.convert_inference(pairs)


@query(
    "with r as (select lang, case doc_id % 10 when 0 then 'test' when 1 then 'dev' else 'train' end as split, coalesce(text, '') as text, (['entailment', 'neutral', 'contradiction'])[1 + doc_id % 3] as label from documents where lang in ('de', 'en', 'es', 'fr', 'zh')) "
    "select lang, split, label, count(*) as n, cast(sum(length(text)) as bigint) as premise_characters, cast(sum(4 + length(text)) as bigint) as hypothesis_characters from r group by all"
)
def inference_layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as premises with hypotheses, written in a folder a language and split and read back."""
    folder = _folder(spark, "inference")
    text = F.coalesce("text", F.lit(""))
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    rows = table(spark, sf_dir, "documents").select("lang", split.alias("split"), F.concat(F.lit("p: "), text).alias("premise"), F.concat(F.lit("not p: "), text).alias("hypothesis"), (F.col("doc_id") % 3).alias("label"))
    writers.write_corpus(corpus.convert_inference_layout(rows), folder, ("lang", "split"))
    found = readers.read_corpus_csv(spark, folder)
    return found.groupBy("lang", "split", "label").agg(F.count("*").alias("n"), F.sum(F.length("text0") - 3).alias("premise_characters"), F.sum(F.length("text1") - 3).alias("hypothesis_characters"))


_TREE = "'20news-bydate-' || case when item_id % 3 = 0 then 'test' else 'train' end"


@query(
    f"with r as (select {_TREE} as tree, 'topic' || (item_id % 4) as label, regexp_replace(text, '[^\\x{{0}}-\\x{{ff}}]', '?', 'g') as text, {_TREE} || '/topic' || (item_id % 4) || '/' || item_id as id from benchmark where text is not null), "
    "k as (select *, row_number() over (partition by tree order by md5(id || '-42'), id) as rank, count(*) over (partition by tree) as n from r) select id, text, label, case when tree like '%-test' then 'test' when rank <= floor(n * 0.2 + 0.5) then 'dev' else 'train' end as split from k"
)
def newsgroups_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files, a file an item, written and read back; texts are in ISO-8859-1."""
    folder = _folder(spark, "news")
    tree = F.concat(F.lit("20news-bydate-"), F.when(F.col("item_id") % 3 == 0, "test").otherwise("train"))
    name = F.concat(tree, F.lit("/topic"), F.col("item_id") % 4, F.lit("/"), F.col("item_id"))
    writers.write_files(_items(spark, sf_dir).select(name.alias("name"), F.encode(F.regexp_replace("text", r"[^\x{0}-\x{ff}]", "?"), "ISO-8859-1").alias("content")), folder)
    return corpus.convert_newsgroups(readers.read_files(spark, folder))


@query(
    "with r as (select lang, case when doc_id % 4 = 0 then 'test' else 'train' end as split, 1 + doc_id % 5 as stars, source, text from documents), v as (select lang, split, 'sentiment' as view, case when stars <= 2 then '-' when stars = 3 then 'o' else '+' end as label, text from r union all select lang, split, 'topic', source, text from r) "
    "select lang, split, view, label, count(*) as n, cast(sum(length(text)) as bigint) as characters from v group by all"
)
def review_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"), (1 + F.col("doc_id") % 5).alias("stars"), F.col("source").alias("product_category"), F.col("text").alias("review_body"))
    return corpus.convert_reviews(rows).groupBy("lang", "split", "view", "label").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("characters"))


_WORDS = "list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("item_id", F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "").alias("words"))


@query(
    f"with w as (select {_WORDS} as words from benchmark where text is not null) select array_to_string(list_transform(words, lambda w: case when w = 'the' then '(' when w = 'a' then '“' else w end), ' ') as text, "
    "array_to_string(list_transform(words, lambda w: case when length(w) > 4 then 'NN' else 'DT-1' end), ' ') as label from w where len(words) > 0"
)
def treebank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "parses")
    leaf = lambda w: F.concat(F.lit("("), F.when(F.length(w) > 4, "NN").otherwise("DT-1"), F.lit(" "), F.when(w == "the", "-LRB-").when(w == "a", "``").otherwise(w), F.lit(")"))
    _words(spark, sf_dir).where("size(words) > 0").select(F.concat(F.lit("( (S "), F.array_join(F.transform("words", leaf), " "), F.lit(") )"))).write.text(folder)
    return corpus.convert_parses(spark.read.text(folder))


@query(f"with w as (select {_WORDS} as words from benchmark where text is not null) select array_to_string(words, ' ') as text, array_to_string(list_transform(words, lambda w: case when length(w) > 4 then 'obj' else 'det' end), ' ') as label from w where len(words) > 0")
def dependency_treebank(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "conllu")
    line = lambda w, i: F.concat_ws("\t", (i + 1).cast("string"), w, F.lit("_"), F.lit("X"), F.lit("_"), F.lit("_"), F.lit("0"), F.when(F.length(w) > 4, "obj:x").otherwise("det"), F.lit("_"), F.lit("_"))
    block = F.array_join(F.concat(F.array(F.lit("# sentence"), F.lit("1-2\t_\t_\t_\t_\t_\t_\t_\t_\t_")), F.transform("words", line)), "\n")
    _words(spark, sf_dir).where("size(words) > 0").select(block).write.option("lineSep", "\n\n").text(folder)
    return corpus.convert_dependencies(readers.read_conllu(spark, folder))


@query(f"with w as (select {_WORDS} as words from benchmark where text is not null) select array_to_string(words, ' ') as text, array_to_string(list_transform(words, lambda w: (['O', 'B-PER', 'I-PER', 'B-ORG', 'I-ORG', 'B-LOC', 'I-LOC'])[1 + length(w) % 7]), ' ') as label from w")
def entity_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.convert_entities(_words(spark, sf_dir).select(F.col("words").alias("tokens"), F.transform("words", lambda w: F.length(w) % 7).alias("ner_tags")))


@query(
    f"with b as (select item_id as id, 't' || (item_id % 2) as g, text as t from benchmark where text is not null), x as (select g, t, min(id) as id from b group by all), p as (select *, row_number() over (partition by g order by md5(cast(id as varchar) || '-42'), id) - 1 as a, count(*) over (partition by g) as size from x), "
    "m as (select b.id, y.id as answer_id, '0' as label from b join p x using (g, t) join p y on y.g = x.g and x.size > 1 and y.a = (x.a + 1) % x.size union all select id, id, '1' from b), l as (select unnest(['en', 'de']) as lang) "
    "select lang, case when ('0x' || substr(md5(cast(m.id as varchar) || '-42'), 1, 8))::bigint / 4294967296.0 < 0.2 then 'dev' else 'train' end as split, case when lang = 'de' then 'zu ' || q.t else q.t end as text0, case when lang = 'de' then 'zu answer ' || r.t else 'answer ' || r.t end as text1, label, m.id from m join b q on q.id = m.id join b r on r.id = answer_id, l"
)
def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, answer = F.concat(F.lit("t"), F.col("item_id") % 2), F.concat(F.lit("answer "), "text")
    both = lambda c: F.create_map(F.lit("en"), c(lambda x: x), F.lit("de_DE"), c(lambda x: F.concat(F.lit("zu "), x)))
    rows = _items(spark, sf_dir).select(F.col("item_id").alias("id"), both(lambda f: f(F.col("text"))).alias("queries"), both(lambda f: F.struct(kind.alias("type"), f(answer).alias("text"))).alias("answers"))
    return corpus.convert_questions(rows)


_FILE = "'/audio/' || substr(lpad(cast(c_custkey as varchar), 6, '0'), 1, 3) || '/' || lpad(cast(c_custkey as varchar), 6, '0') || '.mp3'"


@query(f"select c_custkey as track_id, c_mktsegment as genre, {_FILE} as audio_path from customer where c_custkey % 2 = 0 and c_custkey % 3 = 0 and c_custkey % 5 <> 0")
def track_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    raw = rows.select(F.col("c_custkey").cast("string").alias("track_id"), F.when(F.col("c_custkey") % 2 == 0, "small").otherwise("large").alias("set_subset"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("track_genre_top"))
    files = rows.where("c_custkey % 3 = 0").select(arrays.audio_path(F.col("c_custkey"), "/audio").alias("path"))
    return corpus.convert_tracks(raw, files, "/audio")


@query(
    "with c as (select n_nationkey as k, i, ['maj7', 'min', '7', 'sus4'][1 + (n_nationkey + i) % 4] as q, ['C', 'D', 'E'][1 + i % 3] as r from nation, (select unnest(range(0, 3)) as i)) select cast(k as bigint) as track_id, 'a' || k || '.wav' as audio_path, i * 0.5 as t_start, i * 0.5 + 0.5 as t_end, "
    "case when q like 'maj%' or q = '7' then r || ':maj' when q like 'min%' then r || ':min' else 'N' end as chord_label, r || ':' || q as original_chord from c".replace("i * 0.5", "cast(i * 0.5 as double)")
)
def chord_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JAMS file for each nation, read and converted to segments."""
    folder = _folder(spark, "jams")
    segment = lambda i: F.struct((F.lit(0.5) * i).alias("time"), F.lit(0.5).alias("duration"), F.concat(F.element_at(F.array(*map(F.lit, "CDE")), i % 3 + 1), F.lit(":"), F.element_at(F.array(*map(F.lit, ("maj7", "min", "7", "sus4"))), ((F.col("k") + i) % 4 + 1).cast("int"))).alias("value"))
    data = F.transform(F.sequence(F.lit(0), F.lit(2)), segment)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).select("k", F.array(F.struct(F.lit("chord").alias("namespace"), data.alias("data"))).alias("annotations"))
    rows.write.partitionBy("k").json(folder)
    found = readers.read_jams(spark, f"{folder}/*").withColumn("track_id", F.regexp_extract("path", r"k=(\d+)", 1).cast("long"))
    return corpus.convert_chords(found.withColumn("audio_path", F.concat(F.lit("a"), "track_id", F.lit(".wav"))))


@query("with s as (select cast(label as varchar) as label, unnest(range(0, 64)) as t, cast(unnest(embedding) as double) as v from embeddings) select label, cast(t // 16 as integer) as feature_idx, cast(t % 16 as integer) as t, round(avg(v), 6) + 0.0 as mean, count(*) as n from s where label is not null group by all")
def npz_archive_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as (B, 4, 16) archives, written and read back: means of each label, feature and step."""
    folder = _folder(spark, "npz")
    x = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("series", i * 16 + 1, F.lit(16)))
    writers.write_files(writers.npz_archives(embeddings(spark, sf_dir).where("label is not null").select("label", x.alias("features"))), folder)
    found = readers.read_npz(spark, folder).select("label", "feature_idx", F.posexplode("series").alias("t", "v"))
    return found.groupBy("label", "feature_idx", "t").agg(rounded(F.avg("v")).alias("mean"), F.count("*").alias("n"))


def _wav(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = []
        for k in batch.column("k").to_pylist():
            sink = io.BytesIO()
            with wave.open(sink, "wb") as f:
                f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000), f.writeframes((((k * 7 + np.arange(20) * 13) % 200 - 100) * 100).astype("<i2").tobytes())
            files.append(sink.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([f"{k:02d}_BN_comp_mix.wav" for k in batch.column("k").to_pylist()]), pa.array(files, pa.binary())], ["name", "content"])


@query("select cast(n_nationkey as integer) as k, cast(i as integer) as t, round(((n_nationkey * 7 + i * 13) % 200 - 100) * 100 / 32768.0, 6) as v, n_nationkey % 2 = 0 as annotated, lpad(cast(n_nationkey as varchar), 2, '0') as label from nation, (select unnest(range(0, 20)) as i)".replace("/ 32768.0", "/ cast(32768 as double)"))
def audio_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound file for each nation and an annotation for every other: decoded samples, the label of each name, and whether it is annotated."""
    folder = _folder(spark, "audio")
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    writers.write_files(keys.mapInArrow(_wav, "name string, content binary"), folder)
    writers.write_files(keys.where("k % 2 = 0").select(F.format_string("%02d_BN_comp.jams", "k").alias("name"), F.lit("{}").alias("content")), folder)
    audio, notes = (readers.read_files(spark, folder, p) for p in ("*_mix.wav", "*.jams"))
    pairs, alone = readers.pair_annotations(audio, notes)
    known = pairs.select(F.col("audio_path").alias("path"), F.lit(True).alias("annotated")).unionByName(alone.select(F.col("audio_path").alias("path"), F.lit(False).alias("annotated")))
    series = readers.embed_files(audio, "waveform").join(known, "path").withColumn("label", text.file_label(F.col("path")))
    return series.select(F.col("label").cast("int").alias("k"), F.posexplode("series").alias("t", "v"), "annotated", "label").withColumn("v", rounded("v"))


@query("with a as (select source, avg(cast(quality as double)) as accuracy from documents join labels using (doc_id) group by 1) select source, round(accuracy, 6) as accuracy, source || ': ' || printf('%.2f', accuracy * 100) as line from a".replace("printf('%.2f', accuracy * 100)", "format('{:.2f}', accuracy * 100)"))
def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as JSON and a report as text, written and read back."""
    found = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("accuracy"))
    folder = _folder(spark, "metrics")
    writers.write_metrics(found, f"{folder}/json")
    stored = spark.read.json(f"{folder}/json")
    shown = stored.withColumn("percent", F.element_at(text.percent(F.array("accuracy")), 1))
    writers.report_lines(shown, "%s: %.2f", "source", "percent").write.text(f"{folder}/text")
    lines = spark.read.text(f"{folder}/text").select(F.substring_index("value", ":", 1).alias("source"), F.col("value").alias("line"))
    return stored.join(lines, "source").select("source", rounded("accuracy").alias("accuracy"), "line")


@query("with s as (select vec_id, label, cast(unnest(embedding) as double) as v from embeddings) select label, count(distinct vec_id) as n, round(sum(v), 4) + 0.0 as total from s where label < 5 group by label")
def series_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series written in a folder a label; the filter reads its folders only."""
    folder = _folder(spark, "series")
    writers.write_series(embeddings(spark, sf_dir).where("label is not null"), folder, ("label",))
    stored = spark.read.parquet(folder).where("label < 5").select("label", "vec_id", F.explode("series").alias("v"))
    return stored.groupBy("label").agg(F.countDistinct("vec_id").alias("n"), rounded(F.sum("v"), 4).alias("total"))


@query(
    "with s as (select vec_id, embedding as x from embeddings), f as (select vec_id, x[1:20] as fixed, x[25:40] as crop, x[1:32] as lane0, x[33:64] as lane1, x[5:8] as band from s) select vec_id, 20 as n_fixed, round(list_sum(fixed), 5) + 0.0 as fixed, round(list_sum(crop), 5) + 0.0 as crop, "
    "round(list_sum(lane0), 5) + 0.0 as lane0, round(list_sum(lane1), 5) + 0.0 as lane1, round(list_sum(band), 5) + 0.0 as masked, 80 as n_padded from f".replace("embedding as x", "list_transform(embedding, lambda v: cast(v as double)) as x")
)
def series_reshapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("series")
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 5)
    fixed, lanes = arrays.fix_length(x, 20), arrays.halves(x, 32)
    return embeddings(spark, sf_dir).select("vec_id", F.size(fixed).alias("n_fixed"), total(fixed).alias("fixed"), total(arrays.center_crop(x, 16)).alias("crop"), total(lanes[0]).alias("lane0"), total(lanes[1]).alias("lane1"), total(arrays.band_mask(x, [(4, 8)])).alias("masked"), F.size(arrays.pad_to(x, 80)).alias("n_padded"))


@query(
    "with p as (select l_quantity as x, l_extendedprice as y, l_returnflag as g from lineitem), r as (select g, corr(x, y) as r, count(*) as n from p group by g) select g, round(r, 6) as r, n, case when abs(r) < 1 then round(r * sqrt((n - 2) / (1 - r * r)), 3) end as t from r".replace("p as (select l_quantity as x, l_extendedprice as y", "p as (select cast(l_quantity as double) as x, cast(l_extendedprice as double) as y")
)
def price_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), F.col("l_returnflag").alias("g"))
    return aggregates.correlation(rows, "x", "y", ["g"]).select("g", rounded("r").alias("r"), "n", rounded("t", 3).alias("t"))
