"""Queries that fit linear probes; compared with other solvers in the tests, as SQL can't fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.functions import arrays, bands, transforms
from bandlake.functions.subwords import pieces, read_vocabulary
from bandlake.operators import convolution, corpus, encoding, metrics, probes, ranking, text_probe, training
from bandlake.plans.registry import SERIES_SQL, embeddings, query, rfft_sql, rounded
from bandlake.session import stored, table


def _magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, features, is_test) of magnitude spectra."""
    spectra = embeddings(spark, sf_dir).select("label", "vec_id", transforms.rfft_magnitude(F.col("series")).alias("features"))
    return probes.split_features(spectra, "label", "vec_id", "features")


def _accuracy(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, rounded("accuracy", 4).alias("accuracy"), rounded("chance", 4).alias("chance"), "n")


@query()
def probe_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(probes.band_probe(embeddings(spark, sf_dir), "label", "vec_id"), "target", "kind", "band")


@query()
def probe_window_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"none": None, "hann": "hann", "hamming": "hamming"}
    df = embeddings(spark, sf_dir).select("vec_id", "label", *(transforms.rfft_magnitude(F.col("series"), w).alias(n) for n, w in names.items()))
    return _accuracy(probes.variant_probes(df, "label", "vec_id", {n: n for n in names}), "variant", "target")


@query()
def probe_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = arrays.halves(F.col("series"), 32)
    df = embeddings(spark, sf_dir).select("vec_id", "label", F.col("series").alias("both"), *(half[i].alias(f"lane{i}") for i in range(2)))
    return _accuracy(probes.variant_probes(df, "label", "vec_id", {n: n for n in ("both", "lane0", "lane1")}), "variant", "target")


@query()
def probe_time_vs_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without scaling the cosine transform is a rotation, so both variants agree; centring takes the first coefficient away."""
    x = F.col("series")
    df = embeddings(spark, sf_dir).select("vec_id", "label", x.alias("time"), transforms.dct(x).alias("frequency"), transforms.dct(arrays.center(x)).alias("no_mean"))
    return _accuracy(probes.variant_probes(df, "label", "vec_id", {n: n for n in ("time", "frequency", "no_mean")}, scale=False), "variant", "target")


@query()
def probe_weight_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _magnitudes(spark, sf_dir)
    fitted = probes.fit_probes(data, [probes.Probe("0", "0", ((0, 33),))])
    return metrics.weight_profile(probes.coefficients(data, fitted)).select("k", rounded("weight", 4).alias("weight"))


@query()
def greedy_band_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probes.greedy_bands(_magnitudes(spark, sf_dir), bands.equal_width(33, 4), "0")
    return found.select("step", "band", rounded("own_accuracy", 4).alias("own_accuracy"), rounded("accuracy", 4).alias("accuracy"))


@query()
def multiclass_confusion_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.band_confusions(_magnitudes(spark, sf_dir), bands.equal_count(33, 2))


@query()
def probe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probes.pair_probes(_magnitudes(spark, sf_dir), bands.equal_count(33, 2))
    return found.select("band_a", "band_b", rounded("accuracy", 4).alias("accuracy"), rounded("gain", 4).alias("gain"))


@query()
def kmeans_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean spectrum and size of clusters of the vectors' spectra."""
    m = embeddings(spark, sf_dir).select("vec_id", transforms.rfft_magnitude(F.col("series")).alias("m"))
    found = probes.cluster_positions(m, "vec_id", "m")
    return found.select("cluster", F.posexplode("features").alias("k", "v")).groupBy("cluster", "k").agg(F.avg("v").alias("mean"), F.count("*").alias("size"))


_BINS = (
    "with recursive {s}, {d}, l as (select vec_id, cast(label as varchar) as label, row_number() over (partition by label order by md5(cast(vec_id as varchar) || '-42'), vec_id) <= floor(count(*) over (partition by label) * 0.2 + 0.5) as is_test from embeddings where label is not null), "
    "st as (select k, avg(m) as mu, stddev_pop(m) as sd from d join l using (vec_id) where not is_test group by k), "
    "z as (select l.label, is_test, k, (m - mu) / case when sd > 1e-12 * greatest(1, abs(mu)) then sd else 1 end as x from d join l using (vec_id) join st using (k)), "
    "c as (select label as target, count(*) filter (not is_test) as pos from l group by label having count(*) >= 10), n as (select count(*) as n from l where not is_test), "
    "t as (select k, target, x, case when label = target then 1 else 0 end as y, n / (2.0 * case when label = target then pos else n - pos end) as s from z, c, n where not is_test), "
    "fit(i, k, target, w, b) as (select 0, k, target, cast(0 as double), cast(0 as double) from (select distinct k, target from t) union all "
    "select i + 1, k, target, w - least(1, 4 / greatest(abs(dw), abs(db), 1e-30)) * dw, b - least(1, 4 / greatest(abs(dw), abs(db), 1e-30)) * db from (select *, (h00 * g1 - h01 * g0) / (h11 * h00 - h01 * h01) as dw, (h11 * g0 - h01 * g1) / (h11 * h00 - h01 * h01) as db from "
    "(select i, k, target, w, b, sum(s * (p - y) * x) + w as g1, sum(s * (p - y)) + 1e-9 * b as g0, sum(s * p * (1 - p) * x * x) + 1 as h11, sum(s * p * (1 - p) * x) as h01, sum(s * p * (1 - p)) + 1e-9 as h00 from (select f.*, x, y, s, 1 / (1 + exp(-(w * x + b))) as p from fit f join t using (k, target) where i < 15) q group by i, k, target, w, b) h) g) "
    "select f.target, cast(f.k as integer) as k, round(avg(case when (w * x + b > 0) = (label = f.target) then 1.0 else 0.0 end), 4) as accuracy, round(avg(case when label = f.target then 1.0 else 0.0 end), 4) as chance, count(*) as n from fit f join z on z.k = f.k where i = 15 and is_test group by f.target, f.k"
)


@query(_BINS.format(s=SERIES_SQL, d=rfft_sql()))
def probe_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe of each class on each single frequency; the SQL fits them by the same Newton steps, written out for two coefficients."""
    return _accuracy(probes.bin_profiles(embeddings(spark, sf_dir).where("label is not null"), "label", "vec_id"), "target", "k")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as samples of four features of 16 steps."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("series", i * 16 + 1, F.lit(16)))
    return embeddings(spark, sf_dir).select("vec_id", "label", F.posexplode(parts).alias("feature_idx", "series"))


@query()
def probe_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of samples of several features: a band's coefficients of all of them."""
    return _accuracy(probes.band_probe(_features(spark, sf_dir), "label", "vec_id", feature="feature_idx", band_width=3), "target", "kind", "band")


@query()
def probe_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layered = _features(spark, sf_dir).withColumn("layer", F.floor(F.col("feature_idx") / 2).cast("int"))
    return _accuracy(probes.layer_probes(layered, "label", "vec_id", "layer", ["feature_idx"]), "layer", "target")


@query()
def probe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial probes on time, cosine, mel, logarithmic and wavelet features."""
    return _accuracy(probes.feature_probes(embeddings(spark, sf_dir), "label", "vec_id"), "variant")


@query()
def probe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unscaled multinomial probe whose test rows are whole groups."""
    rows = embeddings(spark, sf_dir).withColumn("track", F.floor(F.col("vec_id") / 4))
    return metrics.class_report(metrics.confusion(probes.group_probe(rows, "label", "vec_id", "track", "series"), "label", "prediction"))


@query()
def probe_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured run over labels with samples enough, as metric rows."""
    config = {"label": "label", "id": "vec_id", "transform": "dct", "band_width": 16, "min_samples": 5, "targets": ["0", "1"]}
    return probes.run_pipeline(embeddings(spark, sf_dir), config).select("metric", "target", rounded("value", 4).alias("value"))


@query()
def learnt_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openness of a filter learnt with a token classifier of short and long words."""
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    items = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", words.alias("words")).where("size(words) > 0")
    rows = items.select("item_id", F.transform("words", lambda w: F.when(F.length(w) > 4, "long").otherwise("short")).alias("labels"), corpus.hashed_embedding(F.col("words"), 3).alias("features"))
    logits, *_ = training.learn_filter(rows, 8, steps=15)
    return spark.createDataFrame([(k, round(float(1 / (1 + 2.718281828459045**-v)), 4)) for k, v in enumerate(logits)], "k int, openness double")


@query()
def text_probe_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a token classifier of short and long words under three filters."""
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    items = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("id"), words.alias("words")).where("size(words) > 0")
    labels = F.transform("words", lambda w: F.when(F.length(w) > 4, "long").otherwise("short"))
    data = items.select("id", F.array(F.array_join("words", " ")).alias("texts"), labels.alias("labels"), F.lit("token").alias("level"))
    found = text_probe.run_tasks({"lengths": (data.where("id % 4 <> 0"), data.where("id % 4 = 0"))}, ["nofilter()", "band(64, 0, 15)", "band(64, 16, 63)"], solver="convex")
    return found.select("task", "filter", *(rounded(c, 4).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")))


#: A public vocabulary; any file of this form will do.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a corpus labelled by role."""
    rows = table(spark, sf_dir, "conversations").where("text is not null and role is not null")
    return rows.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.array("text").alias("texts"), F.array("role").alias("labels"), F.lit("sequence").alias("level"), (F.crc32(F.col("conv_id").cast("string")) % 5 == 0).alias("held_out"))


def _encoder(spark: SparkSession, corpus_: DataFrame) -> encoding.PieceEncoder:
    vocabulary = read_vocabulary(spark, VOCABULARY)
    return encoding.PieceEncoder(vocabulary, encoding.train_vectors(corpus_, vocabulary, dims=16))


@query()
def turn_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-word pieces of every turn: how many, how many words and characters they cover, and a digest of numbers and offsets."""
    vocabulary = read_vocabulary(spark, VOCABULARY)
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", pieces(F.array("text"), vocabulary).alias("p"))
    digest = F.md5(F.array_join(F.transform(F.arrays_zip("p.ids", "p.start", "p.end"), lambda x: F.concat_ws(",", x["ids"], x["start"], x["end"])), " "))
    return p.select("conv_id", "turn", F.size("p.ids").alias("n_pieces"), (F.array_max("p.word") + 1).alias("n_words"), F.array_max("p.end").alias("n_chars"), digest.alias("digest"))


@query()
def turn_role_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of a classifier of turns' roles with a learnt frequency filter, over sub-word encodings, trained by mini-batches."""
    turns = _turns(spark, sf_dir)
    encoder = _encoder(spark, turns.where("not held_out"))
    learnt, check = (text_probe.token_rows(stored(text_probe.piece_rows(turns.where(c).drop("held_out"), encoder), "turns")) for c in ("not held_out", "held_out"))
    newest, _ = training.train(learnt, check, filter_size=16, epochs=4, batches=4, rate=0.05, encoder=encoder)
    return training.history_table(spark, newest).select("epoch", *(rounded(c, 4).alias(c) for c in ("train_loss", "train_accuracy", "valid_loss", "valid_accuracy", "rate")), "best")


@query()
def turn_role_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of role classifiers of turns, mean-pooled after filters, over two seeds each, with their mean and deviation over the seeds."""
    turns = _turns(spark, sf_dir)
    encoder = _encoder(spark, turns.where("not held_out"))
    tasks = {"roles": tuple(turns.where(c).drop("held_out") for c in ("not held_out", "held_out"))}
    found = text_probe.run_tasks(tasks, ["nofilter()", "band(64, 0, 7)", "band(64, 8, 63)"], (1, 2), encoder=encoder, pooling="mean", epochs=3, batches=4, rate=0.05)
    return found.select("task", "filter", "seed", *(rounded(f"{c}{part}", 4).alias(f"{c}{part}") for part in ("", "_mean", "_std") for c in text_probe.SCORES))


@query()
def convolution_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of a convolution probe on samples of four features of 16 steps."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("series", i * 16 + 1, F.lit(16)))
    rows = embeddings(spark, sf_dir).where("label is not null").select(F.col("label").cast("string").alias("label"), "vec_id", parts.alias("features"))
    data = ranking.stratified_split(rows, "label", "vec_id").persist()
    try:
        fitted = convolution.fit_convolution(data, channels=(16, 16), epochs=5, batches=4, rate=0.01)
        said = stored(convolution.convolved(data, fitted, ["vec_id"]), "said")
    finally:
        data.unpersist()
    report = metrics.class_report(metrics.confusion(said, "label", "prediction"))
    return report.select("label", *(rounded(c, 4).alias(c) for c in ("precision", "recall", "f1")), "support")


@query()
def probe_confusion_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions over time, on the spectrum and on bands, each class first in turn."""
    return probes.confusion_relations(embeddings(spark, sf_dir), "label", "vec_id", n_bands=4)


@query()
def probe_band_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of each class on band means, with its mean magnitudes and the probe's weights."""
    found = probes.band_mean_probes(_features(spark, sf_dir), "label", "vec_id", band_width=3, feature="feature_idx")
    return found.select("label", "n", "band", *(rounded(c, 4).alias(c) for c in ("accuracy", "magnitude", "weight")))
