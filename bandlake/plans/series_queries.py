"""Queries over series: spectra, bands, statistics, ranks and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.functions import arrays, audio, bands, transforms
from bandlake.operators import aggregates, ranking
from bandlake.plans.registry import SERIES_SQL, dct_sql, embeddings, query, rfft_sql, rounded, window_sql
from bandlake.session import table
from bandlake.sources.readers import long_series

MAGNITUDE = f"with {SERIES_SQL}, {rfft_sql()} "
COSINES = f"with {SERIES_SQL}, {dct_sql()} "
_R = "round({}, 6) + 0.0 as {}"


def _mean(value: str = "m", alias: str = "mean") -> str:
    return f"round(avg({value}), 6) + 0.0 as {alias}"


@query(MAGNITUDE + f"select label, cast(k as integer) as k, {_mean()} from d group by label, k")
def fft_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mean_spectrum(embeddings(spark, sf_dir), ["label"]).select("label", "k", rounded("mean").alias("mean"))


@query(MAGNITUDE + f"select cast(k as integer) as k, round(cast(k as double) / 32, 6) as frequency, {_mean()} from d group by k")
def fft_mean_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.mean_spectrum(embeddings(spark, sf_dir))
    return found.select("k", F.round(F.col("k") / 32, 6).alias("frequency"), rounded("mean").alias("mean"))


@query(MAGNITUDE + "select vec_id, cast(k as integer) as k, round(m, 6) + 0.0 as m from d")
def fft_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(transforms.rfft_magnitude(F.col("series"))).alias("k", "m")).withColumn("m", rounded("m"))


@query(MAGNITUDE + "select vec_id, round(sum(case when k < 5 then m else 0.0 end), 6) + 0.0 as low_sum from d group by vec_id")
def fft_first_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.aggregate(F.slice(transforms.rfft_magnitude(F.col("series")), 1, 5), F.lit(0.0), lambda a, x: a + x)
    return embeddings(spark, sf_dir).select("vec_id", rounded(low).alias("low_sum"))


@query(COSINES + f"select label, cast(k as integer) as k, {_mean()} from d group by label, k")
def dct_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mean_spectrum(embeddings(spark, sf_dir), ["label"], transform="dct").select("label", "k", rounded("mean").alias("mean"))


@query("with " + SERIES_SQL + ", c as (select vec_id, label, t, v - avg(v) over (partition by vec_id) as v from s), " + dct_sql("c") + "select round(avg(abs(m)), 9) as mean_abs, count(*) as n from d where k = 0")
def dct_first_coefficient_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.element_at(transforms.dct(arrays.center(F.col("series"))), 1)
    return embeddings(spark, sf_dir).agg(F.round(F.avg(F.abs(first)), 9).alias("mean_abs"), F.count("*").alias("n"))


@query("select vec_id, 0.0::double as error from embeddings")
def idct_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.zip_with(transforms.inverse_dct(transforms.dct(F.col("series"))), "series", lambda a, b: F.abs(a - b))
    return embeddings(spark, sf_dir).select("vec_id", rounded(F.array_max(back)).alias("error"))


@query("with " + SERIES_SQL + ", p as (select vec_id, t // 2 as i, max(case when t % 2 = 0 then v end) as a, max(case when t % 2 = 1 then v end) as b from s group by 1, 2) select vec_id, round(sum((a + b) * (a + b)) / 2, 6) as low_energy, round(sum((a - b) * (a - b)) / 2, 6) as high_energy from p group by vec_id")
def haar_dwt_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    energy = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    w = embeddings(spark, sf_dir).select("vec_id", arrays.haar(F.col("series")).alias("w"))
    return w.select("vec_id", rounded(energy(F.slice("w", 1, 32))).alias("low_energy"), rounded(energy(F.slice("w", 33, 32))).alias("high_energy"))


def _windowed(name: str):
    sql = f"with {SERIES_SQL}, w as (select vec_id, label, t, v * {window_sql(name)} as v from s), {rfft_sql('w')} select cast(k as integer) as k, {_mean()} from d group by k"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregates.mean_spectrum(embeddings(spark, sf_dir), window=name).select("k", rounded("mean").alias("mean"))

    f.__name__ = f"window_{name}_mean"
    query(sql)(f)


for _name in ("hann", "hamming", "blackman"):
    _windowed(_name)


@query(
    "with " + SERIES_SQL + ", " + ", ".join(rfft_sql(n=64 * f, name=f"d{f}") for f in (1, 2, 4))
    + " " + " union all ".join(f"select cast({f} as integer) as factor, cast(k as integer) as k, round(cast(k as double) / {32 * f}, 6) as frequency, {_mean()} from d{f} group by k" for f in (1, 2, 4))
)
def zero_pad_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.zero_padded_spectra(embeddings(spark, sf_dir), [1, 2, 4])
    return found.select("factor", "k", F.round("frequency", 6).alias("frequency"), rounded("mean").alias("mean"))


_RHO = f"with {SERIES_SQL}, c as (select vec_id, label, t, v - avg(v) over (partition by vec_id) as v from s), r as (select a.vec_id, a.label, b.t - a.t as lag, sum(a.v * b.v) as r from c a join c b on a.vec_id = b.vec_id and b.t between a.t and a.t + 16 group by all), z as (select r.vec_id, r.label, r.lag, r.r / o.r as rho from r join r o on o.vec_id = r.vec_id and o.lag = 0) "


@query(_RHO + f"select cast(lag as integer) as lag, {_mean('rho', 'rho')}, lag in (4, 8, 13) as is_key from z group by lag")
def autocorr_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = aggregates.key_lags(17, 16)
    return aggregates.autocorrelation_curves(embeddings(spark, sf_dir), 16).select("lag", rounded("rho").alias("rho"), F.col("lag").isin(keys).alias("is_key"))


@query(_RHO + f"select label, cast(lag as integer) as lag, {_mean('rho', 'rho')} from z group by grouping sets ((lag), (label, lag))")
def autocorr_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.autocorrelation_curves(embeddings(spark, sf_dir), 16, "label").select("label", "lag", rounded("rho").alias("rho"))


@query("with s as (select vec_id, label, (unnest(range(0, 64)) * 37 + 11) % 64 as t, cast(unnest(embedding) as double) as v from embeddings), " + rfft_sql() + f" select cast(k as integer) as k, {_mean()} from d group by k")
def time_permutation_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = {(i * 37 + 11) % 64: i for i in range(64)}
    moved = embeddings(spark, sf_dir).withColumn("series", arrays.permute(F.col("series"), [place[t] for t in range(64)]))
    return aggregates.mean_spectrum(moved).select("k", rounded("mean").alias("mean"))


_LANES = "lanes as (select vec_id, label, t // 32 as feature, t % 32 as t, v from s)"


def lanes(df: DataFrame) -> DataFrame:
    """Two features of 32 steps a sample: the halves of its series."""
    return df.select("vec_id", "label", F.posexplode(arrays.halves(F.col("series"), 32)).alias("feature", "series"))


@query(
    f"with {SERIES_SQL}, {_LANES}, {rfft_sql('lanes', 32, 'vec_id, feature', 'df')}, m as (select vec_id, t, avg(v) as v from lanes group by vec_id, t), {rfft_sql('m', 32, 'vec_id', 'dm')} "
    f"select 'per_feature' as variant, cast(k as integer) as k, {_mean()} from df group by k union all select 'feature_mean', cast(k as integer), {_mean()} from dm group by k"
)
def layout_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lanes(embeddings(spark, sf_dir))
    a = aggregates.mean_spectrum(split).withColumn("variant", F.lit("per_feature"))
    b = aggregates.mean_spectrum(aggregates.feature_mean(split, "vec_id")).withColumn("variant", F.lit("feature_mean"))
    return a.unionByName(b).select("variant", "k", rounded("mean").alias("mean"))


@query(f"with {SERIES_SQL}, {_LANES}, {rfft_sql('lanes', 32, 'vec_id, feature')} select cast(feature as integer) as feature, cast(k as integer) as k, {_mean()}, round(stddev_pop(m), 6) + 0.0 as std from d group by feature, k")
def dim_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.position_stats(lanes(embeddings(spark, sf_dir)), ["feature"], transforms.rfft_magnitude(F.col("series")))
    return found.select("feature", "k", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query("select 0.0::double as max_abs, 0.0::double as l2, count(*) * 33 as n from embeddings")
def fft_selfcheck_maxdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Arrow transform against a relational one: products with a broadcast basis, summed per frequency."""
    df = embeddings(spark, sf_dir)
    basis = spark.range(33 * 64).select((F.col("id") % 33).cast("int").alias("k"), (F.col("id") / 33).cast("int").alias("t"))
    angle = 2 * F.pi() * ((F.col("k") * F.col("t")) % 64) / 64
    basis = basis.select("k", "t", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    long = df.select("vec_id", F.posexplode("series").alias("t", "v")).join(F.broadcast(basis), "t")
    manual = long.groupBy("vec_id", "k").agg((F.sqrt(F.pow(F.sum(F.col("v") * F.col("c")), 2) + F.pow(F.sum(F.col("v") * F.col("s")), 2)) / 8).alias("a"))
    fast = df.select("vec_id", F.posexplode(transforms.rfft_magnitude(F.col("series"))).alias("k", "b"))
    gap = manual.join(fast, ["vec_id", "k"]).select((F.col("a") - F.col("b")).alias("d"))
    return gap.agg(rounded(F.max(F.abs("d"))).alias("max_abs"), rounded(F.sqrt(F.sum(F.col("d") * F.col("d")))).alias("l2"), F.count("*").alias("n"))


# bands

_BANDS8 = "b as (select i as band, i * 4 as lo, i * 4 + 4 as hi from (select unnest(range(0, 8)) as i))"


@query("with k as (select unnest(range(0, 33)) as k), " + _BANDS8 + " select cast(k as integer) as k, count(band) as n_bands, case count(band) when 0 then 'unused' when 1 then 'single' else 'overlap' end as state from k left join b on k >= lo and k < hi group by k")
def band_layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.describe(spark, bands.equal_width(33, 4), 33)


@query(MAGNITUDE + ", " + _BANDS8 + f" select label, cast(band as integer) as band, {_mean()} from d join b on k >= lo and k < hi group by label, band")
def band_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.band_means(embeddings(spark, sf_dir), ["label"], bands.equal_width(33, 4), transforms.rfft_magnitude(F.col("series")))
    return found.groupBy("label", "band").agg(rounded(F.avg("value")).alias("mean"))


_LOG5 = "b as (select * from (values (0, 0, 1), (1, 1, 2), (2, 2, 5), (3, 5, 17), (4, 17, 64)) v(band, lo, hi))"


@query(COSINES + ", " + _LOG5 + ", e as (select label, vec_id, band, sqrt(avg(m * m)) as e from d join b on k >= lo and k < hi group by all) select label, cast(band as integer) as band, round(avg(e), 6) as energy from e group by label, band")
def band_rms_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.band_means(embeddings(spark, sf_dir), ["label"], bands.NAMED["log5_of_64"], transforms.dct(F.col("series")), rms=True)
    return found.groupBy("label", "band").agg(rounded(F.avg("value")).alias("energy"))


@query(MAGNITUDE + f", b as (select i as band, i * 6 as lo, case when i = 4 then 33 else i * 6 + 6 end as hi from (select unnest(range(0, 5)) as i)) select cast(band as integer) as band, {_mean()} from d join b on k >= lo and k < hi group by band")
def band_absorb_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.mean_spectrum(embeddings(spark, sf_dir))
    layout = F.broadcast(bands.layout_frame(spark, bands.equal_count(33, 5)))
    return found.join(layout, (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi"))).groupBy("band").agg(rounded(F.avg("mean")).alias("mean"))


def _bank_sql(bank) -> str:
    rows = ", ".join(f"({i}, {k}, {float(w)!r}::double)" for i, r in enumerate(bank) for k, w in enumerate(r) if w)
    return f", f as (select * from (values {rows}) v(filter, k, w)) select label, cast(filter as integer) as filter, round(avg(x), 6) + 0.0 as mean from (select vec_id, label, filter, sum(m * w) as x from d join f using (k) group by all) group by label, filter"


def _banked(spark: SparkSession, sf_dir: str, bank) -> DataFrame:
    sums = transforms.filter_bank(transforms.dct(F.col("series")), bank)
    return embeddings(spark, sf_dir).select("label", F.posexplode(sums).alias("filter", "x")).groupBy("label", "filter").agg(rounded(F.avg("x")).alias("mean"))


@query(COSINES + _bank_sql(bands.log_filter_bank(64)))
def log_filterbank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banked(spark, sf_dir, bands.log_filter_bank(64))


@query(COSINES + _bank_sql(bands.mel_filter_bank(64)))
def mel_filterbank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _banked(spark, sf_dir, bands.mel_filter_bank(64))


@query("select cast(band as integer) as band, cast(lo as integer) as lo, cast(hi as integer) as hi from (values (0, 0, 103), (1, 102, 204), (2, 204, 306), (3, 306, 408), (4, 408, 511)) v(band, lo, hi)")
def eqalloc_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.layout_frame(spark, bands.allocated(512, 5, exact=False))


@query(COSINES + ", x as (select vec_id, t, sum(m * cos(pi() * (2 * t + 1) * k / 128) * case when k = 0 then sqrt(1.0::double / 64) else sqrt(2.0::double / 64) end) as v from (select * from d where k between 2 and 9), (select unnest(range(0, 64)) as t) group by all) select vec_id, round(sum(v * v), 6) as energy, round(sum(v), 6) + 0.0 as total from x group by vec_id")
def band_filter_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = transforms.frequency_filter(F.col("series"), bands.parse_filter("band(64, 2, 9)"))
    fold = lambda g: F.aggregate("kept", F.lit(0.0), lambda a, x: a + g(x))
    return embeddings(spark, sf_dir).select("vec_id", kept.alias("kept")).select("vec_id", rounded(fold(lambda x: x * x)).alias("energy"), rounded(fold(lambda x: x)).alias("total"))


# statistics, ranks, samples


@query("select label, count(*) as n from embeddings group by label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("with " + SERIES_SQL + f" select label, {_mean('v')}, round(stddev_pop(v), 6) as std, round(min(v), 6) + 0.0 as min, round(max(v), 6) + 0.0 as max, count(*) as n from s group by label")
def value_stats_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.value_stats(embeddings(spark, sf_dir), ["label"])
    return found.select("label", *(rounded(c).alias(c) for c in ("mean", "std", "min", "max")), "n")


@query(MAGNITUDE + ", g as (select k, avg(m) as a from d group by k) select cast(k as integer) as k, round(a, 6) as mean from g order by a desc, k desc limit 3")
def topk_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(aggregates.mean_spectrum(embeddings(spark, sf_dir)), "mean", "k", 3).select("k", rounded("mean").alias("mean"))


@query(MAGNITUDE + ", e as (select vec_id, sqrt(sum(m * m)) as e from d group by vec_id), r as (select vec_id, e, row_number() over (order by round(e, 9) desc, vec_id) as hi, row_number() over (order by round(e, 9), vec_id) as lo from e) select vec_id, round(e, 6) as energy, case when hi <= 3 then 'strong' else 'weak' end as side from r where hi <= 3 or lo <= 3")
def strong_weak_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(transforms.rfft_magnitude(F.col("series")), F.lit(0.0), lambda a, x: a + x * x))
    e = embeddings(spark, sf_dir).select("vec_id", norm.alias("e"))
    strong = e.orderBy(F.desc(F.round("e", 9)), "vec_id").limit(3).withColumn("side", F.lit("strong"))
    weak = e.orderBy(F.round("e", 9), "vec_id").limit(3).withColumn("side", F.lit("weak"))
    return strong.unionByName(weak).select("vec_id", rounded("e").alias("energy"), "side")


@query(
    MAGNITUDE + ", p as (select vec_id, avg(m) as energy from d where k in (4, 8, 16) group by vec_id), b as (select l_suppkey as vec_id, avg(l_quantity) as bpm from lineitem group by 1), j as (select p.vec_id, energy, bpm from p join b using (vec_id)) "
    "select round(case when count(*) >= 10 then corr(energy, bpm) end, 6) as r, count(*) as n from j"
)
def peak_energy_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = F.array(*(F.element_at("m", k + 1) for k in (4, 8, 16)))
    energy = embeddings(spark, sf_dir).select("vec_id", transforms.rfft_magnitude(F.col("series")).alias("m")).select("vec_id", arrays.mean(peaks).alias("energy"))
    tempo = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("vec_id")).agg(F.avg("l_quantity").alias("bpm"))
    return aggregates.correlation(aggregates.lookup_join(energy, tempo, "vec_id", "bpm"), "energy", "bpm").select(rounded("r").alias("r"), "n")


_HASH = "md5(cast({} as varchar) || '-42')"


@query(f"with r as (select label, row_number() over (partition by label order by {_HASH.format('vec_id')}, vec_id) as r, count(*) over (partition by label) as n from embeddings) select label, count(*) filter (where r <= floor(n * 0.2 + 0.5)) as n_test, count(*) filter (where r > floor(n * 0.2 + 0.5)) as n_train from r group by label")
def stratified_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = ranking.stratified_split(embeddings(spark, sf_dir).select("vec_id", "label"), "label", "vec_id")
    test = F.col("is_test").cast("long")
    return split.groupBy("label").agg(F.sum(test).alias("n_test"), F.sum(1 - test).alias("n_train"))


@query(f"with u as (select distinct user_id from events), r as (select user_id, row_number() over (order by {_HASH.format('user_id')}, user_id) as r, count(*) over () as n from u) select event_type, count(*) filter (where r <= ceil(n * 0.2)) as n_test, count(*) as n from events join r using (user_id) group by event_type")
def group_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = ranking.group_split(table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id")
    return split.groupBy("event_type").agg(F.sum(F.col("is_test").cast("long")).alias("n_test"), F.count("*").alias("n"))


@query(f"select label, vec_id from embeddings qualify row_number() over (partition by label order by {_HASH.format('vec_id')}, vec_id) <= 3")
def sample_n_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sample_per_group(embeddings(spark, sf_dir).select("label", "vec_id"), ["label"], "vec_id", 3)


@query("select label, vec_id from (select label, vec_id from embeddings qualify row_number() over (partition by label order by vec_id) <= 5) order by vec_id limit 20")
def head_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.head_per_group(embeddings(spark, sf_dir).select("label", "vec_id"), ["label"], ["vec_id"], 5, 20)


@query(f"select vec_id from embeddings order by {_HASH.format('vec_id')}, vec_id limit 25")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sample(embeddings(spark, sf_dir).select("vec_id"), "vec_id", 25)


@query("select vec_id, (row_number() over (order by vec_id) - 1) // 32 as batch from embeddings")
def sequential_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.batches(embeddings(spark, sf_dir).select("vec_id"), "vec_id", 32)


@query(f"select vec_id, (row_number() over (order by {_HASH.format('vec_id')}, vec_id) - 1) // 32 as batch from embeddings")
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.batches(embeddings(spark, sf_dir).select("vec_id"), "vec_id", 32, seed=42)


# series built from relational tables

# 32 buckets of equal width from the first shipment to the last
_SUPPLIED = (
    "r as (select min(cast(l_shipdate as date)) as lo, date_diff('day', min(cast(l_shipdate as date)), max(cast(l_shipdate as date))) // 32 + 1 as width from lineitem), "
    "g as (select l_suppkey as vec_id, {by}date_diff('day', lo, cast(l_shipdate as date)) // width as t, sum(l_quantity) as v from lineitem, r group by all)"
)


def supplied(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each supplier's quantities in 32 buckets of equal width that hold all shipments, zeros included."""
    rows = table(spark, sf_dir, "lineitem")
    ends = rows.agg(F.min(F.to_date("l_shipdate")).alias("lo"), F.max(F.to_date("l_shipdate")).alias("hi")).select("lo", (F.floor(F.datediff("hi", "lo") / 32) + 1).alias("width"))  # one row
    dated = rows.crossJoin(F.broadcast(ends)).withColumn("t", F.floor(F.datediff("l_shipdate", "lo") / F.col("width")).cast("int"))
    return long_series(dated.select(F.col("l_suppkey").alias("vec_id"), *by, "t", "l_quantity"), "vec_id", "t", "l_quantity", 32, by)


@query(f"with {_SUPPLIED.format(by='')}, {rfft_sql('g', 32, 'vec_id')} select cast(k as integer) as k, round(avg(m), 4) as mean from d group by k")
def lineitem_supplier_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mean_spectrum(supplied(spark, sf_dir)).select("k", rounded("mean", 4).alias("mean"))


@query(
    f"with {_SUPPLIED.format(by='l_returnflag, ')}, {rfft_sql('g', 32, 'vec_id, l_returnflag')}, b as (select i as band, i * 4 as lo, i * 4 + 4 as hi from (select unnest(range(0, 4)) as i)) "
    "select l_returnflag, cast(band as integer) as band, round(avg(m), 4) as mean from d join b on k >= lo and k < hi group by all"
)
def lineitem_band_energy_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.band_means(supplied(spark, sf_dir, ("l_returnflag",)), ["l_returnflag"], bands.equal_width(17, 4), transforms.rfft_magnitude(F.col("series")))
    return found.groupBy("l_returnflag", "band").agg(rounded(F.avg("value"), 4).alias("mean"))


@query(
    "with e as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t, value as v from events), c as (select user_id, t, v - avg(v) over (partition by user_id) as v from e), "
    "r as (select a.user_id, b.t - a.t as lag, sum(a.v * b.v) as r, count(*) as n from c a join c b on a.user_id = b.user_id and b.t between a.t and a.t + 8 group by all) select cast(r.lag as integer) as lag, round(avg(case when o.r <= 1e-12 * o.n then 0 else r.r / o.r end), 6) + 0.0 as rho from r join r o on o.user_id = r.user_id and o.lag = 0 group by r.lag"
)
def events_user_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's whole series of values; a series is one user's events, so it fits a row."""
    series = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("series"))
    return aggregates.autocorrelation_curves(series, 8).select("lag", rounded("rho").alias("rho"))


@query(_RHO.replace("z as (", "z0 as (").rstrip() + ", z as (select case when label % 2 = 0 then 'a' else 'b' end as model, lag, rho from z0 where lag <= case when label % 2 = 0 then 16 else 12 end) select model, cast(lag as integer) as lag, round(avg(rho), 6) + 0.0 as rho from z where lag <= 12 group by model, lag")
def compare_model_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    a = aggregates.autocorrelation_curves(df.where("label % 2 = 0"), 16).withColumn("model", F.lit("a"))
    b = aggregates.autocorrelation_curves(df.where("label % 2 = 1"), 12).withColumn("model", F.lit("b"))
    return aggregates.aligned_curves(a.unionByName(b)).select("model", "lag", rounded("rho").alias("rho"))


@query(MAGNITUDE + ", n as (select vec_id, k, m / (sqrt(sum(m * m) over (partition by vec_id)) + 1e-8) as v, sqrt(sum(m * m) over (partition by vec_id)) as e from d) select vec_id, cast(k as integer) as k, round(v, 6) as v, round(e, 6) as energy from n")
def heatmap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra divided by their norms, with the raw norm to rank them by."""
    m = embeddings(spark, sf_dir).select("vec_id", transforms.rfft_magnitude(F.col("series")).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return m.withColumn("e", norm).select("vec_id", F.posexplode("m").alias("k", "v"), "e").select("vec_id", "k", rounded(F.col("v") / (F.col("e") + 1e-8)).alias("v"), rounded("e").alias("energy"))


_TAPS = "(2.0 / 3) * case when t = 0 then 1 else sin(pi() * 2 * t / 3) / (pi() * 2 * t / 3) end * (0.5 + 0.5 * cos(pi() * t / 24))"


@query(
    f"with {SERIES_SQL}, j as (select unnest(range(0, 43)) as j), p as (select vec_id, j, v, cast(j * 1.5 - t as double) as t from s, j where abs(j * 1.5 - t) < 24) "
    f"select vec_id, cast(j as integer) as t, round(sum(v * {_TAPS}), 6) + 0.0 as v from p group by vec_id, j"
)
def series_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series at two thirds of their rate."""
    found = embeddings(spark, sf_dir).select("vec_id", F.posexplode(audio.resample(F.col("series"), 3, 2)).alias("t", "v"))
    return found.withColumn("v", rounded("v"))


@query(
    f"with {SERIES_SQL}, {dct_sql()}, parts as (select vec_id, cast(1 + k // 16 as integer) as band, t, sum(m * cos(pi() * (2 * t + 1) * k / 128) * case when k = 0 then sqrt(cast(1.0 / 64 as double)) else sqrt(cast(2.0 / 64 as double)) end) as v from d, (select unnest(range(0, 64)) as t) group by all) "
    "select vec_id, 0 as band, cast(t as integer) as token, round(v, 6) + 0.0 as value from s union all select vec_id, band, cast(t as integer), round(v, 6) + 0.0 from parts"
)
def series_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series and their parts in four bands, step by step."""
    found = aggregates.band_decomposition(embeddings(spark, sf_dir).select("vec_id", F.array("series").alias("x")), ["vec_id"], "x", 4)
    return found.select("vec_id", "band", "token", rounded("value").alias("value"))


@query(
    "with s as (select vec_id, f, t, v from (select vec_id, unnest(range(0, 64)) // 16 as f, unnest(range(0, 64)) % 16 as t, cast(unnest(embedding) as double) as v from embeddings)), "
    + rfft_sql("s", 16, "vec_id, f")
    + ", e as (select vec_id, row_number() over (order by sum(m * m) desc, vec_id) as rank from d group by vec_id) "
    "select 'sample' as axis, cast(rank as bigint) as at, cast(k as integer) as k, round(avg(m), 6) + 0.0 as value from d join e using (vec_id) group by all union all select 'dimension', cast(f as bigint), cast(k as integer), round(avg(m), 6) + 0.0 from d where f % 2 = 0 group by all"
)
def spectrum_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean spectra by sample, ranked by energy, and by every second dimension."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("series", i * 16 + 1, F.lit(16)))
    rows = embeddings(spark, sf_dir).select("vec_id", F.posexplode(parts).alias("f", "x"))
    return aggregates.spectrum_surfaces(rows, "vec_id", "f", "x", dim_step=2).withColumn("value", rounded("value"))
