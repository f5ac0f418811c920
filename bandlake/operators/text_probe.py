"""Text probes: encode, filter over token frequencies, pool, classify, predict; and fitted probes kept in a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.functions import arrays, bands, transforms
from bandlake.functions.subwords import pieces
from bandlake.operators import corpus, encoding, metrics, probes, training
from bandlake.operators.ranking import hash_order
from bandlake.session import stored

#: An encoder by name makes dimension-major series (array<array<double>>) of an array of words; sub-word encoders are objects (encoding.PieceEncoder).
ENCODERS: dict[str, Callable[[Column], Column]] = {"hashed": lambda tokens: corpus.hashed_embedding(tokens, 8)}
POOLINGS: dict[str, Callable[[Column], Column]] = {"mean": arrays.mean}
CLASSIFIERS = ("linear",)
SCORES = ("accuracy", "macro_f1", "weighted_f1")


def register_encoder(name: str, f: Callable[[Column], Column]) -> None:
    """Any language model behind an Arrow function; texts of a pair come as one array with '[SEP]' between them."""
    ENCODERS[name] = f


def tokens_of(texts: Column, limit: int | None = None) -> Column:
    """Words of one text or of a pair, lower-cased, with a separator between the two; a limit cuts the sequence as a model of that length would."""
    words = F.filter(F.split(F.lower(F.array_join(texts, " [SEP] ")), " "), lambda w: w != "")
    return F.slice(words, 1, limit) if limit else words


def encode(df: DataFrame, encoder="hashed", filter_text: str = "nofilter()", pooling: str | None = None, limit: int | None = None, cache: encoding.EncodingCache | None = None) -> DataFrame:
    """df (id, texts, labels, level) with `features`, an array of series (one a dimension). Separators, begins and ends go, unless the series are pooled: then each is one value. A learnt filter
    comes before the pooling, so `pooled_from` says of how many values each is the mean: training.train filters it as it does the mean of so many.

    encoder is a registered name, or an object that adds `pieces` and `features` (encoding.PieceEncoder), whose encodings a cache may keep; the labels of a corpus labelled by token are then
    those of the words, one a piece. Every row stays, whatever its id; texts without tokens have empty series.
    """
    if isinstance(encoder, str) and encoder not in ENCODERS:
        raise ValueError(f"unknown encoder {encoder!r}: one of {sorted(ENCODERS)}")
    if pooling is not None and pooling not in POOLINGS:
        raise ValueError(f"unknown pooling {pooling!r}: one of {sorted(POOLINGS)}")
    kept = df.columns
    if isinstance(encoder, str):
        tokens = tokens_of(F.col("texts"), limit)
        if pooling is None:
            tokens = F.filter(tokens, lambda t: t != "[SEP]")
        rows = df.withColumn("_tokens", tokens).withColumn("features", ENCODERS[encoder](F.col("_tokens")))
    else:
        rows = cache.encode(df, encoder, limit) if cache else encoder.rows(df, limit)
        rows = encoding.content(rows, specials=pooling is not None)
        if pooling is None:
            by_piece = encoding.piece_labels(F.col("labels"), F.col("pieces.word"), F.col("pieces.text"))
            rows = rows.withColumn("labels", F.when(F.col("level") == "token", by_piece).otherwise(F.col("labels")))
    rows = rows.select(*kept, "features")
    weights = bands.parse_filter(filter_text)
    auto = filter_text.strip().lower().startswith("auto")
    if weights is not None and not auto:
        rows = rows.withColumn("features", transforms.filter_lanes(F.col("features"), weights))
    if pooling is not None:
        if auto:
            rows = rows.withColumn(training.POOLED, _length(F.col("features")))
        pooled = F.transform("features", lambda x: F.array(POOLINGS[pooling](x)))
        rows = rows.withColumn("features", F.when(_length(F.col("features")) > 0, pooled).otherwise(F.col("features")))
    return rows


def piece_rows(df: DataFrame, encoder: encoding.PieceEncoder, limit: int | None = None) -> DataFrame:
    """df (id, texts, labels, level) for training.train with the same encoder: `pieces` (ids and special) instead of the texts, and labels as encode() gives them. Tasks make the series of the pieces."""
    found = df.withColumn("pieces", pieces(F.col("texts"), encoder.vocabulary, limit))
    inner = F.filter(F.arrays_zip("pieces.word", "pieces.text", "pieces.special"), lambda x: ~x["special"])
    by_piece = encoding.piece_labels(F.col("labels"), F.transform(inner, lambda x: x["word"]), F.transform(inner, lambda x: x["text"]))
    found = found.withColumn("labels", F.when(F.col("level") == "token", by_piece).otherwise(F.col("labels")))
    return found.drop("texts").withColumn("pieces", F.struct("pieces.ids", "pieces.special"))


def _length(features: Column) -> Column:
    return F.coalesce(F.size(F.get(features, 0)), F.lit(0))


def token_rows(encoded: DataFrame) -> DataFrame:
    """Encoded rows (or piece_rows) with one label a token: those of a corpus labelled by token as they are, else the text's label for each. Rows labelled by token whose numbers differ are an error."""
    n = _length(F.col("features")) if "features" in encoded.columns else encoding.kept(F.col("pieces"))
    token = F.col("level") == "token"
    bad = encoded.where(token & (n > 0) & ~F.coalesce(F.size("labels") == n, F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} texts have other numbers of labels than of tokens")
    return encoded.where(n > 0).withColumn("labels", F.when(token, F.col("labels")).otherwise(F.array_repeat(F.get("labels", 0), n)))


def _flat(encoded: DataFrame) -> DataFrame:
    """One row a labelled vector: a token of a token-level corpus, else the whole text (the mean of its tokens)."""
    rows = token_rows(encoded)
    token = F.col("level") == "token"
    steps = F.when(token, arrays.transpose(F.col("features"))).otherwise(F.array(F.transform("features", arrays.mean)))
    labels = F.when(token, F.col("labels")).otherwise(F.slice("labels", 1, 1))
    long = rows.select("id", F.posexplode(F.arrays_zip(labels.alias("l"), steps.alias("x"))).alias("place", "_r"))
    return long.select("id", "place", F.col("_r.l").cast("string").alias("label"), F.col("_r.x").alias("features")).where("label is not null")


def _token_results(said: DataFrame) -> DataFrame:
    long = said.select("id", F.posexplode(F.arrays_zip(F.col("labels").alias("l"), F.col("predicted").alias("p"))).alias("place", "_r"))
    return long.select("id", "place", F.col("_r.l").cast("string").alias("label"), F.col("_r.p").alias("prediction"))


def text_probe(train: DataFrame, valid: DataFrame, filter_text: str = "nofilter()", classifier: str = "linear", encoder="hashed", pooling: str | None = None, repeats: int = 1, seed: int = 42, solver: str = "convex", cache: encoding.EncodingCache | None = None, **loop) -> tuple[DataFrame, DataFrame]:
    """(metrics, predictions) of a linear classifier on filtered encodings: corpora of (id, texts, labels, level).

    metrics has accuracy, macro_f1 and weighted_f1 on the validation corpus; predictions has id, place, label and prediction. auto(size) learns the filter
    together with the classifier. The solver `convex` finds the best weights whatever the seed, and with repeats draws the rows again by other seeds (four fifths of the texts each time), a run a
    row. The solver `adam` is training.train with the options `loop` (epochs, batches, rate, decay, early_stop, path, resume): every run starts from other weights and mini-batches, by seed, and
    texts that aren't labelled by token give their label to each token. Texts without tokens have no predictions.
    """
    if classifier not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {classifier!r}: one of {sorted(CLASSIFIERS)}")
    if solver not in ("convex", "adam"):
        raise ValueError(f"unknown solver {solver!r}: convex or adam")
    missing = corpus.label_gaps(train, valid)
    if gap := missing.take(1):
        raise ValueError(f"label {gap[0]['label']!r} is not in the training corpus")
    learnt, check = (encode(c, encoder, filter_text, pooling, cache=cache) for c in (train, valid))
    return probe_encoded(learnt, check, filter_text, repeats, seed, solver, **loop)


def probe_encoded(learnt: DataFrame, check: DataFrame, filter_text: str = "nofilter()", repeats: int = 1, seed: int = 42, solver: str = "convex", **loop) -> tuple[DataFrame, DataFrame]:
    """text_probe of corpora that are encoded."""
    auto = filter_text.strip().lower().startswith("auto")
    size = len(bands.parse_filter(filter_text)) if auto else 0
    scored, said = None, None
    for run in range(repeats):
        if solver == "adam":
            path = loop.get("path")
            own = loop | {"path": f"{path}/run={run}" if path and repeats > 1 else path}
            rows, watched = token_rows(learnt), token_rows(check)
            _, best = training.train(rows, watched, filter_size=size, seed=seed + run, **own)
            found = _token_results(training.predict(watched, best)).where("label is not null")
        else:
            some = learnt if repeats == 1 else learnt.where(F.conv(F.substring(hash_order("id", seed + run), 1, 8), 16, 10).cast("double") < 0.8 * 2**32)
            if auto:
                logits, weights, classes, _ = training.learn_filter(token_rows(some), size)
                found = _token_results(training.label_tokens(token_rows(check), logits, weights, classes)).where("label is not null")
            else:
                both = _flat(some).withColumn("is_test", F.lit(False)).unionByName(_flat(check).withColumn("is_test", F.lit(True)))
                width = both.select(F.size("features")).first()
                fitted = probes.fit_probes(both, [probes.Probe("all", None, ((0, width[0] if width else 0),))], balanced=False)
                found = probes.predictions(both, fitted, ["id", "place"]).drop("probe")
        found = stored(found.withColumn("run", F.lit(run)), "predictions")
        each = metrics.scores(metrics.confusion(found, "label", "prediction")).withColumn("run", F.lit(run))
        scored = each if scored is None else scored.unionByName(each)
        said = found if said is None else said.unionByName(found)
    return scored, said


def save_fitted(spark: SparkSession, fitted: probes.Fitted, path: str) -> None:
    """A fitted set of probes as a table: a row a probe, with the scaling in each."""
    rows = [(p.name, p.target, [list(r) for r in p.ranges], p.width, p.n_features, w.tolist(), fitted.mean.tolist(), fitted.scale.tolist(), fitted.classes) for p, w in zip(fitted.probes, fitted.weights, strict=True)]
    shape = "name string, target string, ranges array<array<int>>, width int, n_features int, weights array<array<double>>, mean array<double>, scale array<double>, classes array<string>"
    spark.createDataFrame(rows, shape).write.mode("overwrite").parquet(path)


def load_fitted(spark: SparkSession, path: str) -> probes.Fitted:
    rows = spark.read.parquet(path).orderBy("name").collect()
    if not rows:
        return probes.Fitted([], [], np.zeros(0), np.ones(0))
    found = [probes.Probe(r["name"], r["target"], tuple(map(tuple, r["ranges"])), r["width"], r["n_features"]) for r in rows]
    return probes.Fitted(found, [np.array(r["weights"]) for r in rows], np.array(rows[0]["mean"]), np.array(rows[0]["scale"]), classes=list(rows[0]["classes"]))


def run_tasks(tasks: dict[str, tuple[DataFrame, DataFrame]], filters: Sequence[str], seeds: Sequence[int] = (42,), solver: str = "adam", parallel: int = 4, path: str | None = None, encoder="hashed", pooling: str | None = None, **loop) -> DataFrame:
    """Scores of every task (a train and a validation corpus), filter and seed: task, filter, seed, accuracy, macro_f1, weighted_f1, and of each score its mean and deviation over the seeds of the
    task and filter (accuracy_mean, accuracy_std, ...).

    A task is encoded once a filter, for all seeds, and `parallel` runs go at a time. With a path each run keeps its states there and its scores once it is done; runs whose scores are there aren't run again.
    """
    spark = next(iter(tasks.values()))[0].sparkSession
    shape = "task string, filter string, seed int, accuracy double, macro_f1 double, weighted_f1 double"

    def folder(name: str, text: str, seed: int) -> str:
        return "/".join([path, *(x.translate(str.maketrans(" /", "__")) for x in (name, text)), str(seed)])

    def one(name: str, text: str, seed: int, learnt: DataFrame, check: DataFrame) -> tuple:
        done = folder(name, text, seed) + "/scores" if path else None
        if done and _there(spark, f"{done}/_SUCCESS"):
            return tuple(spark.read.schema(shape).json(done).first())
        own = loop | ({"path": folder(name, text, seed) + "/states", "resume": True} if path and solver == "adam" else {})
        r = probe_encoded(learnt, check, text, 1, seed, solver, **own)[0].first()
        row = (name, text, seed, r["accuracy"], r["macro_f1"], r["weighted_f1"])
        if done:
            spark.createDataFrame([row], shape).coalesce(1).write.mode("overwrite").json(done)
        return row

    jobs = []
    for name, (train, valid) in tasks.items():
        for text in filters:
            wanted = [s for s in seeds if not (path and _there(spark, folder(name, text, s) + "/scores/_SUCCESS"))]
            learnt, check = (stored(encode(c, encoder, text, pooling), "encoded") if wanted else c for c in (train, valid))
            jobs += [(name, text, s, learnt, check) for s in seeds]
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        rows = list(pool.map(lambda j: one(*j), jobs))
    return over_seeds(spark.createDataFrame(rows, shape))


def over_seeds(found: DataFrame) -> DataFrame:
    """Scores of runs with their means and population deviations over the seeds of each task and filter."""
    by = ["task", "filter"]
    for score in SCORES:
        each = metrics.across_runs(found, by, score).select(*by, F.col("mean").alias(f"{score}_mean"), F.col("std").alias(f"{score}_std"))
        found = found.join(F.broadcast(each), by)
    return found


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
