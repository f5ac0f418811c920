"""Labelled text corpora: (id, texts, labels, level) tables, converters, negatives, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandlake.functions import text as T
from bandlake.operators import metrics
from bandlake.operators.ranking import _joined, hash_order, hashed_rank


def labelled(df: DataFrame, id_col: str, text_cols: list[str], label_col: str) -> DataFrame:
    """id, texts, labels, level. If any label has a space the corpus is labelled by token; else by text. Several text columns
    make a multiple corpus."""
    token = F.max(F.col(label_col).contains(" ")).alias("_token")
    flags = df.agg(token)
    level = F.when(F.col("_token"), "token").when(F.lit(len(text_cols) > 1), "multiple").otherwise("sequence")
    labels = F.when(F.col("_token"), F.split(label_col, " ")).otherwise(F.array(label_col))
    return df.crossJoin(F.broadcast(flags)).select(F.col(id_col).alias("id"), F.array(*text_cols).alias("texts"), labels.alias("labels"), F.coalesce(level, F.lit("sequence")).alias("level"))


def label_types(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def label_gaps(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Labels of the validation corpus that the training corpus lacks."""
    return label_types(valid).select("label").exceptAll(label_types(train).select("label"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn with the turn after it: conv_id, turn, text0, text1, label (the second role)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    found = conversations.select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("text1"), F.lead("role").over(w).alias("label"))
    return found.where("role = 'user' and text1 is not null").select("conv_id", "turn", F.col("text").alias("text0"), "text1", "label")


def negatives(df: DataFrame, id_col: str, group: str, text: str, n: int, seed: int = 42) -> DataFrame:
    """For each row, n rows of its group with other texts: id, negative_id, rank.

    The distinct texts of a group, each with its smallest id, stand in hash order, and a row takes those that follow its own text in the circle, so the work is
    rows x n, not pairs of a group, and only a group of n texts or fewer gives fewer. Rows without text take no part; a null group is a group.
    """
    some = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(text).alias("t"))
    texts = some.groupBy("g", "t").agg(F.min("id").alias("id"))
    placed = hashed_rank(texts, ["g"], "id", seed).select("g", "t", F.col("id").alias("own"), (F.col("rank") - 1).alias("at"), F.col("group_size").alias("size"))
    follow = placed.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(n)))).where("rank < size").withColumn("to", F.expr("(at + rank) % size"))
    other = placed.select("g", F.col("at").alias("to"), F.col("own").alias("negative_id"))
    chosen = _joined(follow, other, ["g", "to"]).select("g", "t", "rank", "negative_id")
    return _joined(some, chosen, ["g", "t"]).select("id", "negative_id", "rank")


def repeat_labels(df: DataFrame, words: Column, labels: Column, pieces: int, keys: list[str]) -> DataFrame:
    """Sub-word pieces of `pieces` characters, each with its word's label: keys, word, piece, text, label."""
    each = df.select(*keys, F.posexplode(F.arrays_zip(words.alias("w"), labels.alias("l"))).alias("word", "x"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("x.w") - 1) / pieces).cast("int"))), lambda i: F.substring(F.col("x.w"), i * pieces + 1, F.lit(pieces)))
    return each.select(*keys, "word", F.col("x.l").alias("label"), F.posexplode(cut).alias("piece", "text"))


def evaluate(truth: DataFrame, predicted: DataFrame, id_col: str = "id", labels: str = "labels") -> DataFrame:
    """Accuracy and F1 of label arrays: a single true label stands for all predicted ones, else lengths must agree (rows that
    don't are counted in n_bad and left out)."""
    both = truth.select(id_col, F.col(labels).alias("a")).join(predicted.select(id_col, F.col(labels).alias("b")), id_col)
    both = both.withColumn("a", F.when((F.size("a") == 1) & (F.size("b") > 1), F.array_repeat(F.element_at("a", 1), F.size("b"))).otherwise(F.col("a")))
    pairs = both.where("size(a) = size(b)").select(F.explode(F.arrays_zip("a", "b")).alias("x")).select(F.col("x.a").alias("t"), F.col("x.b").alias("p"))
    bad = both.agg(F.sum((F.size("a") != F.size("b")).cast("long")).alias("n_bad"))
    return metrics.scores(metrics.confusion(pairs, "t", "p")).crossJoin(bad)


def hashed_embedding(tokens: Column, dims: int) -> Column:
    """Dim-major series of a token sequence: a stand-in for a language model (each token's md5 gives its values in [-1, 1))."""
    return F.array(*(_dimension(tokens, d) for d in range(dims)))


def _dimension(tokens: Column, d: int) -> Column:
    return F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(F.concat(t, F.lit(f"#{d}"))), 1, 8), 16, 10).cast("double") / 2147483648.0) - 1.0)


# converters


def convert_newsgroups(files: DataFrame, dev_share: float = 0.2, seed: int = 42) -> DataFrame:
    """(path, content) of a tree split/class/number as id, text, label, split (train, dev, test)."""
    path = F.split("path", "/")
    rows = files.select(F.element_at(path, -1).alias("name"), F.element_at(path, -2).alias("label"), F.element_at(path, -3).alias("tree"), F.decode("content", "ISO-8859-1").alias("text")).where(F.col("name").rlike(r"^\d+"))
    rows = rows.withColumn("id", F.concat_ws("/", "tree", "label", "name"))
    ranked = hashed_rank(rows, ["tree"], "id", seed)
    split = F.when(F.col("tree").endswith("-test"), "test").when(F.col("rank") <= F.floor(F.col("group_size") * dev_share + 0.5), "dev").otherwise("train")
    return ranked.select("id", "text", "label", split.alias("split"))


def convert_reviews(df: DataFrame) -> DataFrame:
    """Reviews in two label views: text, view (sentiment, topic), label and the columns lang and split."""
    views = F.array(F.struct(F.lit("sentiment").alias("view"), T.sentiment(F.col("stars")).alias("label")), F.struct(F.lit("topic").alias("view"), F.col("product_category").alias("label")))
    return df.select("lang", "split", F.col("review_body").alias("text"), F.inline(views))


def convert_inference(df: DataFrame) -> DataFrame:
    return df.select(F.col("premise").alias("text0"), F.col("hypothesis").alias("text1"), T.inference_label(F.col("label")).alias("label"))


#: The languages and splits of the multilingual inference corpus.
INFERENCE_LANGUAGES, INFERENCE_SPLITS = ("de", "en", "es", "fr", "zh"), {"train": "train", "validation": "dev", "test": "test"}


def convert_inference_layout(df: DataFrame, languages: tuple[str, ...] = INFERENCE_LANGUAGES) -> DataFrame:
    """Rows (lang, split, premise, hypothesis, label) of the languages as lang, split (train, dev, test), text0, text1, label: what write_corpus puts into a folder a language and split.
    A row without a premise, hypothesis or known label, or of another split, is an error."""
    names = F.create_map(*(F.lit(x) for pair in INFERENCE_SPLITS.items() for x in pair))
    rows = df.where(F.col("lang").isin(*languages)).withColumn("_split", F.try_element_at(names, F.col("split")))
    found = rows.select("lang", F.col("_split").alias("split"), F.col("premise").alias("text0"), F.col("hypothesis").alias("text1"), T.inference_label(F.col("label")).alias("label"))
    return complete(found, ["split", "text0", "text1", "label"])


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, whose rows all have a value in each of the columns: any others are counted and are an error."""
    lacking = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns)).first().asDict()
    if bad := {c: n for c, n in lacking.items() if n}:
        raise ValueError(f"rows without a value: {bad}")
    return df


def convert_parses(lines: DataFrame, column: str = "value") -> DataFrame:
    words, tags = T.treebank_tokens(F.col(column))
    return lines.where(F.length(F.trim(column)) > 0).select(F.array_join(words, " ").alias("text"), F.array_join(tags, " ").alias("label"))


def convert_dependencies(sentences: DataFrame, relations: bool = True) -> DataFrame:
    """Sentences (words, relations, tags) as text and label: base relations or tags; spaces within words go."""
    label = F.transform("relations", T.base_relation) if relations else F.col("tags")
    return sentences.select(F.array_join(F.transform("words", lambda w: F.replace(w, F.lit(" "), F.lit(""))), " ").alias("text"), F.array_join(label, " ").alias("label"))


def convert_entities(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("tokens", " ").alias("text"), F.array_join(T.entity_tags(F.col("ner_tags")), " ").alias("label"))


def convert_questions(df: DataFrame, n_incorrect: int = 1, dev_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Questions (id, queries map, answers map of (type, text)) as pairs: lang, split, text0, text1, label 1 (correct) or 0. Negatives and
    the split are chosen once, by id, and are the same for every language; pairs with a missing text are left out."""
    base = df.select("id", F.col("answers")["en"]["type"].alias("type"), F.col("answers")["en"]["text"].alias("text")).where("text is not null")
    wrong = negatives(base, "id", "type", "text", n_incorrect, seed).select("id", "negative_id")
    kept = base.select("id").withColumn("_b", F.substring(hash_order("id", seed), 1, 8))
    share = F.conv("_b", 16, 10).cast("double") / 4294967296.0
    splits = kept.select("id", F.when(share < dev_share, "dev").otherwise("train").alias("split"))
    answers = df.select(F.col("id").alias("answer_id"), F.explode("answers").alias("locale", "answer")).select("answer_id", "locale", F.col("answer.text").alias("text1"))
    pairs = splits.select("id", F.col("id").alias("answer_id"), F.lit("1").alias("label"), "split").unionByName(splits.join(wrong, "id").select("id", F.col("negative_id").alias("answer_id"), F.lit("0").alias("label"), "split"))
    queries = df.select("id", F.explode("queries").alias("locale", "text0"))
    found = pairs.join(queries, "id").join(answers, ["answer_id", "locale"])
    return found.where("text0 is not null and text1 is not null").select(T.language(F.col("locale")).alias("lang"), "split", "text0", "text1", "label", "id")


def convert_tracks(raw: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Flattened track metadata of the small subset with a genre and an existing file: track_id, genre, audio_path."""
    from bandlake.functions.arrays import audio_path

    some = raw.where("set_subset = 'small' and track_genre_top is not null").select(F.col("track_id").cast("long").alias("track_id"), F.col("track_genre_top").alias("genre"))
    return some.withColumn("audio_path", audio_path(F.col("track_id"), root)).join(files.select(F.col("path").alias("audio_path")), "audio_path", "left_semi").select("track_id", "genre", "audio_path")


def convert_chords(annotations: DataFrame) -> DataFrame:
    """(track_id, audio_path, time, duration, value) rows as segments with simplified chords."""
    return annotations.select("track_id", "audio_path", F.col("time").alias("t_start"), (F.col("time") + F.col("duration")).alias("t_end"), T.simplify_chord(F.col("value")).alias("chord_label"), F.col("value").alias("original_chord"))

