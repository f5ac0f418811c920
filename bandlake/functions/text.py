"""Text and label functions, all built-in expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Treebank tokens and what they stand for.
TREEBANK_TOKENS = {"-LRB-": "(", "-RRB-": ")", "-LCB-": "{", "-RCB-": "}", "``": "“", "''": "”"}
#: Review stars to sentiment, entity numbers to tags, inference numbers to labels.
SENTIMENT = {1: "-", 2: "-", 3: "o", 4: "+", 5: "+"}
ENTITY_TAGS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]
INFERENCE = ["entailment", "neutral", "contradiction"]


def simplify_chord(c: Column) -> Column:
    """root:maj or root:min for chords of those qualities and dominant sevenths; N for all else."""
    part = F.split(c, ":")
    root, quality = part[0], part[1]
    return F.when((c == "N") | (F.size(part) != 2), "N").when(quality.startswith("maj") | (quality == "7"), F.concat(root, F.lit(":maj"))).when(quality.startswith("min"), F.concat(root, F.lit(":min"))).otherwise("N")


def treebank_tokens(line: Column) -> tuple[Column, Column]:
    """(words, tags) of a bracketed parse: its leaves are brackets around a tag, blanks and a word, none of which holds a bracket or a blank."""
    pattern = r"\((?<tag>[^\s()]+)\s+(?<word>[^\s()]+)\)"
    names = F.create_map(*(F.lit(x) for x in chain(*TREEBANK_TOKENS.items())))
    words = F.regexp_extract_all(line, F.lit(pattern), 2)
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), w)), F.regexp_extract_all(line, F.lit(pattern), 1)


def base_relation(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def file_label(path: Column) -> Column:
    """The part of a file's name before its first underscore."""
    return F.substring_index(F.substring_index(path, "/", -1), "_", 1)


def annotation_path(path: Column) -> Column:
    return F.regexp_replace(path, r"_mix\.wav$", ".jams")


def sentiment(stars: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain(*SENTIMENT.items()))), stars.cast("int"))


def entity_tags(numbers: Column) -> Column:
    names = F.array(*(F.lit(x) for x in ENTITY_TAGS))
    return F.transform(numbers, lambda i: F.get(names, i.cast("int")))


def inference_label(number: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in INFERENCE)), number.cast("int"))


def language(locale: Column) -> Column:
    return F.substring_index(locale, "_", 1)


def percent(values: Column) -> Column:
    """Accuracies as percentages; those given as parts of one are multiplied."""
    return F.when(F.array_max(values) <= 1, F.transform(values, lambda x: x * 100)).otherwise(values)
