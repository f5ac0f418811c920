"""License scans: ordered signature rules over normalised text.

A rule is a keyword, a regular expression over lower-cased words joined by one space, a label, a priority and a
confidence. A text's keywords choose the rules that look at it, and strings that every match of a rule holds, taken from the rule's
expression, choose the texts, so most texts meet no rule. Detections are intervals
of words; one that lies within the interval of a better rule's detection (lower priority, then longer, then the
earlier rule) is suppressed. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re._constants import BRANCH, LITERAL, MAX_REPEAT, SUBPATTERN
from re._parser import parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\x01"  # a separator, so no word holds it
CHUNK = 256  # words; no rule's match is as long
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base labels: phrase, label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Rule:
    keyword: str
    pattern: str
    label: str
    priority: int
    confidence: float


_L = "licen[cs]e"
#: Licenses of one name: label, words of the name, keyword.
_NAMED = (
    ("mit", "mit", "mit"), ("mit", "expat", "expat"), ("isc", "isc", "isc"), ("zlib", "zlib(?: libpng)?", "zlib"), ("boost-1", "boost software", "boost"),
    ("artistic", "artistic", "artistic"), ("wtfpl", "wtfpl|do what the f\\w* you want to public", "f"), ("unlicense", "the unlicense|unlicense", "unlicen"),
    ("ofl", "(?:sil )?open font|ofl", "o"), ("eupl", "european union public|eupl", "eu"), ("epl", "eclipse public|epl", "e"), ("cddl", "common development and distribution|cddl", "c"),
    ("cpl", "common public", "common public"), ("mpl", "mozilla public|mpl", "m"), ("postgresql", "postgresql", "postgresql"), ("python", "python software foundation|psf", "p"),
    ("php", "php", "php"), ("ruby", "ruby", "ruby"), ("openssl", "openssl", "openssl"), ("ms-pl", "microsoft public|ms pl", "m"), ("ms-rl", "microsoft reciprocal|ms rl", "m"),
    ("osl", "open software|osl", "o"), ("afl", "academic free|afl", "a"), ("lppl", "latex project public|lppl", "l"), ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("x11", "x11", "x11"), ("vim", "vim", "vim"), ("beerware", "beer ?ware", "beer"), ("bsl", "business source", "business source"), ("sspl", "server side public|sspl", "s"),
    ("elastic", "elastic", "elastic"), ("odbl", "open database|odbl", "o"), ("odc-by", "open data commons attribution|odc by", "o"), ("pddl", "open data commons public domain dedication(?: and)?|pddl", "p"),
)
#: Families with versions: label, words of the name, keyword, versions.
_VERSIONED = (
    ("gpl", "(?:gnu )?general public", "general public", ("1", "2", "3")), ("lgpl", "(?:gnu )?(?:lesser|library) general public", "general public", ("2", "2 1", "3")), ("agpl", "(?:gnu )?affero general public", "affero", ("1", "3")),
    ("gfdl", "(?:gnu )?free documentation", "free documentation", ("1 1", "1 2", "1 3")), ("apache", "apache(?: software)?", "apache", ("1", "1 1", "2")), ("mpl", "mozilla public", "mozilla", ("1", "1 1", "2")),
    ("epl", "eclipse public", "eclipse", ("1", "2")), ("eupl", "european union public", "european union", ("1 1", "1 2")), ("afl", "academic free", "academic free", ("2 1", "3")),
    ("osl", "open software", "open software", ("2 1", "3")), ("artistic", "artistic", "artistic", ("1", "2")), ("cddl", "common development and distribution", "common development", ("1", "1 1")), ("boost", "boost software", "boost", ("1",)),
)
_SHORT = (("gpl", ("1", "2", "3")), ("lgpl", ("2", "2 1", "3")), ("agpl", ("1", "3")), ("mpl", ("1 1", "2")), ("epl", ("1", "2")), ("eupl", ("1 1", "1 2")), ("cddl", ("1", "1 1")), ("gfdl", ("1 2", "1 3")))
_CC = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv\\w*"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv\\w*"))
#: Notices and passages of licence texts: keyword, pattern, label, priority, confidence.
_PASSAGES = (
    ("permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", "mit", 20, 0.95), ("permission to use copy", "permission to use copy modify and or distribute this software for any purpose", "isc", 20, 0.95),
    ("redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", "bsd", 30, 0.85), ("neither the name", "neither the name of .{1,80}? nor the names of its contributors", "bsd-3-clause", 20, 0.9),
    ("all advertising materials", "all advertising materials mentioning features or use of this software", "bsd-4-clause", 20, 0.9), ("released into the public domain", "free and unencumbered software released into the public domain", "unlicense", 20, 0.95),
    ("public domain", "(?:placed|released|dedicated|is) (?:in|into|to) the public domain", "public-domain", 30, 0.7), ("public domain", "public domain dedication", "public-domain", 40, 0.6), ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0", 20, 0.9),
    ("all rights reserved", "all rights reserved", "proprietary", 60, 0.4), ("proprietary", "proprietary and confidential", "proprietary", 40, 0.7), ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright-notice", 70, 0.3),
    ("bsd", "(?:2 clause|simplified|freebsd) bsd|bsd 2 clause", "bsd-2-clause", 20, 0.9), ("bsd", "(?:3 clause|new|revised|modified) bsd|bsd 3 clause", "bsd-3-clause", 20, 0.9), ("bsd", "bsd (?:style )?" + _L, "bsd", 40, 0.7),
    ("as is", "the software is provided as is without warranty of any kind", "warranty-disclaimer", 80, 0.2), ("zlib", "this software is provided as is without any express or implied warranty", "zlib", 40, 0.6),
)


def rules() -> list[Rule]:
    """The rule table, in order: built from names, versions and phrasings."""
    out = [Rule(f.split()[0] if f != "cc by nc" else "cc", f, label, 10, 1.0) for f, label in BASE]
    dash = lambda v: v.replace(" ", ".")
    for label, name, key, versions in _VERSIONED:
        for v in versions:
            n = rf"{v}(?: 0)?(?! [0-9])"
            full = f"{label}-{dash(v)}"
            out += [Rule(key, rf"{name} {_L} (?:version |v )?{n} or (?:\(?at your option\)? )?(?:any )?later", f"{full}-or-later", 15, 0.98), Rule(key, rf"(?:under |of )?(?:the )?(?:terms of )?(?:the )?{name} {_L} (?:version|v) {n}", full, 20, 0.95), Rule(key, rf"{name} {_L} {n}", full, 25, 0.9), Rule(key, rf"version {n} of the {name} {_L}", full, 20, 0.95)]
        out.append(Rule(key, rf"{name} {_L}", label, 50, 0.6))
    for label, versions in _SHORT:
        for v in versions:
            out += [Rule(label, rf"{label} ?v?(?:ersion )?{v}(?: 0)?(?! [0-9])(?: only)?", f"{label}-{dash(v)}", 25, 0.9), Rule(label, rf"{label} ?v?{v}(?: 0)?(?: or later| plus)", f"{label}-{dash(v)}-or-later", 20, 0.9), Rule("spdx", rf"spdx license identifier {label} {v}(?: 0)?", f"{label}-{dash(v)}", 12, 1.0)]
        out.append(Rule(label, rf"(?:under|the) (?:the )?{label}", label, 50, 0.5))
    for label, name, key in _NAMED:
        out += [Rule(key, rf"(?:under|of) the (?:terms of the )?(?:{name}) (?:public )?{_L}", label, 20, 0.9), Rule(key, rf"(?:the )?(?:{name}) {_L}", label, 40, 0.7), Rule("spdx", rf"spdx license identifier (?:{name})", label, 12, 1.0), Rule("licen", rf"{_L}d? (?:under )?(?:the )?(?:{name})", label, 45, 0.6)]
    for label, name in _CC:
        short = label.replace("-", " ")
        out += [Rule("cc", rf"cc {short}(?: [1-4] [0-9])?(?: international| unported)?", f"cc-{label}", 22 - len(label), 0.95), Rule("creative commons", rf"creative commons {name}(?: [1-4] [0-9])?(?: international| unported)?(?: {_L})?", f"cc-{label}", 22 - len(label), 0.95), Rule("creativecommons", rf"creativecommons org licenses {short}(?: [1-4] [0-9])?", f"cc-{label}", 22 - len(label), 0.95)]
    out.append(Rule("creative commons", rf"creative commons {_L}", "cc", 55, 0.5))
    out += [Rule(*p) for p in _PASSAGES]
    return out


def _literals(pattern: str) -> set[str]:
    """Strings of which any match of the pattern at the start of a word, after a space, holds one at least."""

    def options(items: list) -> list[set[str]]:
        """Sets of strings of which each match of these parts, one after the other, holds one of every set."""
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is LITERAL:
                run += chr(value)
                continue
            found += [{run}] if run else []
            run = ""
            if op is SUBPATTERN:
                found += options(list(value[3]))
            elif op is MAX_REPEAT and value[0] > 0:
                found += options(list(value[2]))
            elif op is BRANCH:
                each = [options(list(x)) for x in value[1]]
                if all(each):
                    found.append(set().union(*(max(x, key=_least) for x in each)))
        return found

    return max(options(list(parse(" (?:" + pattern + ")" if "|" in pattern else " " + pattern))), key=_least)


def _least(strings: set[str]) -> tuple[int, int, int]:
    """Greater for strings that fewer texts hold: longer ones without their common words, or else fewer."""
    shortest = min(len(re.sub(r"\b(?:the|of|under|and|to|in|is)\b| ", "", x)) for x in strings)
    return min(shortest, 5), -len(strings), shortest


def gates() -> list[str]:
    """Strings of which a text (lower-cased words, a space before each) holds one at least if any rule matches it."""
    every = set().union(*(_literals(r.pattern) for r in rules()))
    return sorted(g for g in every if not any(x != g and x in g for x in every))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections, one row per input row.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. Base phrases are found as
    consecutive words: n_base places, the smallest and the largest start (null without any), and their labels.
    labels adds those of the rule detections that no better detection contains; both are sorted, distinct and joined by commas. score
    is the highest confidence of the text's detections, 0.0 without any. A null or empty text has no words and
    no labels. Repeated rows, null ids and names of other columns change nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    normal = rows.select("doc_id", F.concat(F.lit(" "), F.trim(F.regexp_replace(_lower(F.col("text")), SEPARATORS, " "))).alias("spaced"))
    gate = F.lit(False)
    for g in gates():
        gate |= F.contains("spaced", F.lit(g))
    n_words = F.when(F.col("spaced") == " ", 0).otherwise(F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))))
    flagged = normal.select("doc_id", n_words.cast("long").alias("n_words"), F.when(gate, F.substr("spaced", F.lit(2))).alias("norm"))
    found = flagged.withColumn("w", F.when(F.col("norm").isNotNull(), F.split("norm", " ")))
    for i, (phrase, _) in enumerate(BASE):
        test = " and ".join(f"get(w, i + {j}) = '{x}'" for j, x in enumerate(phrase.split()))
        found = found.withColumn(f"p{i}", F.expr(f"filter(sequence(0, size(w) - 1), i -> {test})"))
    lists = [F.col(f"p{i}") for i in range(len(BASE))]
    found = found.withColumn("places", F.concat(*lists))
    labels = F.array_compact(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(lists, BASE, strict=True))))
    # the rule table is a constant of a few hundred entries; a rule looks at a text that holds its keyword
    table = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(r"(?<![^ ])(?:" + r.pattern + r")(?![^ ])").alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for i, r in enumerate(rules())))
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    # a detection's first word: matches begin words, so a mark before each of them is found among the words
    marked = f"filter(transform(split(regexp_replace(norm, r.pattern, '{MARK}$0'), ' '), (x, k) -> if(startswith(x, '{MARK}'), k, null)), k -> k is not null)"
    span = f"struct(get(m.first, i) as start, get(m.first, i) + {spaces('h')} + 1 as end, r.priority as priority, r.rule as rule, r.label as label, r.confidence as confidence)"
    spans = f"flatten(transform(array(struct(regexp_extract_all(norm, r.pattern, 0) as hit, {marked} as first)), m -> transform(m.hit, (h, i) -> {span})))"
    found = found.withColumn("rules", F.when(F.col("norm").isNotNull(), table))
    found = found.withColumn("d", F.expr(f"flatten(transform(filter(rules, r -> contains(norm, r.keyword) and rlike(norm, r.pattern)), r -> {spans}))"))
    better = "(e.priority < f.priority or e.priority = f.priority and (e.end - e.start > f.end - f.start or e.end - e.start = f.end - f.start and e.rule < f.rule))"
    # a detection is compared with those that start in its own chunk of words or the one before: none is longer than a chunk
    chunks = f"transform(sequence(0, array_max(transform(d, x -> x.start)) div {CHUNK}), c -> filter(d, x -> x.start div {CHUNK} = c))"
    found = found.withColumn("chunks", F.expr(f"if(size(d) > 0, {chunks}, array())"))
    contained = lambda e: f"exists({e}, e -> e.start <= f.start and e.end >= f.end and {better})"
    kept = F.expr(f"filter(d, f -> not {contained(f'get(chunks, cast(f.start div {CHUNK} as int))')} and not coalesce({contained(f'get(chunks, cast(f.start div {CHUNK} as int) - 1)')}, false))")
    out = found.select("doc_id", "n_words", "places", labels.alias("own"), kept.alias("detections"))
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.coalesce(F.expr("detections.label"), F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", F.greatest(F.size(F.coalesce("places", F.array().cast("array<int>"))), F.lit(0)).cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce("own", F.array().cast("array<string>"))), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.coalesce(F.greatest(F.array_max(F.expr("detections.confidence")), F.when(F.size("places") > 0, F.lit(1.0))), F.lit(0.0)).alias("score"), F.coalesce("detections", F.expr("filter(array(struct(0 as start, 0 as end, 0 as priority, 0 as rule, '' as label, 0D as confidence)), x -> false)")).alias("detections"),
    )
