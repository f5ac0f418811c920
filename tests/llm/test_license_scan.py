import re

from bandlake.llm.catalog import QUERIES
from bandlake.llm.license_scan import BASE, CHUNK, license_scan, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    found = []
    norm = " ".join(w)
    for k, r in enumerate(rules()):
        if r.keyword in norm:
            for m in re.finditer(r"(?<![^ ])(?:" + r.pattern + r")(?![^ ])", norm):
                a = norm[: m.start()].count(" ")
                found.append((a, a + m[0].count(" ") + 1, r.priority, k, r.label))
    better = lambda e, f: (e[2], f[1] - f[0], e[3]) < (f[2], e[1] - e[0], f[3])
    kept = {f[4] for f in found if not any(e is not f and e[0] <= f[0] and e[1] >= f[1] and better(e, f) for e in found)}
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | kept))


TEXTS = [
    "Released under the MIT License. Under the  mit-license!", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 and cc_by_nc", "This work is licensed under the GNU General Public License, version 3.",
    "GNU Lesser General Public License v2.1 or later", "GNU General Public License version 2 or any later version", "SPDX-License-Identifier: GPL-3.0", "see the BSD 3-Clause license, all rights reserved", "undér the mit license", "xunder the mit license under the mit licensed",
    "MIT License, BSD license, Apache License 2.0 and GPL v3. " * 400, "x " * 254 + "GNU Lesser General Public License version 2.1 or any later version", "\x01mit license of the \x01 kind\x01",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Copyright (c) 2020 x. Permission is hereby granted, free of charge, to any person obtaining a copy", "", None, "   ", "mit in der licen", "Mozilla Public License 2.0 MPL 2.0", "w " * 20000 + "under the mit license", "free of licence",
]


def test_matches_brute_force(spark):
    rows = [(i, t, "x", 0.5) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", 1.0), (0, TEXTS[0], "x", 1.0)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, *_ in rows), key=key)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)


def sample(pattern, pick):
    """A text that the pattern matches; pick chooses among branches and numbers of repeats."""
    from re import _constants as c
    from re import _parser

    def part(op, v):
        if op is c.LITERAL:
            return chr(v)
        if op is c.SUBPATTERN:
            return text(v[3])
        if op is c.BRANCH:
            return text(v[1][pick(0, len(v[1]) - 1)])
        if op in (c.MAX_REPEAT, c.MIN_REPEAT):
            return "".join(text(v[2]) for _ in range(pick(v[0], min(v[1], v[0] + 1))))
        if op is c.IN:
            return chr(v[0][1]) if v[0][0] is c.LITERAL else chr(v[0][1][0]) if v[0][0] is c.RANGE else "x"
        return "" if op in (c.ASSERT, c.ASSERT_NOT) else "x"

    def text(items):
        return "".join(part(op, v) for op, v in items)

    return text(_parser.parse(pattern))


def test_no_rule_is_cut_off(spark):
    """A text per rule and choice of branches that holds nothing else, its words apart by newlines and commas."""
    low, high = (lambda a, b: a), (lambda a, b: b)
    texts = sorted({sample(r.pattern, pick).replace(" ", gap) for r in rules() for pick, gap in ((low, "\n"), (high, ",\n "))})
    texts += ["Photo by A. Smith, CC BY-SA 4.0", "placed in the public\ndomain", "All rights\nreserved", 'The software is provided "AS IS", WITHOUT warranty of any kind', "redistribution and\nuse in source and binary forms, with or without modification, are permitted"]
    got = {r.doc_id: tuple(r)[1:7] for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute(x) for i, x in enumerate(texts)}
    assert sum(g[5] != "" for g in got.values()) > 0.9 * len(texts) and all(got[len(texts) - k][5] for k in range(1, 6))


def test_rules_are_many_and_valid():
    assert len(rules()) > 200
    for r in rules():
        assert re.compile(r.pattern) and 0 < r.confidence <= 1


def test_query_and_empty(spark):
    got = {r.doc_id: tuple(r)[1:7] for r in QUERIES["op10_license_scan"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: brute(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_rule_reaches_over_a_chunk():
    """Words of the longest match: a match has at most as many spaces as characters that can be spaces."""
    from re import _constants as c
    from re import _parser

    def most(items):
        n = 0
        for op, v in items:
            if op is c.LITERAL:
                n += chr(v) == " "
            elif op is c.ANY:
                n += 1
            elif op is c.SUBPATTERN:
                n += most(v[3])
            elif op is c.BRANCH:
                n += max(most(x) for x in v[1])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                inside = most(v[2])
                n += inside * v[1] if inside else 0
        return n

    assert max(most(_parser.parse(r.pattern)) for r in rules()) + 1 < CHUNK
