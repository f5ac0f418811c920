import random

import regex

from bandlake.llm.catalog import QUERIES
from bandlake.llm.decontaminate import decontaminate

ITEMS = [
    (1, "If Anna drives 120 km in 3 hours, how far does she drive with the same speed in 5 hours?", "q"),
    (2, "The quick brown fox jumps over the lazy dog while seven other animals quietly watch from the forest edge", "q"),
    (3, "short five word item here", "q"), (4, "too short", "q"), (5, None, "q"), (6, "", "q"), (None, "another question without any identifier but with enough words to match a document somewhere", "q"),
]


def run(spark, docs, items=ITEMS):
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string"))
    return {(r.doc_id, r.item_id): r for r in found.collect()}


def test_cases(spark):
    docs = [
        (1, "Noise before. " + ITEMS[0][1] + " Noise after, more words.", "x"),
        (2, "Noise before. If Berta drives 90 miles in 2 days, how far does she drive with the same speed in 7 days? The end.", "x"),
        (3, "If Berta drives 90 miles in 2 days, how far does she drive with the same speed in 2 days? The end.", "x"),
        (4, "THE QUICK, BROWN FOX: JUMPS OVER THE LAZY DOG -- WHILE SEVEN OTHER ANIMALS QUIETLY WATCH", "x"),
        (5, "the quick brown fox jumps over the lazy cat while nobody looks", "x"), (6, "we saw a short five word item here today", "x"), (7, None, "x"), (8, "", "x"), (9, "clean text of words " * 9000, "x"),
        (2, "another row", "x"), (None, ITEMS[1][1], "x"), (10, "too short", "x"), (11, ITEMS[6][1].upper(), "x"),
    ]
    got = run(spark, docs)
    bad = {k for k, r in got.items() if r.contaminated}
    assert bad == {(1, 1), (2, 1), (4, 2), (6, 3), (10, 4), (None, 2)}  # item 4 is all of document 10
    assert not got[3, 1].contaminated and got[3, 1].n_consistent < got[3, 1].n_slots
    assert got[2, 1].n_slots == got[2, 1].n_consistent > 3
    assert not got[5, 2].contaminated


def test_occurrences_are_judged_apart(spark):
    """A verbatim copy counts beside a re-parameterised one, in one row or two, and in an item that repeats a passage with other numbers."""
    other = "If Berta drives 90 miles in 2 days, how far does she drive with the same speed in 7 days?"
    third = "If Carla drives 60 km in 4 hours, how far does she drive with the same speed in 9 hours?"
    items = [ITEMS[0], (8, "there are 3 red apples and 2 green apples in the box and there are 5 red apples and 7 green apples in the box", "q")]
    docs = [(1, f"Noise. {ITEMS[0][1]} More noise. {other} The end.", "x"), (2, f"{other} And {third}", "x"), (3, other, "x"), (3, ITEMS[0][1], "x"), (4, f"words before {items[1][1]} words after", "x"), (5, "how far does she drive if Berta drives 90 miles in 2 days with the same speed", "x")]
    got = run(spark, docs, items)
    assert {k for k, r in got.items() if r.contaminated} == {(1, 1), (2, 1), (3, 1), (4, 8)}
    assert all(got[k].n_windows == got[k].n_item_windows for k in [(1, 1), (2, 1), (3, 1), (4, 8)])


def test_surroundings_do_not_hide_a_copy(spark):
    """Copies in text full of capitals, or in the middle of a sentence."""
    items = [ITEMS[0], (8, "Which planet of the system has the most moons today", "q"), (9, "He met Anna and then Otto with Emma, Paul, Karl, Rosa and Ida before they all went to see Berta at home", "q"), (10, "Anna buys 12 apples and sells 5 of these apples", "q"), (11, "we asked Anna about the cold river and Otto about the old tree and Emma about the wide field", "q")]
    prose = "Der Hund und die Katze und der Vogel und das Pferd, Haus, Baum, Wald, Berg, See, Fluss, Stadt, Land, Weg, Tor, Dach, Wand, Stuhl, Tisch. " * 6
    docs = [(1, f"{prose}{ITEMS[0][1]} {prose}", "x"), (2, f"he asked, {items[1][1]} and left", "x"), (3, f"noise {items[2][1]} noise", "x"), (4, "they say, Berta buys 30 apples and sells 8 of these apples daily", "x"), (5, f"{prose}{prose}", "x"), (6, f"noise {items[2][1].lower()} noise", "x"), (8, f"{prose}{items[4][1]} {prose}", "x"), (7, f"{prose}If Berta drives 90 miles in 2 days, how far does she drive with the same speed in 7 days? {prose}", "x")]
    assert {k for k, r in run(spark, docs, items).items() if r.contaminated} == {(1, 1), (2, 8), (3, 9), (4, 10), (6, 9), (7, 1), (8, 11)}


def test_other_names(spark):
    """Questions under other names, alone, amid plain words and with a name at the start; and names that don't map one to one."""
    item = "Maria gave Peter seven old books while Laura and Simon were waiting for the bus near the town hall"
    short = "Who sells apples to Emma and Otto on the market square"
    new = item.replace("Maria", "Julia").replace("Peter", "Marco").replace("Laura", "Sonja").replace("Simon", "David")
    docs = [(1, new, "x"), (2, f"some plain words before it. {new} and some plain words after it", "x"), (3, "Who sells apples to Paula and Karl on the market square", "x"), (4, f"we saw that {short.replace('Otto', 'Nina').lower().replace('nina', 'Nina').replace('emma', 'Rosa')} again", "x"), (5, short.replace("apples", "pears"), "x"), (6, new.replace("Marco", "Julia").replace("Sonja", "Julia"), "x")]
    items = [(1, item, "q"), (2, short, "q"), (3, "Yes, he did", "q")]
    assert {k for k, r in run(spark, docs, items).items() if r.contaminated} == {(1, 1), (2, 1), (3, 2), (4, 2)}
    lines = [(1, "He asked.\n- yes he DID!\nThe end", "x"), (2, "yes he did it", "x"), (None, "Yes, he did", "x"), (None, "clean", "x")]
    assert {k for k, r in run(spark, lines, items).items() if r.contaminated} == {(1, 3), (None, 3)}
    by_text = decontaminate(spark.createDataFrame(lines, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string"), by_text=True).collect()
    assert len({r.doc_row for r in by_text}) == 2


def test_numbers_are_one_slot_and_first_names_don_t_matter(spark):
    items = [(1, "Alice has 3 apples and 5 pears. How many fruits does she have?", "q"), (2, "A tank holds 1,250 litres and leaks 2.5 litres each day until it is empty", "q"), (3, "The shop sold twenty-five red hats and 3/4 of the blue ones", "q")]
    docs = [
        (1, "Bob has 4 apples and 7 pears. How many fruits does she have?", "x"), (2, "we know: a tank holds 900 litres and leaks 3 litres each day until it is empty", "x"), (3, "a tank holds 3,100 litres and leaks 4.5 litres each day until it is empty, yes", "x"),
        (4, "The shop sold seven red hats and 5 of the blue ones", "x"), (5, "the shop sold 1'000 red hats and ninety-nine of the blue ones", "x"), (6, items[0][1], "x"), (7, "Bob has 4 apples and 7 plums. How many fruits does she have?", "x"), (8, "The tank holds water and leaks every day until it is empty", "x"),
    ]
    assert {k for k, r in run(spark, docs, items).items() if r.contaminated} == {(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 1)}


def test_templates_match_brute_force(spark):
    """Questions from templates under other names, numbers and units, some with values that don't map one to one or with another word: found if and only if the values do."""
    rnd = random.Random(3)
    stems = [
        "{N} buys {a} pens and {b} books, then gives {n} exactly {a} pens for the class",
        "a train covers {b} {u} in {a} hours while {n} waits {a} hours at the old station",
        "{N} pours {a} {u} of water and {b} {u} of milk before {n} adds {a} {u} of cream",
    ]
    names = ["Alice", "Bruno", "Chloe", "David"]

    def fill(stem, spoil=False):
        a, b = rnd.sample(["3", "12", "1,250", "2.5", "seven", "forty-two", "3/4"], 2)
        text, (first, other) = stem, rnd.sample(names, 2)
        for slot, v in (("{N}", first), ("{n}", other), ("{u}", rnd.choice(["km", "miles", "litres", "cm"])), ("{b}", b)):
            text = text.replace(slot, v)
        if spoil:
            for _ in range(text.count("{a}")):
                text = text.replace("{a}", rnd.choice([x for x in ("5", "6", "8.25", "nine", "11") if x not in text]), 1)
        return text.replace("{a}", a)

    items = [(i, fill(s), "q") for i, s in enumerate(stems)]
    docs, want = [], set()
    for d in range(60):
        i = rnd.randrange(3)
        kind = d % 3
        text = fill(stems[i], spoil=kind == 1)
        if kind == 2:
            text = text.replace(" and ", " or ").replace(" while ", " when ").replace(" before ", " after ").replace(" then ", " soon ")
        docs.append((d, rnd.choice(["", "Some words stand here first. "]) + text + rnd.choice([".", " and so on it goes."]), "x"))
        if kind == 0:
            want.add((d, i))
    got = {k for k, r in run(spark, docs, items).items() if r.contaminated}
    assert got == want


def test_empty(spark):
    assert run(spark, []) == {} == run(spark, [(1, "a b c d e f g h", "x")], [])


def test_query_matches_brute_force_on_plain_text(spark):
    """Whole items without slots: a document is found if it holds 13 of an item's words in a row, or all of a shorter item."""
    sf = "/root/testdata/sf0.01"
    words = lambda t: regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower())
    spans = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(max(1, len(w) - 12)):
            spans.setdefault(tuple(w[i : i + 13]), set()).add(r.item_id)
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = words(r.text or "")
        want |= {(r.doc_id, b) for i in range(len(w)) for b in spans.get(tuple(w[i : i + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontaminate"](spark, sf).collect()}
    assert want and want <= got and len(got) <= 1.1 * len(want)
