"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other values is the same template. Hashes
of plain windows and of template windows of documents and benchmark items are joined; windows of one occurrence of an item in a document lie
on one diagonal, and its values in the slots must map one to one, or the match is a coincidence of templates. Everything is DataFrame and SQL
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER, NAME, UNIT, JOIN = "\ue001", "\ue002", "\ue003", "\ue004"  # private-use letters
WINDOW, LEAST_ITEM = 8, 5
LEAST_WORDS = 13
BROADCAST_WINDOWS = 500_000
_WORDS = "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion"
_UNITS = "km|cm|mm|m|miles?|feet|foot|inch(?:es)?|yards?|kg|g|mg|tons?|pounds?|lbs?|ounces?|oz|l|ml|lit(?:er|re)s?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|h|min|s|ms|mph|kmh|dollars?|cents?|euros?|usd|eur|percent|degrees?|celsius|fahrenheit|kelvin|watts?|volts?|joules?|newtons?|hz|khz|mhz|bytes?|kb|mb|gb"
_TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
_DIGITS = "one|two|three|four|five|six|seven|eight|nine"
#: What stands within a number: separators between digits (1,250 or 2.5, 3/4, 3-5, 10:30) and the blank or hyphen of twenty-five.
_SEPARATOR = r"[.,/:'’\u2013-]"
#: Words that begin a sentence and are no names.
_OPENERS = "what|which|who|whom|whose|when|where|why|how|if|the|a|an|in|on|at|of|for|to|from|by|with|is|are|was|were|do|does|did|can|could|will|would|should|let|find|there|this|that|these|those|it|he|she|they|we|you|given|suppose|consider|each|every|all|some|after|before|during|while|because|since"
_TOKEN = r"[^\p{L}\p{M}\p{N}" + NUMBER + NAME + UNIT + JOIN + "]+"


def _whole_numbers(text: Column) -> Column:
    """The text with every number as one token, however it is written. Most texts have nothing to join, which plain searches tell."""
    digits = F.when(F.regexp_like(text, F.lit(rf"\p{{N}}{_SEPARATOR}\p{{N}}")), F.regexp_replace(text, rf"(?<=\p{{N}}){_SEPARATOR}(?=\p{{N}})", JOIN)).otherwise(text)
    spelled = F.regexp_replace(digits, rf"(?<![\p{{L}}\p{{N}}])((?i:{_TENS}))[ -]((?i:{_DIGITS}))(?![\p{{L}}\p{{N}}])", f"$1{JOIN}$2")
    some = [F.contains(text, F.lit(x)) for x in ("ty-", "ty ", "TY-", "TY ")]
    return F.when(some[0] | some[1] | some[2] | some[3], spelled).otherwise(digits)


def _without_first_name(text: Column) -> Column:
    """An item without its first word if that looks like a name and the item has a number: questions of that kind are asked under any name."""
    first = rf"^\p{{Lu}}\p{{Ll}}+(?<!^(?i:{_OPENERS}))(?=[ ,])[ ,]+"
    return F.when(F.regexp_like(text, F.lit(rf"\p{{N}}|(?<![\p{{L}}\p{{N}}])(?i:{_WORDS})(?![\p{{L}}\p{{N}}])")), F.regexp_replace(text, first, "")).otherwise(text)


def _named(text: Column) -> Column:
    """The text with a placeholder for each name, a word in title case within a sentence; every token stays one token."""
    return F.regexp_replace(text, r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", NAME)


def _numbered(text: Column) -> Column:
    """The text with a placeholder for each number and unit; every token stays one token."""
    numbers = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}])(?:\p{{N}}+(?:{JOIN}\p{{N}}+)*|(?i:{_WORDS})(?:{JOIN}(?i:{_DIGITS}))?)(?![\p{{L}}\p{{N}}])", NUMBER)
    return F.when(F.contains(numbers, F.lit(NUMBER)), F.regexp_replace(numbers, rf"(?<={NUMBER}[ -]?)(?i:{_UNITS})(?![\p{{L}}\p{{N}}])", UNIT)).otherwise(numbers)


def _windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """The rows with their windows: `at`, `length`, `kind`, `h`, and `values`, the words at its slots.

    A window is there as its plain words (kind 0, values null), with its numbers and units as slots (kind 1) and with its names too
    (kind 2), each kind only if it has slots of its own: capitals change no plain window and none of kind 1.
    """
    texts = rows.withColumn("named", _named(F.col("text"))).withColumn("r", F.split(F.lower("text"), _TOKEN)).withColumn("t1", _numbered(F.col("text")))
    texts = texts.withColumn("t2", F.when(F.contains("named", F.lit(NAME)), _numbered(F.col("named"))))
    cut = texts.withColumn("c1", F.when(F.contains("t1", F.lit(NUMBER)), F.split(F.lower("t1"), _TOKEN))).withColumn("c2", F.when(F.col("t2").isNotNull(), F.split(F.lower("t2"), _TOKEN)))
    marks = f"array('{NUMBER}', '{NAME}', '{UNIT}')"
    parts = []
    for n in lengths:
        places = f"sequence(1, size(r) - {n - 1})"
        window = lambda c: f"slice({c}, i, {n})"  # noqa: B023, E731
        parts.append(f"transform({places}, i -> struct(i as at, {n} as length, 0 as kind, xxhash64({window('r')}) as h, cast(null as array<string>) as values))")
        for kind, c, own in ((1, "c1", f"array('{NUMBER}', '{UNIT}')"), (2, "c2", f"array('{NAME}')")):
            values = f"filter(transform({window(c)}, (x, k) -> if(array_contains({marks}, x), get(r, i + k - 1), null)), x -> x is not null)"
            slotted = f"filter({places}, i -> arrays_overlap({window(c)}, {own}))"
            parts.append(f"if({c} is null, array(), transform({slotted}, i -> struct(i as at, {n} as length, {kind} as kind, xxhash64({window(c)}) as h, {values} as values)))")
        parts[-3:] = [f"if(size(r) >= {n}, {x}, array())" for x in parts[-3:]]
    return cut.select(*(c for c in rows.columns if c != "text"), F.inline(F.expr(f"concat({', '.join(parts)})")))


def _row(places: str, least: str) -> str:
    """Whether a sorted array of distinct numbers holds `least` in a row."""
    return f"exists(sequence(0, size({places})), i -> coalesce(get({places}, i + {least} - 1) = get({places}, i) + {least} - 1, false))"


def _lines_of_items(rows: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs of short items and the rows that have one as a whole line."""
    lines = rows.select("doc_id", "doc_row", F.explode(F.split("text", "[\r\n]+")).alias("line"))
    cut = lambda c: F.filter(F.split(F.lower(c), _TOKEN), lambda x: x != "")
    lines = lines.select("doc_id", "doc_row", cut("line").alias("words")).where(F.size("words").between(1, LEAST_ITEM - 1))
    met = lines.join(short.select("item_id", cut("text").alias("words")), "words").select("doc_id", "item_id", "doc_row").distinct()
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return met.withColumn("best", F.struct(F.lit(True).alias("contaminated"), one.alias("n_windows"), none.alias("n_consistent"), none.alias("n_slots"), one.alias("n_item_windows")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", by_text: bool = False) -> DataFrame:
    """(doc_id, item_id) that share templates: n_windows, n_item_windows, n_slots, n_consistent, contaminated.

    A pair is contaminated if the windows of one occurrence cover LEAST_WORDS words in a row, or all of a shorter item, as plain words, or as
    templates with at least four fifths of the slot values mapped one to one; the figures are those of the best occurrence.
    Templates of WINDOW words (all words of a shorter item) of which over half are slots don't count. An item of fewer than LEAST_ITEM words is found where it is a whole line. A number is one slot, however it is written (1,250, 2.5, 3/4, twenty-five). A word at the start of a sentence is never a slot; the first word of an item
    with a number is left out of it if it looks like a name, so the item is found under any. Null and empty texts share
    nothing. Rows of one id are one document, or item, but an occurrence lies within one row; rows with a null doc_id count as one document, items with a null id are not looked for. With `by_text` there is a
    row for each text of an id, with its hash as doc_row. Letters compare without case; punctuation and
    other columns don't matter. Pairs without a shared window are not returned.
    """
    keys = ["doc_id", "item_id", *(["doc_row"] if by_text else [])]
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), _whole_numbers(F.col(item_text_col).cast("string")).alias("text")).where("text is not null and item_id is not null").withColumn("size", F.size(F.filter(F.split(F.lower("text"), _TOKEN), lambda x: x != "")))
    short, items = items.where(f"size between 1 and {LEAST_ITEM - 1}"), items.where(f"size >= {LEAST_ITEM}").withColumn("item_row", F.xxhash64("text")).withColumn("text", F.expr(rf"regexp_replace(text, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '')"))
    nameless = F.size(F.filter(F.split(F.lower("text"), _TOKEN), lambda x: x != ""))
    items = items.withColumn("whole", F.col("text")).withColumn("text", _without_first_name(F.col("text"))).withColumn("text", F.when(nameless >= LEAST_ITEM, F.col("text")).otherwise(F.col("whole"))).drop("whole").withColumn("size", nameless)
    lengths = sorted(r.n for r in items.select(F.least("size", F.lit(WINDOW)).alias("n")).distinct().collect()) or [WINDOW]
    # within a document an item's first word can look like a name: its first window is looked for in that form too
    begun = _windows(items.withColumn("text", F.concat(F.lit("a "), "text")), lengths).where("at = 2 and kind > 0").withColumn("at", F.lit(1))
    known = _windows(items, lengths).withColumn("begun", F.lit(False)).unionByName(begun.withColumn("begun", F.lit(True))).where(f"length = least(size, {WINDOW})")
    known = known.dropDuplicates(["item_id", "item_row", "at", "h"])
    # the windows that count have few slots when all names are slots; they are numbered without the others, so these don't end a row of windows
    light = "coalesce(size(values), 0) * 2 <= length"
    known = known.withColumn("counts", F.expr(f"not begun and {light} and kind = max(if(begun, 0, kind)) over (partition by item_id, item_row, at)"))
    known = known.withColumn("place", F.expr("sum(int(counts)) over (partition by item_id, item_row order by at)")).withColumn("counts", F.expr("max(counts) over (partition by item_id, item_row, at)")).withColumn("place", F.expr("if(counts, place, null)"))
    known = known.withColumn("n_item_windows", F.expr("coalesce(max(place) over (partition by item_id, item_row), 0)")).withColumn("n_all", F.expr("max(at) over (partition by item_id, item_row)").cast("long"))
    known = known.where(light)
    known = known.select("h", "item_id", "item_row", "length", "place", "n_item_windows", "n_all", F.col("at").alias("item_at"), F.col("values").alias("item_values"))
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("doc_row", F.xxhash64("text")).withColumn("text", _whole_numbers(F.col("text")))
    # an occurrence of an item is a diagonal: its windows are all as far from the item's
    met = _windows(rows, lengths).join(known, ["h", "length"]).withColumn("diagonal", F.col("at") - F.col("item_at"))
    pairs = F.arrays_zip(F.col("item_values").alias("b"), F.col("values").alias("d"))
    slots = F.array_distinct(F.flatten(F.collect_set(F.when(F.col("values").isNotNull() & F.col("item_values").isNotNull(), pairs))))
    sets = {"plain": F.when(F.col("item_values").isNull(), F.col("item_at")), "every": F.col("item_at"), "places": F.col("place")}
    each = met.groupBy("doc_id", "item_id", "doc_row", "item_row", "diagonal").agg(*(F.array_sort(F.collect_set(c)).alias(name) for name, c in sets.items()), F.max("n_item_windows").alias("n_places"), F.max("n_all").alias("n_all"), F.max("length").alias("length"), slots.alias("slots"))
    each = each.withColumn("n_slots", F.size("slots").cast("long")).withColumn("n_consistent", F.expr("size(filter(slots, x -> not exists(slots, y -> (y.b = x.b) <> (y.d = x.d))))").cast("long"))
    each = each.withColumn("row", F.lit(LEAST_WORDS + 1) - F.col("length")).withColumn("least", F.least("n_all", "row").cast("int")).withColumn("fewest", F.least("n_places", "row").cast("int"))
    same = "5 * n_consistent >= 4 * n_slots"
    each = each.withColumn("contaminated", F.expr(f"{_row('plain', 'least')} or ({_row('every', 'least')} or fewest > 0 and {_row('places', 'fewest')}) and {same}"))
    # figures are of the windows that count, of an item without any of all its windows
    each = each.withColumn("n_windows", F.when(F.col("n_places") > 0, F.size("places")).otherwise(F.size("every")).cast("long")).withColumn("n_item_windows", F.when(F.col("n_places") > 0, F.col("n_places")).otherwise(F.col("n_all")))
    best = each.groupBy(*keys).agg(F.max(F.struct("contaminated", "n_windows", "n_consistent", "n_slots", "n_item_windows")).alias("best"))
    if short.take(1):
        best = best.unionByName(_lines_of_items(rows, short).groupBy(*keys).agg(F.max("best").alias("best")))
    return best.select(*keys, "best.n_windows", "best.n_item_windows", "best.n_slots", "best.n_consistent", "best.contaminated")
