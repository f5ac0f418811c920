"""Sub-word pieces of texts by greedy longest match over a given vocabulary, with character offsets."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

PIECES = "struct<ids:array<int>,text:array<int>,word:array<int>,start:array<int>,end:array<int>,special:array<boolean>>"
#: A vocabulary is shipped to every task, so its file is held to this size.
MAX_FILE = 64 << 20
#: Words that a task keeps with their pieces, and the longest of them.
KEPT, LONGEST_KEPT = 50_000, 64
_WORDS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others counted on from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Pieces by number. A piece that ends with `suffix` stands at the end of a word only; all single bytes need a piece of both kinds."""

    pieces: dict[str, int]
    begin: int
    end: int
    suffix: str = "</w>"
    longest: int = field(init=False)

    def __post_init__(self):
        self.longest = max((len(p.removesuffix(self.suffix)) for p in self.pieces), default=1)
        lacking = [s for s in byte_symbols() if s not in self.pieces or s + self.suffix not in self.pieces]
        if lacking:
            raise ValueError(f"the vocabulary has no pieces for {len(lacking)} bytes")

    def __len__(self) -> int:
        return max(*self.pieces.values(), self.begin, self.end) + 1

    def match(self, symbols: str) -> list[tuple[int, int]]:
        """(piece, end) of a word's pieces: from each place the longest one that the vocabulary has."""
        out, at, n = [], 0, len(symbols)
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                piece = symbols[at:to] + self.suffix if to == n else symbols[at:to]
                if (k := self.pieces.get(piece)) is not None:
                    break
            out.append((k, to))
            at = to
        return out


def read_vocabulary(spark: SparkSession, path: str, begin: str = "<|startoftext|>", end: str = "<|endoftext|>") -> Vocabulary:
    """The vocabulary of a tokenizer description in JSON (model.vocab, added_tokens), read through Spark's file systems."""
    row = spark.read.format("binaryFile").load(path).where(f"length <= {MAX_FILE}").select("content").first()
    if row is None:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    found = json.loads(bytes(row[0]))
    pieces = dict(found["model"]["vocab"])
    extra = {t["content"]: t["id"] for t in found.get("added_tokens", [])}
    marks = [extra.get(x, pieces.pop(x, None)) for x in (begin, end)]
    if None in marks:
        raise ValueError(f"no piece for {begin!r} or {end!r}")
    return Vocabulary({p: k for p, k in pieces.items() if p not in extra}, *marks, suffix=found["model"].get("end_of_word_suffix") or "")


class Splitter:
    """Splits texts; words that were split before are looked up."""

    def __init__(self, vocabulary: Vocabulary, most: int = KEPT):
        self.vocabulary, self.known, self.most, self.symbols = vocabulary, {}, most, byte_symbols()

    def _word(self, word: str) -> list[tuple[int, int, int]]:
        """(piece, start, end) in characters of the word; a character whose bytes fall to two pieces belongs to both."""
        if (found := self.known.get(word)) is not None:
            return found
        low = "".join(c if len(x := c.lower()) != 1 else x for c in word)
        bytes_of = [c.encode("utf-8", "surrogatepass") for c in low]
        place = np.repeat(np.arange(len(low)), [len(b) for b in bytes_of]).tolist()
        at, found = 0, []
        for k, to in self.vocabulary.match("".join(self.symbols[b] for b in b"".join(bytes_of))):
            found.append((k, place[at], place[to - 1] + 1))
            at = to
        if len(self.known) < self.most and len(word) <= LONGEST_KEPT:
            self.known[word] = found
        return found

    def columns(self, text: str | None) -> tuple[array, array, array, array]:
        """Pieces, starts, ends and word numbers of a text, as machine integers; words are counted by white space."""
        ids, start, end, words = (array("i") for _ in range(4))
        number, last = -1, None
        for m in _WORDS.finditer(text or ""):
            if last is None or re.search(r"\s", text[last : m.start()]):
                number += 1
            last = m.end()
            at = m.start()
            for k, a, b in self._word(m[0]):
                ids.append(k)
                start.append(at + a)
                end.append(at + b)
                words.append(number)
        return ids, start, end, words

    def split(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(piece, start, end, word number) of a text."""
        return list(zip(*self.columns(text), strict=True))


def cut_longest(sizes: Sequence[int], room: int) -> list[int]:
    """Sizes that fit into `room`: the longest gives way first, the later one of equals."""
    sizes = list(sizes)
    over = sum(sizes) - max(0, room)
    while over > 0:
        top = max(sizes)
        below = max([s for s in sizes if s < top], default=0)
        tops = [i for i, s in enumerate(sizes) if s == top]
        step, rest = divmod(min(over, (top - below) * len(tops)), len(tops))
        for j, i in enumerate(tops):
            sizes[i] -= step + (j >= len(tops) - rest)
        over = sum(sizes) - max(0, room)
    return sizes


def pieces(texts: Column, vocabulary: Vocabulary, limit: int | None = None) -> Column:
    """The pieces of an array of texts (one or a pair): a begin, then each text followed by an end. ids, text (its number in the array), word (within its text), start and end
    (characters of the text) and special, true for begins and ends, whose offsets are 0 and word -1.

    Letters are lower-cased one by one. A limit holds for all pieces together and takes from the longest text first. A null text has no pieces; a null array gives null.
    Pieces are kept as machine integers, 20 bytes each, so that a task holds little more than what it returns.
    """
    kept: list[Splitter] = []  # a task's own

    @arrow_udf(PIECES)
    def run(column: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Splitter(vocabulary))
        ids, text, word, start, end = (array("i") for _ in range(5))
        sizes, known = np.zeros(len(column), np.int64), np.zeros(len(column), bool)

        def mark(k: int, i: int) -> None:
            for out, v in ((ids, k), (text, i), (word, -1), (start, 0), (end, 0)):
                out.append(v)

        for r, row in enumerate(column):
            if not row.is_valid:
                continue
            known[r], before = True, len(ids)
            each = [kept[0].columns(t) for t in row.as_py()]
            lengths = [len(x[0]) for x in each]
            mark(vocabulary.begin, 0)
            for i, (x, n) in enumerate(zip(each, cut_longest(lengths, limit - 1 - len(each)) if limit else lengths, strict=True)):
                for out, part in zip((ids, start, end, word), x, strict=True):
                    out.extend(part[:n] if n < len(part) else part)
                text.extend(array("i", [i]) * n)
                mark(vocabulary.end, i)
            sizes[r] = len(ids) - before
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        flat = {n: np.asarray(x, np.int32) for n, x in (("ids", ids), ("text", text), ("word", word), ("start", start), ("end", end))} | {"special": np.asarray(word, np.int32) < 0}
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(x)) for x in flat.values()], list(flat), mask=pa.array(~known))

    return run(texts)
