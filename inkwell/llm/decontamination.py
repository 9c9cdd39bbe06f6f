"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of the test items.

Texts are read as UTF-8 bytes. Bytes are folded by one table (A-Z to a-z; every other ASCII byte that is not a letter
or digit to a space; bytes of non-ASCII characters stay), and words are what lies between spaces. The words of the items
are numbered, and the automaton reads each word as its number's digits: every window of ``window`` consecutive item
words (the whole item if it has fewer) is a pattern. Each text is scanned once; a match ends at a word, and word numbers
map back to character offsets of the original.

Defined cases: a null or wordless text has no words, hits or items; a null or wordless item has no window; the
windows of an item without id hit, and name no item; items with equal windows are all reported; repeated rows give
repeated results; an empty benchmark hits nothing; other columns of either table are ignored.

The items are broadcast in parts of about ``part_bytes`` of their text, which bounds a worker's memory: it holds one
part's automaton at a time, some 200 bytes a byte of prose (three times that for words of one letter). With several
parts a worker collects texts up to ``HELD`` bytes before it builds the parts' automata in turn, so cost grows with the
number of parts, memory does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import text_bytes

#: Folding of bytes before words are taken.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Bytes of item text of one automaton; bytes of texts that several automata meet at a time.
PART_BYTES, HELD = 2 << 20, 64 << 20
#: Digits of a word's number.
BASE = 32

RESULT = "struct<n_words:long, n_hit:long, items:array<string>, spans:array<struct<start:long, stop:long>>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Part:
    """An automaton over the codes of words; its values are (number of words, item ids).

    A node of the automaton looks for its child one by one, so a word is not one letter but its number's digits to the
    base ``BASE``, each place with letters of its own: a match can begin and end at words only.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        number: dict[bytes, int] = {}
        for _, text in items:
            for w in words_of(text):
                number.setdefault(w, len(number))
        self.width = 1
        while BASE**self.width < len(number):
            self.width += 1
        self.code = {w: "".join(chr(1 + BASE * k + n // BASE**k % BASE) for k in range(self.width)) for w, n in number.items()}
        self.other = "\0" * self.width
        found: dict[str, tuple[str, ...]] = {}
        for name, text in items:
            codes = [self.code[w] for w in words_of(text)]
            for i in range(max(1, len(codes) - window + 1) if codes else 0):
                key = "".join(codes[i : i + window])
                names = found.setdefault(key, ())
                if name is not None and name not in names:
                    found[key] = (*names, name)
        self.automaton = ahocorasick.Automaton() if found else None
        while found:
            key, names = found.popitem()
            self.automaton.add_word(key, (len(key) // self.width, names))
        if self.automaton is not None:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[set[tuple[int, int]], set[str]]:
        """First word and the one after the last of each match; item ids."""
        places, names = set(), set()
        if self.automaton is not None and words:
            for end, (length, items) in self.automaton.iter("".join(map(self.code.get, words, repeat(self.other)))):
                stop = (end + 1) // self.width
                places.add((stop - length, stop))
                names.update(items)
        return places, names


def result(text: bytes, n_words: int, places: set[tuple[int, int]], names: set[str]) -> dict:
    """RESULT of a text with its matches: item ids sorted as strings, hit spans in characters of the original."""
    out = {"n_words": n_words, "n_hit": 0, "items": sorted(names), "spans": []}
    if not places:
        return out
    folded = text.translate(FOLD)
    word = np.frombuffer(folded, np.uint8) != 32
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    change = np.zeros(n_words + 1, np.int64)
    at = np.array(list(places), np.int64)
    np.add.at(change, at[:, 0], 1)
    np.add.at(change, at[:, 1], -1)
    hit = np.cumsum(change[:-1]) > 0
    run = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    first, after = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    spans = zip(chars[starts[first]].tolist(), chars[stops[after]].tolist(), strict=True)
    return out | {"n_hit": int(hit.sum()), "spans": [{"start": a, "stop": b} for a, b in spans]}


_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _texts(column: pa.Array) -> list[bytes]:
    data, at = text_bytes(column)
    raw = data.tobytes()
    return [raw[at[i] : at[i + 1]] for i in range(len(at) - 1)]


def scanner(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = 10, part_bytes: int = PART_BYTES):
    """A function from a text column to a struct column RESULT, with the benchmark's items broadcast in parts."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // part_bytes))
    parts = []
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i) if n > 1 else rows
        parts.append(spark.sparkContext.broadcast([(r.k, r.t.encode()) for r in part.toLocalIterator()]))
    held: dict = {}

    @F.arrow_udf(RESULT)
    def by_one(column: pa.Array) -> pa.Array:
        if not held:
            held["part"] = Part(parts[0].value, window)
        out = []
        for t in _texts(column):
            words = words_of(t)
            out.append(result(t, len(words), *held["part"].hits(words)))
        return pa.array(out, _RESULT)

    def settled(batches: list[list[bytes]]) -> Iterator[pa.Array]:
        """The results of some batches: each part's automaton is built once and meets all their texts."""
        found = [[(set(), set()) for _ in b] for b in batches]
        for p in parts:
            one = Part(p.value, window)
            for texts, own in zip(batches, found, strict=True):
                for t, (places, names) in zip(texts, own, strict=True):
                    more, who = one.hits(words_of(t))
                    places |= more
                    names |= who
        for texts, own in zip(batches, found, strict=True):
            yield pa.array([result(t, len(words_of(t)), *f) for t, f in zip(texts, own, strict=True)], _RESULT)

    @F.arrow_udf(RESULT)
    def by_several(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        batches, size = [], 0
        for column in columns:
            batches.append(_texts(column))
            size += sum(map(len, batches[-1]))
            if size >= HELD:
                yield from settled(batches)
                batches, size = [], 0
        yield from settled(batches)

    return by_one if n == 1 else by_several


def find(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of ``docs``: doc id, n_words, n_hit, items, spans (in characters of the original). No shuffle."""
    scanned = scanner(benchmark, item, item_text, window, part_bytes)
    return docs.select(F.col(doc), scanned(F.col(text)).alias("r")).select(doc, "r.*")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text holds no window of any item."""
    scanned = scanner(benchmark, options.get("item", "item_id"), options.get("item_text", "text"), options.get("window", 10), options.get("part_bytes", PART_BYTES))
    return docs.where(scanned(F.col(options.get("text", "text")))["n_hit"] == 0)


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
