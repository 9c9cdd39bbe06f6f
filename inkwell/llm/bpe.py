"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each match of the splitting pattern (a piece) is encoded apart. Leaf i of its tree holds the rank of the pair that
starts at live position i, joined with i itself, so the minimum at the root is the leftmost pair of least rank. A merge
at i takes the next live position out and puts three leaves anew (i, the one before, the one taken out), each with a
logarithmic walk to the root. ``encode_piece`` does so for one piece of any length; ``encode_pieces`` for many short
pieces at once, one tree a row, so that each step of all rows is a few numpy operations. Pieces that were seen before
come from a bounded table.

Ids are ranks; decoding joins the ids' bytes. Defined cases: null is the empty text, which has no ids; a repeated or
very long text is a text like any other; other columns are ignored.
"""

from __future__ import annotations

import base64
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import ranges, sha, slices, text_bytes

_NONE = np.int64(1) << 60
_SHORT = 32
#: A worker's table of pieces starts anew beyond so many pieces, or so many characters in pieces of over TABLE_BYTES.
TABLE_PIECES, TABLE_BYTES, TABLE_LONG = 600_000, 64, 1 << 24


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: The splitting pattern that ``Splitter`` carries out with array operations; any other goes to the regex library.
RUNS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHORT_ENDS = ("s", "t", "m", "d")
_LONG_ENDS = ("re", "ve", "ll")
_SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Splitter:
    """The matches of RUNS_PATTERN: runs of letters, numbers, white space or the rest, found from each character's kind.

    A run takes the blank before it. Of white space before such a run the last character stands alone if it isn't a
    blank. An apostrophe that begins a run, with no blank before it, takes a short ending with it first.
    """

    def __init__(self):
        letter = {"L": 0, "N": 1}
        self.kind = np.full(sys.maxunicode + 1, 2, np.uint8)
        for c in range(sys.maxunicode + 1):
            self.kind[c] = letter.get(unicodedata.category(chr(c))[0], 2)
        self.kind[[ord(c) for c in _SPACES]] = 3

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Places where a piece begins, for one text of code points (not empty)."""
        kind, n = self.kind[points], len(points)
        begins = np.ones(n, bool)
        begins[1:] = kind[1:] != kind[:-1]
        heads = np.flatnonzero(begins & (kind != 3))
        heads = heads[heads > 0]
        before = heads[kind[heads - 1] == 3]
        # The last white space before a run begins a piece; a blank takes the run along.
        begins[before - 1] = True
        begins[before[points[before - 1] == 32]] = False
        marks = np.flatnonzero((points == 39) & begins)
        if len(marks):
            at = lambda k: np.where(marks + k < n, points[np.minimum(marks + k, n - 1)], 0)
            one, two = at(1), at(2)
            size = np.zeros(len(marks), np.int64)
            for end in _LONG_ENDS:
                size[(one == ord(end[0])) & (two == ord(end[1]))] = 3
            for end in _SHORT_ENDS:
                size[one == ord(end)] = 2
            marks, size = marks[size > 0], size[size > 0]
            for k in (1, 2):
                begins[marks[size > k] + k] = False
            after = marks + size
            more = after < n
            after = after[more]
            if len(after):
                # What follows begins anew; a blank there takes its run along as before, which ``begins`` has already.
                begins[after] = True
        return np.flatnonzero(begins)

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        at = self.cuts(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).tolist()
        at.append(len(text))
        return [text[a:b] for a, b in zip(at, at[1:])]  # noqa: B905


def splitter(pattern: str):
    """A function from a text to the pattern's matches."""
    if pattern == RUNS_PATTERN:
        return Splitter()
    import regex

    return regex.compile(pattern).findall


class Vocabulary:
    """Ranks, the pairs that merge, and the bytes of ids, all as flat arrays."""

    def __init__(self, path: str):
        self.ranks = ranks = read_ranks(path)
        n = max(ranks.values(), default=-1) + 1
        by_id = [b""] * n
        for token, i in ranks.items():
            by_id[i] = token
        self.sizes = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        said = [f"{i} ".encode() for i in range(n)]
        self.said_sizes = np.array([len(t) for t in said], np.int64)
        self.said_starts = np.concatenate([[0], np.cumsum(self.said_sizes)])[:-1]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary has a rank for each byte")
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pairs = pairs
        # Open addressing: key and rank at the first free place after the key's hash.
        size = 1 << max(4, (2 * len(pairs)).bit_length())
        self.mask, self.keys, self.values = size - 1, np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        left, left_value = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        place = self._place(left)
        while len(left):
            free = self.keys[place] < 0
            spot, first = np.unique(place[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[spot], self.values[spot] = left[chosen], left_value[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, left_value, place = left[rest], left_value[rest], (place[rest] + 1) & self.mask

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(30)).astype(np.int64) & self.mask

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or _NONE."""
        key = a << 20 | b
        place = self._place(key)
        out, found = np.full(len(key), _NONE, np.int64), self.keys[place]
        out[found == key] = self.values[place[found == key]]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & self.mask
            found = self.keys[place[open_]]
            same = found == key[open_]
            out[open_[same]] = self.values[place[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.blob[ranges(self.starts[ids], self.sizes[ids])]

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each with a space after it, and their lengths."""
        return self.said[ranges(self.said_starts[ids], self.said_sizes[ids])], self.said_sizes[ids]


def encode_piece(piece: bytes, v: Vocabulary) -> list[int]:
    """One piece of any length by one tree."""
    n = len(piece)
    if n < 2:
        return [int(v.single[b]) for b in piece]
    none, pairs = int(_NONE), v.pairs
    ids = v.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1 << (n - 1).bit_length()
    bits = width.bit_length()
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = pairs.get(ids[i] << 20 | ids[i + 1])
        if rank is not None:
            tree[width + i] = rank << bits | i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    def pair(i: int) -> int:
        j = after[i]
        rank = pairs.get(ids[i] << 20 | ids[j]) if j < n else None
        return none if rank is None else rank << bits | i

    while tree[1] != none:
        i, rank = tree[1] & ((1 << bits) - 1), tree[1] >> bits
        j = after[i]
        ids[i], after[i] = rank, after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """The ids of each piece; short ones together, a tree a row."""
    out: list = [None] * len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    for i in np.flatnonzero((sizes < 2) | (sizes > _SHORT)):
        out[i] = np.array(encode_piece(pieces[i], v), np.int32)
    low = 1
    for width in (4, 8, 16, _SHORT):
        rows = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for at in range(0, len(rows), 20_000):
            chosen = rows[at : at + 20_000]
            for i, ids in zip(chosen, _encode_rows([pieces[k] for k in chosen], sizes[chosen], width, v), strict=True):
                out[i] = ids
    return out


def _encode_rows(pieces: list[bytes], sizes: np.ndarray, width: int, v: Vocabulary) -> list[np.ndarray]:
    n, bits = len(pieces), np.int64(width.bit_length())
    if not n:
        return []
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    ids = v.single[flat]
    column = np.arange(width)
    live = column[None, :] < sizes[:, None]
    ids[~live] = -1
    after, before = np.broadcast_to(column + 1, (n, width)).copy(), np.broadcast_to(column - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), _NONE, np.int64)
    r, c = np.nonzero(column[None, :] < sizes[:, None] - 1)
    rank = v.pair_ranks(ids[r, c], ids[r, c + 1])
    tree[r, width + c] = np.where(rank == _NONE, _NONE, rank << bits | c)
    for level in range(width.bit_length() - 2, -1, -1):
        k = 1 << level
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
    open_ = np.flatnonzero(tree[:, 1] != _NONE)
    while len(open_):
        top = tree[open_, 1]
        i = top & ((np.int64(1) << bits) - 1)
        j = after[open_, i]
        ids[open_, i] = top >> bits
        ids[open_, j] = -1
        then = after[open_, j]
        after[open_, i] = then
        has = then < sizes[open_]
        before[open_[has], then[has]] = i[has]
        _put(tree, open_, j, np.full(len(open_), _NONE, np.int64), width)
        mine = np.full(len(open_), _NONE, np.int64)
        rank = v.pair_ranks(ids[open_[has], i[has]], ids[open_[has], then[has]])
        mine[has] = np.where(rank == _NONE, _NONE, rank << bits | i[has])
        _put(tree, open_, i, mine, width)
        prior = before[open_, i]
        has = prior >= 0
        rows, prior = open_[has], prior[has]
        rank = v.pair_ranks(ids[rows, prior], ids[rows, i[has]])
        _put(tree, rows, prior, np.where(rank == _NONE, _NONE, rank << bits | prior), width)
        open_ = open_[tree[open_, 1] != _NONE]
    kept = ids >= 0
    return np.split(ids[kept].astype(np.int32), np.cumsum(kept.sum(1))[:-1])


def _put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
    k = leaf + width
    tree[rows, k] = value
    while width > 1:
        width >>= 1
        k = k >> 1
        tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])


class Encoder:
    """Encodes texts with a bounded table of pieces."""

    def __init__(self, path: str, pattern: str):
        self.v, self.split = Vocabulary(path), splitter(pattern)
        self.fresh()

    def fresh(self) -> None:
        self.number: dict[str, int] = {}
        self.long = 0
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.count = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        for text, ids in zip(pieces, encode_pieces(raw, self.v), strict=True):
            k = len(self.number)
            if k == len(self.start):
                self.start, self.count = np.resize(self.start, 2 * k), np.resize(self.count, 2 * k)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.start[k], self.count[k] = self.used, len(ids)
            self.used += len(ids)
            self.number[text] = k
            self.long += len(text) if len(text) > TABLE_BYTES else 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each has."""
        pieces = [self.split(t) for t in texts]
        fresh = {p for own in pieces for p in own}.difference(self.number)
        if len(self.number) + len(fresh) > TABLE_PIECES:
            self.fresh()
            fresh = {p for own in pieces for p in own}
        self._learn(sorted(fresh))
        get, flat = self.number.__getitem__, []
        for own in pieces:
            flat.extend(map(get, own))
        codes = np.array(flat, np.int64)
        counts = self.count[codes]
        ids = self.ids[ranges(self.start[codes], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, pieces)])]
        if self.long > TABLE_LONG:
            self.fresh()
        return ids, np.diff(ends)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


_DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str, pattern: str, *, doc: str = "doc_id", text: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """Per row: doc id and its ids (array<int>)."""

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        coder, out = encoder(path, pattern), []
        _, at = text_bytes(column)
        for a, b in slices(at, slice_bytes):
            flat, counts = coder.encode(column.slice(a, b - a).fill_null("").to_pylist())
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return docs.select(F.col(doc), ids(F.col(text)).alias("ids"))


def decode(encoded: DataFrame, path: str, *, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc id and the decoded bytes."""
    held: dict = {}

    @F.arrow_udf("binary")
    def back(column: pa.Array) -> pa.Array:
        if not held:
            held["v"] = Vocabulary(path)
        return pa.array([held["v"].decode(np.array(x or [], np.int64)).tobytes() for x in column.to_pylist()], pa.binary())

    return encoded.select(F.col(doc), back(F.col(ids)).alias("decoded"))


def digests(docs: DataFrame, path: str, pattern: str, *, doc: str = "doc_id", text: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """Per row: n_tokens, and SHA-256 of the ids in decimal joined by a space and of the bytes decoded from them. No shuffle."""

    @F.arrow_udf("struct<n_tokens:long, ids_sha256:string, decoded_sha256:string>")
    def told(column: pa.Array) -> pa.Array:
        coder = encoder(path, pattern)
        v, out = coder.v, []
        _, at = text_bytes(column)
        for a, b in slices(at, slice_bytes):
            flat, counts = coder.encode(column.slice(a, b - a).fill_null("").to_pylist())
            flat, ends = flat.astype(np.int64), np.concatenate([[0], np.cumsum(counts)])
            said, said_sizes = v.spell(flat)
            said_at = np.concatenate([[0], np.cumsum(said_sizes)])[ends]
            back, back_at = v.decode(flat), np.concatenate([[0], np.cumsum(v.sizes[flat])])[ends]
            for i, n in enumerate(counts.tolist()):
                out.append({"n_tokens": n, "ids_sha256": sha(said[said_at[i] : max(said_at[i], said_at[i + 1] - 1)].tobytes()), "decoded_sha256": sha(back[back_at[i] : back_at[i + 1]].tobytes())})
        return pa.array(out, _DIGESTS)

    return docs.select(F.col(doc), told(F.col(text)).alias("r")).select(doc, "r.*")
