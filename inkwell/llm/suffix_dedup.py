"""Suffix-array dedup: a distributed merge sort of anchored suffixes, front-coded in exchange.

Every byte goes that lies in a string of ``LENGTH`` (50) bytes which also starts in a document with a smaller id.

Which suffixes are sorted. Each window of 50 bytes names the leftmost of its 20-byte strings of least hash, its anchor.
Equal windows have equal anchors at equal places, so it is enough to sort, for each anchor, the stretch of text that its
windows cover, as a suffix that begins at the anchor (with what lies before it read backwards behind it). There is one
such record for about sixteen bytes of text.

Steps, all over runs (stretches of whole documents, ``RUN_BYTES`` or one document each):
 1. Runs are packed once, compressed, into a table in the shared folder.
 2. Runs exchange sorted anchor hashes. An anchor seen in one document only can't be in a repeat; the others are told
    back to their runs. This drops no repeat: equal anchors have equal hashes.
 3. Each run sorts its records, joins equal ones (keeping least and greatest id), cuts the order at splitters and
    exchanges front-coded runs: for each record the length of the prefix it shares with the one before, and the rest.
    A passage that a run holds a thousand times is one record, so a hot passage costs a reducer one record for a run.
 4. A reducer merges its runs by a loser tree. Contestants carry the length of the prefix they share with the last
    winner: the longer wins unread; only equal lengths are compared, and from that length on. The lengths that come out
    mark records that are equal and records of one anchor. For each window of an anchor the least id that has it is
    found, and each run gets back, for its records, the windows whose least id is below its greatest.
 5. Runs mark the bytes of these windows in the documents with a greater id.

Defined cases: null is the empty text; a null id sorts before all others; rows with one id never remove from each other,
so repeated rows stay unless a smaller id has the text; ids that are no integers are numbered in their order first; texts
under 50 bytes stay; an empty table gives no rows; other
columns are ignored. Memory is that of a run or of a reducer's share; the number of shares
follows the input, and their borders are whole anchors of 20 bytes.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from inkwell.llm.common import bounded_batches, materialize, ranges, text_bytes
from inkwell.llm.words import mix

LENGTH, ANCHOR = 50, 20
RUN_BYTES, SHARE_BYTES = 4 << 20, 8 << 20
#: Windows that a reducer looks at together (those of one anchor at least).
SLICE_WINDOWS = 400_000
_SPAN = LENGTH - ANCHOR + 1  # anchors' places in a window
_WIDTH = LENGTH + 1 + (LENGTH - ANCHOR) + 1  # a record: text from the anchor, its length, text before it backwards, its length
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_NULL_ID = -(1 << 63)
#: Bits of an anchor's hash that runs exchange: 47 of the hash, and one that tells whether a run has it in two documents.
_HASH_BITS = 48


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 20 bytes from each place, by doubling; places too near the end are left out."""
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = data.astype(np.uint64) + np.uint64(1)
    m = np.uint64(0x9E3779B97F4A7C15)
    two = one[:-1] * m + one[1:]
    four = two[:-2] * np.uint64(0xA24BAED4963EE407) + two[2:]
    eight = mix(four[:-4] * np.uint64(0xD6E8FEB86659FD93) + four[4:])
    sixteen = eight[:-8] * np.uint64(0xC2B2AE3D27D4EB4F) + eight[8:]
    return mix(sixteen[:n] * np.uint64(0x94D049BB133111EB) + four[16 : 16 + n])


def _sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """The least or greatest of each ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        x = take(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return take(x[: len(x) - rest], x[rest:]) if rest else x


#: Windows of a run that are worked on together, as hashes take many times the text's size.
PIECE = 1 << 19


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last window start of each anchor; texts end at ``ends``. An anchor on a border of pieces has its windows in two parts."""
    parts = []
    for a in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        b = min(len(data), a + PIECE + LENGTH - 1)
        own = ends[(ends > a) & (ends < b)] - a
        h, *places = _anchors(data[a:b], np.append(own, b - a))
        parts.append((h, *(x + a for x in places)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    if len(data) < LENGTH:
        return none
    h = anchor_hashes(data)
    starts = np.concatenate([[0], ends[:-1]])
    # No anchor crosses a text's end, and windows that do are not ours.
    cross = ranges(np.maximum(starts, ends - ANCHOR + 1), ends - np.maximum(starts, ends - ANCHOR + 1))
    h[cross[cross < len(h)]] = _TOP
    least = _sliding(h, _SPAN, np.minimum)
    valid = np.ones(len(least), bool)
    low = np.maximum(starts, ends - LENGTH + 1)
    bad = ranges(low, ends - low)
    valid[bad[bad < len(valid)]] = False
    # Windows in a row of one least hash, cut where validity changes.
    edge = np.ones(len(least), bool)
    edge[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(edge)
    last = np.concatenate([first[1:], [len(least)]]) - 1
    first, last = first[valid[first]], last[valid[first]]
    if not len(first):
        return none
    chosen = np.zeros(len(h), bool)
    held = np.concatenate([np.zeros(_SPAN - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(_SPAN - 1, np.uint64)])
    chosen = _sliding(held, _SPAN, np.maximum)[: len(h)] == h
    place = np.flatnonzero(chosen)
    out: list[list[np.ndarray]] = [[], [], []]
    while len(first):
        k = np.searchsorted(place, first)
        wrong = np.flatnonzero(h[place[k]] != least[first])
        while len(wrong):
            k[wrong] += 1
            wrong = wrong[h[place[k[wrong]]] != least[first[wrong]]]
        at = place[k]
        stop = np.minimum(at, last)
        for have, new in zip(out, (at, first, stop), strict=True):
            have.append(new)
        more = at < last
        first, last = at[more] + 1, last[more]
    at, first, stop = (np.concatenate(x) for x in out)
    order = np.argsort(at, kind="stable")
    return h[at[order]], at[order], first[order], stop[order]


def records(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The stretch of each anchor's windows as a fixed row of bytes that sorts by the text from the anchor."""
    out = np.zeros((len(at), _WIDTH), np.uint8)
    for k in range(0, len(at), 1 << 14):
        part = slice(k, k + (1 << 14))
        own, here = out[part], at[part]
        after, before = last[part] + LENGTH - here, here - first[part]
        column = np.arange(LENGTH)
        place = np.minimum(here[:, None] + column, len(data) - 1)
        own[:, :LENGTH] = np.where(column < after[:, None], data[place], 0)
        own[:, LENGTH] = after
        column = np.arange(LENGTH - ANCHOR)
        place = np.maximum(here[:, None] - 1 - column, 0)
        own[:, LENGTH + 1 : -1] = np.where(column < before[:, None], data[place], 0)
        own[:, -1] = before + 1
    return out


def shared_prefix(rows: np.ndarray) -> np.ndarray:
    """For each row the length of the prefix it shares with the row before (0 for the first)."""
    out = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> bytes:
    """Sorted rows as shared prefix lengths, then the rests one after the other."""
    shared = shared_prefix(rows)
    rest = rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]]
    return shared.tobytes() + rest.tobytes()


def front_read(data: bytes, n: int):
    """(shared prefix length, row) of each row of a front-coded run."""
    at, row = n, b""
    for k in data[:n]:
        step = at + _WIDTH - k
        row = row[:k] + data[at:step]
        at = step
        yield k, row


class LoserTree:
    """Merges sorted runs of rows of one length, knowing of each row the prefix it shares with the row before."""

    def __init__(self, runs: list):
        self.runs, self.n = runs, len(runs)
        self.heads: list = [None] * self.n
        self.known = [0] * self.n
        for i, run in enumerate(runs):
            self.heads[i] = next(run, (0, None))[1]
        self.losers = [-1] * self.n
        self.winner = self._build(1) if self.n else -1

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, self.losers[node] = self._play(a, b)
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is then the one it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        k, m = self.known[a], self.known[b]
        if k != m:
            return (a, b) if k > m else (b, a)
        x, y = x[k:], y[k:]
        if x == y:
            self.known[b] = _WIDTH
            return a, b
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        at = _WIDTH - (differ.bit_length() + 7) // 8
        if x < y:
            self.known[b] = at
            return a, b
        self.known[a] = at
        return b, a

    def __iter__(self):
        """(run, prefix shared with the row that came out before)."""
        n, heads, known, losers, play = self.n, self.heads, self.known, self.losers, self._play
        w = self.winner
        while n and heads[w] is not None:
            yield w, known[w]
            known[w], heads[w] = next(self.runs[w], (0, None))
            node = (w + n) >> 1
            while node:
                other = losers[node]
                # The common case, unread: known prefixes of different length.
                if heads[w] is not None and heads[other] is not None and known[w] != known[other]:
                    if known[other] > known[w]:
                        w, losers[node] = other, w
                else:
                    w, losers[node] = play(w, other)
                node >>= 1


def _zip(data: bytes, level: int = 1) -> bytes:
    return zstandard.compress(data, level)


def _unzip(data) -> bytes:
    return zstandard.decompress(data)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, which compresses."""
    return _zip(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()) if len(x) else b""


def unplanes(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(_unzip(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)


RUNS = "run long, ids array<long>, ends array<long>, text binary, sample array<binary>"
_RUNS = pa.schema([("run", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("text", pa.binary()), ("sample", pa.list_(pa.binary()))])
#: Places of a run whose text tells where to cut the order; at most so many of all runs are gathered.
SAMPLE, SAMPLES = 64, 1 << 20
#: Shares at most; beyond, a share grows with the input.
SHARES = 1 << 18


def pack(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Step 1. ``docs`` has columns id and text."""

    def packed(batches):
        part, k = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def run():
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            whole = b"".join(texts)
            # Anchors fall on places by their hash alone, so text at even places is spread as that at anchors.
            places = np.unique(np.linspace(0, len(whole) - ANCHOR, SAMPLE).astype(np.int64)) if len(whole) >= ANCHOR else []
            sample = [whole[p : p + ANCHOR] for p in places]
            return _batch(_RUNS, run=[part << 32 | k], ids=[ids], ends=[ends], text=[_zip(whole, 6)], sample=[sample])

        for b in batches:
            data, at = text_bytes(b["text"])
            raw = data.tobytes()
            for i, key in enumerate(b["id"].to_pylist()):
                ids.append(key)
                texts.append(raw[at[i] : at[i + 1]])
                size += len(texts[-1])
                if size >= run_bytes:
                    yield run()
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield run()

    return docs.mapInArrow(packed, RUNS)


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(_unzip(batch["text"][i].as_buffer()), np.uint8)
    ids = np.array([_NULL_ID if k is None else k for k in batch["ids"][i].as_py()], np.int64)
    return data, ids, np.array(batch["ends"][i].as_py(), np.int64)


def _code(h: np.ndarray) -> np.ndarray:
    """47 bits of a hash, and room for the flag below."""
    return (h >> np.uint64(64 - _HASH_BITS + 1)) << np.uint64(1)


PART = "share int, run long, data binary"
_PART = pa.schema([("share", pa.int32()), ("run", pa.int64()), ("data", pa.binary())])


def _offer(shares: int):
    """Step 2, runs: sorted codes of the anchors, flagged where two ids of the run have them."""

    def offered(batches):
        for b in batches:
            for i in range(b.num_rows):
                data, ids, ends = _unpack(b, i)
                h, at, _, _ = anchors(data, ends)
                owner = ids[np.searchsorted(ends, at, side="right")]
                order = np.lexsort((owner, h))
                code, owner = _code(h[order]), owner[order]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                last = np.concatenate([first[1:], [len(code)]]) - 1 if len(code) else first
                # Codes of equal hashes are in a row; of two hashes with one code the flag may be set in vain, never missed.
                both = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(first) else np.zeros(0, bool)
                code = code[first] | both.astype(np.uint64)
                share = (code >> np.uint64(_HASH_BITS - 24)).astype(np.int64) * shares >> 24
                cut = np.searchsorted(share, np.arange(shares + 1))
                del last
                used = np.flatnonzero(np.diff(cut))
                yield _batch(_PART, share=used, run=np.full(len(used), b["run"][i].as_py(), np.int64), data=[planes(code[cut[s] : cut[s + 1]]) for s in used])

    return offered


def _answer(table: pa.Table) -> pa.Table:
    """Step 2, reducers: the codes that several documents have, back to their runs."""
    parts = [unplanes(x.as_py(), np.uint64) for x in table["data"]]
    code = np.concatenate([p >> np.uint64(1) for p in parts])
    order = np.argsort(code, kind="stable")
    run = code[order]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    first = np.flatnonzero(new)
    many = np.diff(np.concatenate([first, [len(run)]])) > 1
    flag = np.concatenate([p & np.uint64(1) for p in parts])[order]
    many |= np.bitwise_or.reduceat(flag, first) == 1
    kept = np.zeros(len(code), bool)
    kept[order] = many[np.cumsum(new) - 1]
    out, at = {"share": [], "run": [], "data": []}, 0
    for name, p in zip(table["run"].to_pylist(), parts, strict=True):
        own = p[kept[at : at + len(p)]]
        at += len(p)
        if len(own):
            out["share"].append(0)
            out["run"].append(name)
            out["data"].append(planes(own >> np.uint64(1)))
    return pa.Table.from_pydict(out, schema=_PART)


SORTED = "share int, run long, n long, rows binary, low binary, high binary, base long"
_SORTED = pa.schema([("share", pa.int32()), ("run", pa.int64()), ("n", pa.int64()), ("rows", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("base", pa.int64())])


def _shared_anchors(data, ends, told):
    """The anchors whose codes other documents have as well."""
    h, at, first, last = anchors(data, ends)
    codes = np.sort(np.concatenate([unplanes(x, np.uint64) for x in told])) if told else np.zeros(0, np.uint64)
    if not len(codes):
        return at[:0], first[:0], last[:0]
    mine = _code(h) >> np.uint64(1)
    k = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
    kept = codes[k] == mine
    return at[kept], first[kept], last[kept]


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, the first of each distinct one in it, and the distinct rows."""
    flat = np.ascontiguousarray(rows).view(f"S{_WIDTH}").ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    return order, first, rows[order[first]]


def splitters(samples: list[bytes], shares: int) -> np.ndarray:
    """Anchors that cut the order into at most ``shares`` shares of like size. Records of one anchor are never cut apart."""
    held = np.sort(np.array(samples, f"S{ANCHOR}"))
    return np.unique(held[np.arange(1, shares) * len(held) // shares]) if len(held) else held


def _sort(sent):
    """Step 3: front-coded sorted runs, cut at the splitters of a broadcast."""

    def sorted_(batches):
        cuts = sent.value
        for b in batches:
            for i in range(b.num_rows):
                data, ids, ends = _unpack(b, i)
                at, first, last = _shared_anchors(data, ends, b["told"][i].as_py() or [])
                if not len(at):
                    continue
                order, lead, rows = _order(records(data, at, first, last))
                owner = ids[np.searchsorted(ends, at, side="right")][order]
                low, high = np.minimum.reduceat(owner, lead), np.maximum.reduceat(owner, lead)
                share = np.searchsorted(cuts, np.ascontiguousarray(rows[:, :ANCHOR]).view(f"S{ANCHOR}").ravel(), side="right")
                edge = np.searchsorted(share, np.arange(len(cuts) + 2))
                used = np.flatnonzero(np.diff(edge))
                parts = [slice(edge[s], edge[s + 1]) for s in used]
                coded = {"rows": [_zip(front_code(rows[p])) for p in parts], "low": [planes(low[p]) for p in parts], "high": [planes(high[p]) for p in parts]}
                yield _batch(_SORTED, share=used, run=np.full(len(used), b["run"][i].as_py(), np.int64), n=edge[used + 1] - edge[used], base=edge[used], **coded)

    return sorted_


FOUND = "run long, record binary, start binary, stop binary, least binary"
_FOUND = pa.schema([("run", pa.int64()), ("record", pa.binary()), ("start", pa.binary()), ("stop", pa.binary()), ("least", pa.binary())])


def window_hash(sums: np.ndarray, power: np.ndarray) -> np.ndarray:
    return mix(sums * power)


def _window_least(rows: np.ndarray, group: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each distinct record: the record, its place there, and the least id that has the window.

    Windows are equal if their anchors are, at equal places, and their bytes are.
    """
    after, before = rows[:, LENGTH].astype(np.int64), rows[:, -1].astype(np.int64) - 1
    # The stretch in text order.
    width = 2 * LENGTH - ANCHOR
    column = np.arange(width)
    place = np.where(column < before[:, None], LENGTH + before[:, None] - column, column - before[:, None])
    flat = np.take_along_axis(rows, np.minimum(place, _WIDTH - 1), 1)
    size = after + before
    count = size - LENGTH + 1
    record = np.repeat(np.arange(len(rows)), count)
    offset = ranges(np.zeros(len(rows), np.int64), count)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(width, 0x9E3779B97F4A7C15, np.uint64)]))
    sums = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:width], axis=1, dtype=np.uint64)], axis=1)
    hashed = window_hash(sums[record, offset + LENGTH] - sums[record, offset], power[width - offset])
    slot = group[record] * np.int64(64) + (before[record] - offset)
    order = np.lexsort((hashed, slot))
    s, h = slot[order], hashed[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])])
    first = np.flatnonzero(new)
    # Equal hashes must be equal bytes; where they are not, the bytes themselves tell the windows apart.
    kept = np.cumsum(new) - 1
    a, b = order, order[first][kept]
    span = np.arange(LENGTH)
    for at in range(0, len(a), 100_000):
        x, y = a[at : at + 100_000], b[at : at + 100_000]
        if (flat[record[x][:, None], offset[x][:, None] + span] != flat[record[y][:, None], offset[y][:, None] + span]).any():
            # A byte of 1 ends each, as numpy drops zeros there.
            whole = np.ones((len(record), LENGTH + 1), np.uint8)
            whole[:, :LENGTH] = flat[record[:, None], offset[:, None] + span]
            _, hashed = np.unique(whole.view(f"S{LENGTH + 1}").ravel(), return_inverse=True)
            order = np.lexsort((hashed, slot))
            s, h = slot[order], hashed[order]
            first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])]))
            kept = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
            break
    least = np.empty(len(order), np.int64)
    least[order] = np.minimum.reduceat(low[record[order]], first)[kept]
    return record, offset, least


def _merge(table: pa.Table) -> pa.Table:
    """Step 4."""
    n = table["n"].to_pylist()
    run = np.repeat(np.arange(len(n)), n)
    low = np.concatenate([unplanes(x.as_py(), np.int64) for x in table["low"]])
    high = np.concatenate([unplanes(x.as_py(), np.int64) for x in table["high"]])
    total = len(low)
    tree = LoserTree([front_read(_unzip(x.as_buffer()), k) for x, k in zip(table["rows"], n, strict=True)])
    at = np.concatenate([[0], np.cumsum(n)])[:-1].tolist()
    came, known = np.empty(total, np.int64), np.empty(total, np.uint8)
    for k, (r, shared) in enumerate(tree):
        came[k], known[k] = at[r], shared
        at[r] += 1
    del tree
    distinct = np.cumsum(known < _WIDTH) - 1
    lead = np.flatnonzero(known < _WIDTH)
    group = np.cumsum(known[lead] < ANCHOR) - 1
    low_of, high_of = np.minimum.reduceat(low[came], lead), np.maximum.reduceat(high[came], lead)
    g = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([g, [len(group)]]))
    open_ = np.minimum.reduceat(low_of, g) != np.maximum.reduceat(high_of, g)
    alone = np.flatnonzero(open_ & (size == 1))
    # One stretch alone at its anchor: all of its windows have its least id.
    heads = _rows_of(table, n, came[lead])
    lengths = heads[:, LENGTH].astype(np.int64) + heads[:, -1] - 1
    found = [(g[alone], np.zeros(len(alone), np.int64), lengths[g[alone]] - LENGTH, low_of[g[alone]])]
    several = np.flatnonzero(open_ & (size > 1))
    bound = np.cumsum(size[several]) * _SPAN // SLICE_WINDOWS if len(several) else np.zeros(0, np.int64)
    for part in np.split(several, np.flatnonzero(np.diff(bound)) + 1) if len(several) else []:
        own = ranges(g[part], size[part])
        record, offset, least = _window_least(heads[own], group[own], low_of[own])
        edge = np.concatenate([[True], (record[1:] != record[:-1]) | (least[1:] != least[:-1])])
        first = np.flatnonzero(edge)
        last = np.concatenate([first[1:], [len(edge)]]) - 1
        found.append((own[record[first]], offset[first], offset[last], least[first]))
    which, start, stop, least = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(which, kind="stable")
    which, start, stop, least = which[order], start[order], stop[order], least[order]
    # To every run that has such a record with a greater id.
    begin, end = np.searchsorted(which, np.arange(len(lead))), np.searchsorted(which, np.arange(len(lead)), side="right")
    many = (end - begin)[distinct]
    source = np.repeat(came, many)
    piece = ranges(begin[distinct], many)
    kept = least[piece] < high[source]
    source, piece = source[kept], piece[kept]
    order = np.argsort(source, kind="stable")
    source, piece = source[order], piece[order]
    base = np.concatenate([[0], np.cumsum(n)])
    out = {"run": [], "record": [], "start": [], "stop": [], "least": []}
    cut = np.searchsorted(source, base)
    for k, (name, shift) in enumerate(zip(table["run"].to_pylist(), table["base"].to_pylist(), strict=True)):
        part = slice(cut[k], cut[k + 1])
        if cut[k] < cut[k + 1]:
            out["run"].append(name)
            out["record"].append(planes((source[part] - base[k] + shift).astype(np.int32)))
            out["start"].append(planes(start[piece[part]].astype(np.uint8)))
            out["stop"].append(planes(stop[piece[part]].astype(np.uint8)))
            out["least"].append(planes(least[piece[part]]))
    return pa.Table.from_pydict(out, schema=_FOUND)


def _rows_of(table: pa.Table, n: list[int], wanted: np.ndarray) -> np.ndarray:
    """Some rows of the front-coded runs, run by run."""
    out = np.empty((len(wanted), _WIDTH), np.uint8)
    order = np.argsort(wanted, kind="stable")
    ordered, at = wanted[order], 0
    for data, size in zip(table["rows"], n, strict=True):
        a, b = np.searchsorted(ordered, [at, at + size])
        if a < b:
            rows = np.frombuffer(b"".join(row for _, row in front_read(_unzip(data.as_buffer()), size)), np.uint8).reshape(size, _WIDTH)
            out[order[a:b]] = rows[ordered[a:b] - at]
        at += size
    return out


RESULT = "id long, n_bytes long, spans array<struct<start:long, stop:long>>, kept binary"
_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def _mark(batches):
    """Step 5."""
    for b in batches:
        for i in range(b.num_rows):
            data, ids, ends = _unpack(b, i)
            change = np.zeros(len(data) + 1, np.int32)
            found = b["found"][i].as_py() or []
            if found:
                at, first, last = _shared_anchors(data, ends, b["told"][i].as_py() or [])
                order, lead, _ = _order(records(data, at, first, last))
                count = np.diff(np.concatenate([lead, [len(order)]]))
                owner = ids[np.searchsorted(ends, at, side="right")]
                for f in found:
                    record = unplanes(f["record"], np.int32)
                    many = count[record]
                    own = order[ranges(lead[record], many)]
                    start, stop, least = (np.repeat(unplanes(f[k], kind), many) for k, kind in (("start", np.uint8), ("stop", np.uint8), ("least", np.int64)))
                    later = owner[own] > least
                    place = first[own[later]]
                    np.add.at(change, place + start[later], 1)
                    np.add.at(change, place + stop[later] + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            raw, kept = data.tobytes(), {"id": [], "n_bytes": [], "spans": [], "kept": []}
            for k, (a, z) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)):
                own = gone[a:z]
                kept["id"].append(None if ids[k] == _NULL_ID else int(ids[k]))
                kept["n_bytes"].append(z - a)
                if own.any():
                    edge = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
                    kept["spans"].append([{"start": x, "stop": y} for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
                    kept["kept"].append(data[a:z][~own].tobytes())
                else:
                    kept["spans"].append([])
                    kept["kept"].append(raw[a:z])
            yield pa.RecordBatch.from_pydict(kept, schema=_RESULT)


def _free(spark) -> None:
    """Let Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def deduplicate(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Per row: id, n_bytes, the removed spans (bytes) and the kept bytes. Ids may be of any type that has an order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"))
    kind = base.schema["id"].dataType
    if isinstance(kind, IntegralType):
        return _deduplicate(base.withColumn("id", F.col("id").cast("long")), run_bytes, share_bytes).withColumn("id", F.col("id").cast(kind))
    # Other ids are numbered in their order: by range partitions, sorted, so no task has them all.
    numbers = materialize(base.select("id").where("id is not null").distinct().orderBy("id").select(F.col("id").alias("name"), F.monotonically_increasing_id().alias("number")), "ids")
    numbered = base.join(numbers, F.col("id") == F.col("name"), "left").select(F.col("number").alias("id"), "text")
    return _deduplicate(numbered, run_bytes, share_bytes).join(numbers, F.col("id") == F.col("number"), "left").select(F.col("name").alias("id"), "n_bytes", "spans", "kept")


def _deduplicate(base: DataFrame, run_bytes: int, share_bytes: int) -> DataFrame:
    spark = base.sparkSession
    runs = materialize(pack(base, run_bytes), "runs")
    size, count = runs.select(F.sum(F.element_at("ends", -1)), F.count("*")).first()
    shares = max(1, min(SHARES, -(-(size or 0) // share_bytes)))
    offered = runs.mapInArrow(_offer(shares), PART)
    told = offered.groupBy("share").applyInArrow(_answer, PART).groupBy("run").agg(F.collect_list("data").alias("told"))
    told = materialize(told.withColumnRenamed("run", "r"), "told")
    _free(spark)
    samples: list[bytes] = []
    if shares > 1:
        one_in = -(-count * SAMPLE // SAMPLES)
        some = runs.select("run", F.posexplode("sample").alias("k", "x"))
        samples = [bytes(r.x) for r in some.where(F.pmod(F.xxhash64("run", "k"), F.lit(one_in)) == 0).select("x").toLocalIterator()]
    cuts = spark.sparkContext.broadcast(splitters(samples, shares))
    known = runs.drop("sample").join(told, F.col("run") == F.col("r"), "left").drop("r")
    ordered = known.mapInArrow(_sort(cuts), SORTED)
    found = ordered.groupBy("share").applyInArrow(_merge, FOUND)
    found = found.groupBy("run").agg(F.collect_list(F.struct("record", "start", "stop", "least")).alias("found"))
    found = materialize(found.withColumnRenamed("run", "f"), "found")
    _free(spark)
    return known.join(found, F.col("run") == F.col("f"), "left").drop("f").mapInArrow(_mark, RESULT)
