"""MinHash near-dedup by Order MinHash, verified by banded alignment.

A text's shingles are its runs of five words (the whole text if shorter), each labelled with how often it came before.
A sketch takes some of the least of the labelled shingles' hashes and keeps them in their order in the text, so texts
share a sketch only if they share these shingles in the same order. A text's sketches are its bands: 24 of three labels
below 60 shingles, 32 of five from 48 on, so texts of like length have a kind in common.

Likeness of two texts is that of their shingle sequences: L / (m + n - L), with L the length of their longest common
subsequence, found by a bit-parallel alignment inside the band that the threshold leaves. For texts that differ by edits
it is the Jaccard likeness of the shingles; moved passages count as changes. The threshold is 0.8.

Steps: (1) One scan gives each row its word key and bands; rows of one key are copies, and a class of copies goes on as
one node. (2) Nodes of one band are a bucket. The texts of nodes that share a bucket are fetched once. (3) Every node is
compared with one other, the least node of all its buckets, so a group of n near copies costs n - 1 comparisons; nodes
alike take that node's label. (4) Buckets that still hold several labels are settled in whole: all pairs of different
labels are compared inside blocks of at most about ``CELL`` nodes a side, so no pair leaves a task; the members of a
bucket's largest label don't meet each other. A block counts common labels for all of its pairs at once, aligns the pairs
that these allow in order of promise, and passes over those that an accepted pair has joined meanwhile. (5) The links are
joined to components by repeated least labels and pointer jumping.

No bucket is dropped or capped, and no two nodes that share a bucket end in different classes without a comparison. A
link at the threshold shares no bucket with chance 5e-6 (3e-6 in long texts). The work of (4) grows, in a bucket, with
its nodes outside the largest label times all its nodes.

Defined cases: null and empty texts are nobody's copies; texts without words are copies if equal; a null id is an id
that sorts first; nodes are 64-bit hashes of 128-bit keys; repeated rows are copies of each other; an empty table has no
rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import forget, materialize, ranges, slices, text_bytes
from inkwell.llm.words import mix, word_hashes

WORDS, THRESHOLD = 5, 0.8
#: (sketches, labels in each) of short and of long texts; texts from LONG up to SHORT shingles have both kinds, so that two texts within the threshold's ratio have one in common.
SHORT_KIND, LONG_KIND, LONG, SHORT = (24, 3), (32, 5), 48, 60
#: Nodes and shingles on a side of a block.
CELL, CELL_SHINGLES = 512, 1 << 18
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the runs of k words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its earlier occurrences mixed in."""
    order = np.argsort(s, kind="stable")
    run = s[order]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    if first.all():
        return mix(s)
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    out = np.empty(len(s), np.uint64)
    out[order] = np.arange(len(s)) - start
    return mix(s + out * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(s: np.ndarray, sketches: int, pick: int) -> np.ndarray:
    """The bands of a text's shingles: of each sketch, the picked labels in their order in the text."""
    label = labelled(s)
    if len(label) <= pick:
        places = np.broadcast_to(np.arange(len(label)), (sketches, len(label)))
    else:
        h = label[None, :] ^ _SEEDS[:sketches, None]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        places = np.sort(np.argpartition(h, pick - 1, axis=1)[:, :pick], axis=1)
    band = _SEEDS[:sketches] + np.uint64(pick)
    for column in label[places].T:
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + column)
    return band


def bands_of(s: np.ndarray) -> np.ndarray:
    """The bands of a text's kinds; one shingle alone is like none but itself."""
    kinds = ([SHORT_KIND] if len(s) < SHORT else []) + ([LONG_KIND] if len(s) >= LONG else [])
    return np.concatenate([sketch(s, *kind) for kind in kinds]) if len(s) > 1 else np.zeros(0, np.uint64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence with matches at most ``band`` places apart."""
    n = min(len(a), len(b))
    same = np.flatnonzero(a[:n] != b[:n])
    head = int(same[0]) if len(same) else n
    a, b, n = a[head:], b[head:], n - head
    same = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(same[0]) if len(same) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    return head + tail + _common(a, b, band)


def _common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The same by bit vectors as wide as the band: bit i - lo stands for place i of ``a``, and is set where the subsequence grows."""
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        where.setdefault(x, []).append(i)
    # Shingles of many places keep them as one bit vector, cut to the band by a shift; there are few of them.
    often = {x: _bits(at) for x, at in where.items() if len(at) > _OFTEN}
    width = 2 * band + 1
    full, beyond = (1 << width) - 1, 1 << width
    grown, lo, out = 0, 0, 0
    for j, x in enumerate(b.tolist()):
        if j > band:
            out += grown & 1
            grown >>= 1
            lo += 1
        if x in often:
            # Until the band leaves the first places its upper part lies beyond what j may meet.
            m = (often[x] >> lo) & (full if lo else (1 << (j + band + 1)) - 1)
        else:
            m = 0
            for i in where.get(x, ()):
                if lo <= i <= j + band:
                    m |= 1 << (i - lo)
        if m:
            either = m | grown
            grown = (beyond - (either ^ grown) + grown) & either
    return out + grown.bit_count()


#: Places of a shingle from which they are kept as a bit vector.
_OFTEN = 64


def _bits(places: list[int]) -> int:
    flags = np.zeros(places[-1] + 1, np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Likeness of two shingle sequences, or 0 when it is below the threshold."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    need = threshold * total / (1 + threshold)
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    common = len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))
    if common < need - 1e-9:
        return 0.0
    return _measured(a, b, need, threshold)


def _measured(a: np.ndarray, b: np.ndarray, need: float, threshold: float) -> float:
    total = len(a) + len(b)
    # A match is displaced by at most what the longer has beyond the common subsequence.
    n = aligned(a, b, int(max(len(a), len(b)) - need) + 1)
    value = n / (total - n)
    return value if value >= threshold else 0.0


_KEYED = pa.struct([("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("length", pa.int32())])


def sequences(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, shingles) of each of some lower-cased texts; word hashes take some fifty bytes a byte, so few texts at a time."""
    for a, b in slices(offsets, 1 << 19):
        h, text = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        at = np.searchsorted(text, np.arange(b - a + 1))
        for i in range(b - a):
            own = h[at[i] : at[i + 1]]
            yield own, shingles(own)


def _digest(data: bytes, kind: bytes = b"") -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=kind).digest()


def keys_of(column: pa.Array) -> list[dict]:
    out: list[dict] = []
    for raw, (words, s) in zip(column.to_pylist(), sequences(*text_bytes(pc.utf8_lower(column))), strict=True):
        if not raw:
            out.append({"key": None, "bands": [], "length": 0})
        elif not len(words):
            out.append({"key": _digest(raw.encode(), b"text"), "bands": [], "length": 0})
        else:
            out.append({"key": _digest(words.tobytes()), "bands": bands_of(s).view(np.int64), "length": len(s)})
    return out


def _keyed_arrow(column: pa.Array) -> pa.Array:
    return pa.array(keys_of(column), _KEYED)


def _alike_arrow(a: pa.Array, b: pa.Array) -> pa.Array:
    sides = [(s for _, s in sequences(*text_bytes(pc.utf8_lower(column)))) for column in (a, b)]
    return pa.array([likeness(x, y) for x, y in zip(*sides, strict=True)], pa.float64())


def _keyed(column: str):
    return F.arrow_udf(_keyed_arrow, "struct<key:binary, bands:array<long>, length:int>")(F.col(column))


def _alike(a: str, b: str):
    return F.arrow_udf(_alike_arrow, "double")(F.col(a), F.col(b))


def _fit(m, n):
    """Whether two lengths allow the threshold."""
    return F.least(m, n) >= F.greatest(m, n) * F.lit(THRESHOLD) - 1e-9


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, node, lead) of the buckets of several nodes; lead is the bucket's least node."""
    placed = reps.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").select(F.col("bucket").alias("k"), "lead")
    return placed.join(shared, F.col("bucket") == F.col("k")).select("bucket", "node", "lead")


def first_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of each node b with the least node of all its buckets, where they are alike."""
    own = members.groupBy("node").agg(F.min("lead").alias("a")).where("a <> node")
    right = texts.select(F.col("node").alias("b"), F.col("length").alias("nb"), F.col("text").alias("tb"))
    left = texts.select(F.col("node").alias("la"), F.col("length").alias("na"), F.col("text").alias("ta"))
    both = own.join(right, F.col("node") == F.col("b")).join(left, (F.col("a") == F.col("la")) & _fit(F.col("na"), F.col("nb")))
    return both.where(_alike("ta", "tb") > 0).select("a", "b")


def common_labels(labels: list[np.ndarray]) -> np.ndarray:
    """For all pairs of some texts, the number of labels that they have in common."""
    m = len(labels)
    row = np.repeat(np.arange(m), [len(x) for x in labels])
    flat = np.concatenate(labels)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.concatenate([first, [len(flat)]]))
    out = np.zeros((m, m), np.float32)
    # Labels of many texts as columns of a matrix, some at a time; labels of few by their pairs.
    dense = np.flatnonzero(count > max(2, m // 32))
    for part in range(0, len(dense), 2048):
        some = dense[part : part + 2048]
        matrix = np.zeros((m, len(some)), np.float32)
        matrix[row[ranges(first[some], count[some])], np.repeat(np.arange(len(some)), count[some])] = 1
        out += matrix @ matrix.T
    for size in range(2, max(2, m // 32) + 1):
        own = first[count == size]
        for part in range(0, len(own), 1 << 16):
            texts = row[own[part : part + (1 << 16), None] + np.arange(size)]
            for i in range(size):
                for j in range(i + 1, size):
                    np.add.at(out, (texts[:, i], texts[:, j]), 1)
    return np.maximum(out, out.T)


#: Sides of a block's rows: both, left, right, and right as one of the bucket's largest label.
BOTH, LEFT, RIGHT, FRONT = range(4)


def block_links(node: np.ndarray, label: np.ndarray, side: np.ndarray, sequence: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the labels of a block: all pairs of a left and a right text of different labels are settled."""
    left, right = np.flatnonzero(side <= LEFT), np.flatnonzero(side != LEFT)
    size = np.array([len(s) for s in sequence])
    need = THRESHOLD * (size[left, None] + size[None, right]) / (1 + THRESHOLD) - 1e-9
    open_ = (label[left, None] != label[None, right]) & ((side[None, right] == FRONT) | (label[left, None] < label[None, right]))
    open_ &= np.minimum(size[left, None], size[None, right]) >= need
    if not open_.any():
        return []
    common = common_labels([labelled(s) for s in sequence])[np.ix_(left, right)]
    i, j = np.nonzero(open_ & (common >= need))
    order = np.argsort(need[i, j] - common[i, j], kind="stable")
    parent = {x: x for x in label.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(left[i[order]].tolist(), right[j[order]].tolist(), strict=True):
        p, q = root(int(label[x])), root(int(label[y]))
        if p != q and _measured(sequence[x], sequence[y], THRESHOLD * (size[x] + size[y]) / (1 + THRESHOLD), THRESHOLD):
            parent[p] = q
            out.append((int(node[x]), int(node[y])))
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _settled(batches):
    """Links of the blocks, whose rows come one after the other."""
    held: list[pa.RecordBatch] = []

    def links():
        block = pa.Table.from_batches(held).combine_chunks()
        sequence = [s for _, s in sequences(*text_bytes(pc.utf8_lower(block["text"])))]
        found = block_links(*(block[name].to_numpy() for name in ("node", "label", "side")), sequence)
        return pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=_LINKS)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[name].to_numpy() for name in ("bucket", "i", "j")])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if held and any(held[-1][name][-1].as_py() != batch[name][0].as_py() for name in ("bucket", "i", "j")):
            yield links()
            held.clear()
        edges = [0, *cut.tolist(), batch.num_rows]
        for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if n:
                yield links()
                held.clear()
            held.append(batch.slice(a, b - a))
    if held:
        yield links()


def last_links(members: DataFrame, lengths: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the labels of buckets that hold several."""
    named = members.join(lengths, "node").join(labels, F.col("node") == F.col("u"), "left").select("bucket", "node", "length", F.coalesce("label", "node").alias("label"))
    parts = named.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("length").alias("w"))
    parts = parts.groupBy(F.col("bucket").alias("k")).agg(F.max(F.struct("n", "label", "w")).alias("f"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("labels > 1")
    cells = lambda n, w: F.ceil(F.greatest(n / CELL, w / CELL_SHINGLES)).cast("int")
    parts = parts.select("k", F.col("f.label").alias("front"), cells(F.col("n"), F.col("w")).alias("columns"), cells(F.col("n") - F.col("f.n"), F.col("w") - F.col("f.w")).alias("rows"))
    mixed = named.join(parts, F.col("bucket") == F.col("k"))
    front, one = F.col("label") == F.col("front"), (F.col("rows") == 1) & (F.col("columns") == 1)
    cell = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    side = lambda k: F.lit(k).cast("int").alias("side")
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(front, FRONT).otherwise(BOTH).alias("side")))
    left = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(cell("rows").alias("i"), j.alias("j"), side(LEFT)))
    right = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), cell("columns").alias("j"), F.when(front, FRONT).otherwise(RIGHT).alias("side")))
    placed = mixed.select("bucket", "node", "label", F.explode(F.when(one, whole).when(front, right).otherwise(F.concat(left, right))).alias("p")).select("bucket", "p.*", "node", "label")
    rows = placed.join(texts.select("node", "text"), "node").select("bucket", "i", "j", "side", "node", "label", "text")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_settled, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Per node of the edges (a, b): the least node of its component."""
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "label", "left").select("u", "old", F.least("label", "far").alias("label")), "labels")
        forget(labels)
        labels = new
        if labels.where("old <> label").isEmpty():
            forget(both)
            return labels.select("u", "label")


def _texts(base: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(node, length, text) of the nodes, each from the first row of its key."""
    wanted = wanted.select("node", "length", F.col("first").alias("id"), F.col("hash").alias("h"))
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h"))).select("node", "length", "text")
    return texts.dropDuplicates(["node"]) if repeated else texts


def _hashed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))


def classes(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """Per row: doc id, text hash, class (its least id), the rows of the class, and whether the row is one of those that stand for it; and whether rows repeat.

    Of each class one pair of id and text hash stands for it. Texts that are nobody's copies have no class size.
    """
    base = _hashed(docs, doc, text)
    rows = materialize(base.select("doc_id", "hash", _keyed("text").alias("k")).select("doc_id", "hash", "k.*"), "keys")
    repeated = not rows.groupBy("doc_id", "hash").count().where("count > 1").isEmpty()
    # Grouped by what is fixed for a key too, so that the aggregates are numbers and the aggregation hashes.
    unnamed = F.col("doc_id").isNull()
    reps = rows.where("key is not null").groupBy("key", "bands", "length").agg(
        F.min("doc_id").alias("least"), F.max(unnamed).alias("unnamed"), F.min_by("hash", "doc_id").alias("named"), F.max(F.when(unnamed, F.col("hash"))).alias("other"), F.count("*").alias("n")
    )
    first, own = F.when(~F.col("unnamed"), F.col("least")), F.when(F.col("unnamed"), F.col("other")).otherwise(F.col("named"))
    reps = materialize(reps.select(F.xxhash64("key").alias("node"), "key", "bands", "length", first.alias("first"), own.alias("hash"), "n"), "reps")
    members = materialize(buckets(reps), "members")
    wanted = reps.drop("bands").join(members.select("node").distinct(), "node", "left_semi")
    texts = materialize(_texts(base, wanted, repeated), "texts")
    links = materialize(first_links(members, texts), "links")
    # Most leads are not led themselves; where they are, two jumps shorten the way, and labels that differ only cost comparisons.
    labels, jump = links.select(F.col("b").alias("u"), F.col("a").alias("label")), links.select(F.col("b").alias("label"), F.col("a").alias("far"))
    for _ in range(2):
        labels = labels.join(jump, "label", "left").select("u", F.coalesce("far", "label").alias("label"))
    labels = materialize(labels, "labels")
    more = materialize(last_links(members, texts.select("node", "length"), labels, texts), "links")
    for table in (texts, members, labels):
        forget(table)
    found = components(links.union(more).distinct())
    named = materialize(reps.select("node", "first", "hash", "n").join(found, F.col("node") == F.col("u")).select("node", "first", "hash", "n", "label"), "named")
    # The least of a class: a null id before all others, ties by node.
    least = F.min(F.struct(F.col("first").isNotNull(), F.col("first"), F.col("node"), F.col("hash")))
    heads = named.groupBy("label").agg(least.alias("least"), F.sum("n").alias("size")).select("label", F.col("least.first").alias("class_id"), F.col("least.hash").alias("keeper"), "size")
    joined = named.join(heads, "label").select(F.col("node").alias("m"), "class_id", "keeper", "size")
    whole = reps.select("key", "node", "first", "hash", "n").join(joined, F.col("node") == F.col("m"), "left")
    linked = F.col("m").isNotNull()
    either = lambda a, b: F.when(linked, F.col(a)).otherwise(F.col(b))
    whole = whole.select(F.col("key").alias("k"), either("class_id", "first").alias("class_id"), either("keeper", "hash").alias("keeper"), either("size", "n").alias("size"))
    out = rows.select("doc_id", "hash", "key").join(whole, F.col("key") == F.col("k"), "left")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("hash") == F.col("keeper"))
    out = materialize(out.select("doc_id", "hash", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "size", F.when(F.col("k").isNotNull(), stays).alias("stays")), "classes")
    for table in (rows, reps, named, links, more):
        forget(table)
    return out, repeated


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, class_id (the least id of its class) and the rows of the class."""
    own, _ = classes(docs, **options)
    return own.select("doc_id", "class_id", F.coalesce("size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of least id; all columns kept."""
    own, repeated = classes(docs, doc=doc, text=text)
    gone = own.where(~F.col("stays")).select(F.col("doc_id").alias("__gone_id"), F.col("hash").alias("__gone_hash"))
    left = docs.join(gone, F.col(doc).eqNullSafe(F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_hash")), "left_anti")
    if repeated:
        # Of rows that repeat one pair of id and text, one stays; null and empty texts stay all.
        hashed = left.withColumn("__hash", F.xxhash64(text))
        full = F.length(text) > 0
        left = hashed.where(full).dropDuplicates([doc, "__hash"]).unionByName(hashed.where(~F.coalesce(full, F.lit(False)))).select(*docs.columns)
    return left
