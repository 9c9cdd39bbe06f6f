"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (lower case; runs of letters, digits and characters beyond ASCII), pairs of words in a
row, and pairs with one or two words between them, each hashed to one of 2^bits places. A feature that occurs c times
among a text's n words weighs log2(1 + c) / sqrt(1 + log2(1 + n)): repetition counts less and less, and long texts
don't gain by length alone. The score is the logistic function of the bias and the weighted sum.

Training is FTRL-proximal: each coordinate has its own rate alpha / (beta + sqrt(sum of squared gradients)), and a
weight stays exactly zero until its accumulated gradient exceeds the L1 bound, so the model is a short list of places
and weights. Its size has the bound 12 bytes x 2^bits, checked before it is broadcast. Training takes at most
``sample_rows`` labelled rows, those of least hash of id and text, and of these at most ``sample_bytes`` of text in the
same order, and runs inside one task on an executor: the bounds hold at any size of the corpus. Scoring covers all rows
and does not shuffle.

Defined cases: a null or wordless text has no features and scores the logistic of the bias, the prior of the training
labels; null labels are not trained on; without labelled rows nothing is known to be toxic and every score is 0;
rows equal in id, text and label are trained on once and scored as often as they come; other columns are ignored or passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import slices, text_bytes
from inkwell.llm.words import BASE, mix, word_hashes

BITS = 20
#: Rows and bytes of text that training looks at, at most; passes over them; FTRL's alpha, beta, L1, L2.
SAMPLE_ROWS, SAMPLE_BYTES, PASSES, ALPHA, BETA, L1, L2 = 20_000, 256 << 20, 3, 1.0, 1.0, 3.0, 0.1

_SALTS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid out in ``data``: the text and place of each feature occurrence, and the words of each text."""
    n_texts = len(offsets) - 1
    h, text = word_hashes(data, offsets)
    places, owners = [h + _SALTS[0]], [text]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            places.append((h[:-gap] * np.uint64(3) + mix(h[gap:] + _SALTS[gap]))[same])
            owners.append(text[:-gap][same])
    place = mix(np.concatenate(places) * np.uint64(BASE)) >> np.uint64(64 - bits)
    return np.concatenate(owners), place.astype(np.int64), np.bincount(text, minlength=n_texts)


def scale(words: np.ndarray) -> np.ndarray:
    return 1.0 / np.sqrt(1.0 + np.log2(1.0 + words))


class Ftrl:
    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, places=slice(None)) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha)

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w, b = self.weights(places), self.bias
        p = 1.0 / (1.0 + np.exp(-np.clip(b + w @ values, -35, 35)))
        g = (p - label) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g
        g = p - label
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += g * g


def fit(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, bits: int = BITS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and weights that aren't zero, and the bias. Examples come in the order given."""
    model, mask = Ftrl(bits), (1 << bits) - 1
    for _ in range(passes):
        # Features are made anew in each pass: kept, they would take several times the texts' size.
        for a, b in slices(offsets, 1 << 19):
            owner, place, words = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
            key, count = np.unique(owner << bits | place, return_counts=True)
            by = np.searchsorted(key >> bits, np.arange(b - a + 1))
            value, size = np.log2(1.0 + count), scale(words)
            for i in range(b - a):
                part = slice(by[i], by[i + 1])
                model.learn(key[part] & mask, value[part] * size[i], int(labels[a + i]))
    w = model.weights()
    kept = np.flatnonzero(w)
    return kept, w[kept], float(model.bias)


def score(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    for a, b in slices(offsets, 1 << 19):
        owner, place, words = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
        hit = weights[place] != 0
        owner, place = owner[hit], place[hit]
        key, count = np.unique(owner << bits | place, return_counts=True)
        total = np.bincount(key >> bits, weights[key & ((1 << bits) - 1)] * np.log2(1.0 + count), b - a)
        with np.errstate(over="ignore"):
            out[a:b] = 1.0 / (1.0 + np.exp(-(bias + total * scale(words))))
    return out


class Model:
    """Trained weights: ``places`` and ``weights`` that aren't zero, and the bias."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float, bits: int = BITS):
        self.places, self.weights, self.bias, self.bits = places, weights, bias, bits

    def score(self, df: DataFrame, text: str | Column) -> Column:
        """A column of scores from 0 to 1."""
        spark, bias, bits = df.sparkSession, self.bias, self.bits
        if self.places.nbytes + self.weights.nbytes > 12 << bits:
            raise ValueError("a model has at most one weight for each place")
        sent = spark.sparkContext.broadcast((self.places, self.weights))
        held: dict = {}

        @F.arrow_udf("double")
        def scored(column: pa.Array) -> pa.Array:
            if not held:
                held["w"] = np.zeros(1 << bits)
                held["w"][sent.value[0]] = sent.value[1]
            data, offsets = text_bytes(pc.utf8_lower(column))
            return pa.array(score(data, offsets, held["w"], bias, bits))

        return scored(F.col(text) if isinstance(text, str) else text)


def train(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, bits: int = BITS) -> Model:
    """Fit on a bounded sample: the ``sample_rows`` labelled ids of least hash."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("k"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k", "y").limit(sample_rows)
    rows = docs.select(F.col(doc).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("id") == F.col("k"))
    rows = rows.select(F.xxhash64("k", "t").alias("h"), "t", "y")
    # The bounds act in the order of hashes, on (hash, label, bytes) of at most sample_rows rows, so they choose the same rows on any layout.
    sizes = rows.groupBy("h", "y").agg(F.max(F.coalesce(F.octet_length("t"), F.lit(0))).alias("n")).orderBy("h", "y").limit(sample_rows).collect()
    n = int(np.searchsorted(np.cumsum([r.n for r in sizes]), sample_bytes, side="right"))
    n = max(1, n)
    if n < len(sizes):
        rows = rows.where((F.col("h") < sizes[n].h) | ((F.col("h") == sizes[n].h) & (F.col("y") < sizes[n].y)))
    elif sizes:
        rows = rows.where((F.col("h") < sizes[-1].h) | ((F.col("h") == sizes[-1].h) & (F.col("y") <= sizes[-1].y)))
    rows = rows.dropDuplicates(["h", "y"]).repartition(1)

    def fitted(batches):
        parts = []
        for b in batches:
            parts.append(pa.table({"h": b["h"], "t": pc.utf8_lower(b["t"].cast(pa.large_string())), "y": b["y"]}))
        if not parts or not sum(p.num_rows for p in parts):
            yield pa.record_batch({"places": pa.array([b""], pa.binary()), "weights": pa.array([b""], pa.binary()), "bias": pa.array([-1e9])})
            return
        table = pa.concat_tables(parts).sort_by([("h", "ascending"), ("t", "ascending"), ("y", "ascending")])
        data, offsets = text_bytes(table["t"])
        places, weights, bias = fit(data, offsets, table["y"].to_numpy(), bits)
        yield pa.record_batch({"places": pa.array([places.astype(np.int32).tobytes()], pa.binary()), "weights": pa.array([weights.tobytes()], pa.binary()), "bias": pa.array([bias])})

    got = rows.mapInArrow(fitted, "places binary, weights binary, bias double").collect()
    if not got:
        return Model(np.zeros(0, np.int32), np.zeros(0), -1e9, bits)
    r = got[0]
    return Model(np.frombuffer(r.places, np.int32), np.frombuffer(r.weights, np.float64), r.bias, bits)


def fold(doc: str = "doc_id") -> Column:
    """The fold of a row, 0 to 3, from the CRC-32 of its id as text."""
    return F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(4))


def reject(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; the fold 2 of the labels is not learnt from."""
    model = train(docs, labels.where(fold(doc) != 2), doc=doc, text=text, label=label)
    return docs.where(model.score(docs, text) < threshold)
