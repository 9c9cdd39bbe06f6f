"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

A text's shingles are its runs of five words (lower case; the whole text if it has fewer words). Each shingle is hashed
once; the top bits name one of ``BINS`` bins, and a bin keeps its least hash. A sentinel above any hash of its bin is
sorted in with the hashes, so the first of each bin is the bin's minimum or marks it empty. An empty bin takes the value
of the occupied bin that comes first in its own pseudo-random order of the bins, which depends on the two bin numbers
alone (optimal densification). Of each value the low ``BITS`` bits are stored, two hex digits a bin. Two unrelated
minima agree in those bits with chance 2^-BITS, which ``likeness`` takes out.

Defined cases: null is the empty text, whose fingerprint is the empty string: alike (1) to itself and unlike (0) any
other. A text without words has itself as its only shingle. Equal texts have equal fingerprints. Repeated ids are
ordered by text. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, WORDS = 128, 8, 5
_SHIFT = 64 - BINS.bit_length() + 1
_FULL = (1 << _SHIFT) - 1
_LOW = (1 << BITS) - 1

#: The sentinel of each bin: its highest hash.
_SENTINELS = [(b << _SHIFT) | _FULL for b in range(-BINS // 2, BINS // 2)]


def words_to_hashes(words: Column) -> Column:
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0))), at)


def fingerprint(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``df`` with a fingerprint column for each text column of ``texts`` (name: text column; texts not null)."""
    for name, text in texts.items():
        w, s, d = f"__w_{name}", f"__s_{name}", f"__d_{name}"
        df = df.withColumn(w, F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), 0))
        hashes = F.when(F.size(w) == 0, F.array(F.xxhash64(text))).otherwise(words_to_hashes(F.col(w)))
        df = df.withColumn(s, F.sort_array(F.concat(hashes, F.array(*[F.lit(x) for x in _SENTINELS])))).drop(w)
        first = F.filter(F.col(s), lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(F.col(s), i - 1), _SHIFT)))
        df = df.withColumn(d, first).drop(s)
        empty = lambda x: x.bitwiseAND(F.lit(_FULL)) == F.lit(_FULL)
        bin_of = lambda x: F.shiftright(x, _SHIFT)
        low = lambda x: x.bitwiseAND(F.lit(_LOW))
        ranked = lambda x, taken: F.array_min(F.transform(taken, lambda y: F.xxhash64(bin_of(x), bin_of(y)).bitwiseAND(F.lit(~_LOW)).bitwiseOR(low(y))))
        value = lambda x, taken: low(F.when(empty(x), ranked(x, taken)).otherwise(x))
        digits = lambda taken: F.array_join(F.transform(F.col(d), lambda x: F.lpad(F.hex(value(x, taken)), BITS // 4, "0")), "")
        # The occupied bins are bound to a lambda's variable: named in a column, the optimiser would work them out anew for each bin.
        packed = F.get(F.transform(F.array(F.filter(F.col(d), lambda x: ~empty(x))), lambda taken: digits(taken)), F.lit(0))
        df = df.withColumn(name, F.when(F.col(text) == "", "").otherwise(F.lower(packed))).drop(d)
    return df


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingles of two fingerprints, with the chance of equal low bits taken out."""
    size = BITS // 4
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, i: n + F.when(F.substring(a, i * size + 1, F.lit(size)) == F.substring(b, i * size + 1, F.lit(size)), 1).otherwise(0))
    chance = 2.0**-BITS
    fixed = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(fixed)


def bucketed(df: DataFrame, name: str, rows: int = 4000, most: int = 2048) -> DataFrame:
    """``df`` with a column ``bucket`` that grows with ``name`` and has about ``rows`` rows a value; null is in the first.

    Values are cut at their quantiles, and parts of over ``rows`` rows once more at their own, so up to most^2 buckets.
    """
    ids = df.select(name).where(F.col(name).isNotNull())
    n = ids.count()
    wide = max(1, min(most, -(-n // rows)))
    quantiles = lambda k: [i / k for i in range(1, k)]
    place = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(name)))
    cuts = sorted(set(ids.agg(F.percentile_approx(name, quantiles(wide), 20 * most)).first()[0] or [])) if wide > 1 else []
    outer = (place(F.array(*[F.lit(c) for c in cuts])) if cuts else F.lit(0)).cast("long")
    out = df.withColumn("bucket", F.coalesce(F.when(F.col(name).isNotNull(), outer), F.lit(0).cast("long")))
    if n <= 2 * rows * wide:
        return out
    deep = min(most, -(-n // (rows * wide)))
    inner = out.where(F.col(name).isNotNull()).groupBy("bucket").agg(F.array_sort(F.array_distinct(F.percentile_approx(name, quantiles(deep), 20 * most))).alias("__cuts"))
    out = out.join(inner, "bucket", "left")
    return out.withColumn("bucket", F.col("bucket") * most + F.coalesce(F.when(F.col(name).isNotNull(), place(F.col("__cuts"))), F.lit(0))).drop("__cuts")


def edited_pairs(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is found without a global window: ids are cut into buckets at their quantiles, a window goes over
    each bucket, and the last of a bucket takes the first of the next bucket that has rows.
    """
    base = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = bucketed(base, "doc_id")
    # Bucket numbers alone go over one window: one for thousands of rows.
    all_ = Window.orderBy("bucket")
    after = base.select("bucket").distinct().select(F.col("bucket").alias("b"), F.coalesce(F.lead("bucket").over(all_), F.min("bucket").over(all_)).alias("bucket"))
    first = base.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    heads = fingerprint(first.select("bucket", F.col("head.text").alias("head_text")), {"head_print": "head_text"})
    heads = heads.join(after, "bucket").select(F.col("b").alias("bucket"), "head_text", "head_print")
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    df = base.withColumn("next", F.lead(F.struct("text")).over(w)).join(heads, "bucket", "left")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    follow = F.when(F.col("next").isNotNull(), F.col("next.text")).otherwise(F.col("head_text"))
    df = df.withColumn("n_chars", size.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), size - half), F.substring(follow, F.lit(1), half)))
    df = df.drop("next", "head_text").withColumn("edited_sha256", F.sha2("edited", 256))
    df = fingerprint(df, {"fingerprint": "text", "edited_fingerprint": "edited"}).drop("edited")
    df = df.withColumn("following", F.coalesce(F.lead("fingerprint").over(w), F.col("head_print")))
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("following")).alias("near_next"))
