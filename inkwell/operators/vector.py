"""Vectors: int8 quantisation, nearest chunks, similar notes, all as array expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions kept, and chunks of a note that are compared, at most.
DIMS, SEED_CHUNKS = 256, 16


def dot(a: Column, b: Column) -> Column:
    return F.reduce(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Length one; zero stays zero."""
    return F.transform(v, lambda x: x.cast("double") / (norm(v) + F.lit(1e-32)))


def quantize(df: DataFrame, vector: str, dims: int = DIMS) -> DataFrame:
    """``df`` with scale and int8 vector ``q`` of the first ``dims`` dimensions, made unit length: q x scale is near them."""
    head = df.withColumn("__head", F.transform(F.slice(F.col(vector), 1, dims), lambda x: x.cast("double"))).withColumn("__norm", norm(F.col("__head")) + F.lit(1e-32))
    head = head.withColumn("__unit", F.transform("__head", lambda x: x / F.col("__norm")))
    top = F.array_max(F.transform("__unit", lambda x: F.abs(x)))
    scaled = head.withColumn("scale", F.when(top > 0, top / 127).otherwise(F.lit(1.0)))
    return scaled.withColumn("q", F.transform("__unit", lambda x: F.floor(x / F.col("scale") + 0.5).cast("tinyint"))).drop("__head", "__norm", "__unit")


def best_chunks(chunks: DataFrame, query: DataFrame) -> DataFrame:
    """(path, chunk, score): each note's best chunk for a query of one row (vector); of equal scores the first chunk.

    ``chunks`` has path, chunk, q, scale. The query is one row, so it is broadcast; notes are reduced before any sort.
    """
    one = query.select(F.col("vector").alias("__query"))
    scored = chunks.crossJoin(F.broadcast(one)).select("path", "chunk", (dot(F.col("q"), F.col("__query")) * F.col("scale")).alias("score"))
    best = F.max(F.struct("score", (-F.col("chunk")).alias("at")))
    return scored.groupBy("path").agg(best.alias("b")).select("path", (-F.col("b.at")).alias("chunk"), "b.score")


def similarity(score: Column) -> Column:
    """Clamped to -1..1 and rounded, halves up, to three places."""
    return F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)) * 1000 + 0.5) / 1000


def seeds(chunks: DataFrame, note: str, most: int = SEED_CHUNKS) -> DataFrame:
    """Up to ``most`` chunks of a note, spread evenly."""
    own = chunks.where(F.col("path") == note)
    w = Window.partitionBy("path")
    numbered = own.withColumn("__i", F.row_number().over(w.orderBy("chunk")) - 1).withColumn("__n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.ceil(F.col("__n") / most))
    return numbered.where(F.col("__i") % step == 0).drop("__i", "__n")


def similar(chunks: DataFrame, note: str, exclude: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(path, score): the greatest product of a chunk of ``note`` and one of each other note."""
    seed = seeds(chunks, note).select(F.col("q").alias("__q"), F.col("scale").alias("__s"))
    others = chunks.where(F.col("path") != note)
    if exclude is not None:
        others = others.join(exclude.select("path"), "path", "left_anti")
    if allowed is not None:
        others = others.join(allowed.select("path"), "path", "left_semi")
    # At most SEED_CHUNKS rows, whatever the note's size.
    pairs = others.crossJoin(F.broadcast(seed))
    return pairs.groupBy("path").agg(F.max(dot(F.col("q"), F.col("__q")) * F.col("scale") * F.col("__s")).alias("score"))
