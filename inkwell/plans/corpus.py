"""A synthetic tree of notes of any size: every word, link and value follows from a seed, the note and the place alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKEW = 1.07


def uniform(seed: int, *place: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the place."""
    return F.xxhash64(F.lit(seed), *place).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def zipf(u: Column, n: int, skew: float = SKEW) -> Column:
    """Rank from 0 to n - 1 with a density that falls as rank to the power of -skew (not 1): the inverse of its distribution."""
    p = 1.0 - skew
    return F.least(F.lit(n - 1), F.floor(F.pow(1.0 + u * (float(n + 1) ** p - 1.0), F.lit(1.0 / p))).cast("int") - 1)


def corpus(spark: SparkSession, notes: int, *, words: int = 200, vocabulary: int = 5000, headings: int = 4, links: int = 3, fields: int = 3, skew: float = SKEW, seed: int = 1) -> DataFrame:
    """(path, raw): notes with front matter, headings, paragraphs whose words are Zipf-distributed, and links to popular notes."""
    n, nl = F.col("id"), F.char(F.lit(10))
    each = lambda size, made: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), made) if size > 0 else F.array().cast("array<string>")
    word = lambda *place: F.concat(F.lit("w"), F.lower(F.conv(zipf(uniform(seed, n, *place), vocabulary, skew).cast("string"), 10, 36)))
    long = -(-words // max(1, headings))
    paragraph = lambda h: F.array_join(each(long, lambda i: word(F.lit("word"), h, i)), " ")
    part = lambda h: F.concat(F.lit("## "), word(F.lit("heading"), h), F.lit(" "), h.cast("string"), nl, nl, paragraph(h), nl)
    link = lambda k: F.concat(F.lit("[[note-"), zipf(uniform(seed, n, F.lit("link"), k), notes, skew).cast("string"), F.lit("]]"))
    field = lambda k: F.concat(F.lit("field-"), k.cast("string"), F.lit(": "), F.floor(uniform(seed, n, F.lit("field"), k) * 100).cast("string"), nl)
    head = F.concat(F.lit("---"), nl, F.lit("title: Note "), n.cast("string"), nl, F.array_join(each(fields, field), ""), F.lit("---"), nl, nl)
    body = F.concat(F.array_join(each(max(1, headings), part), ""), nl, F.array_join(each(links, link), " "), nl)
    return spark.range(notes).select(F.concat(F.lit("part-"), (n % 16).cast("string"), F.lit("/note-"), n.cast("string"), F.lit(".md")).alias("path"), F.concat(head, body).alias("raw"))
