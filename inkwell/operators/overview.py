"""Bounded overviews: totals, field coverage, preset coverage, recent notes, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS_SHOWN, HUBS_SHOWN, RECENT_SHOWN, PEEK_SHOWN = 20, 8, 5, 20


def totals(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count("*").alias("docs"), F.coalesce(F.sum("_size"), F.lit(0)).cast("long").alias("bytes"))


def storage_class(value):
    """integer, real or text: the class of a JSON scalar kept as text; arrays and objects are text."""
    return F.when(value.rlike(r"^-?\d+$"), "integer").when(value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "real").otherwise("text")


def field_coverage(fields: DataFrame, limit: int | None = FIELDS_SHOWN) -> DataFrame:
    """``fields`` (path, key, kind) to (field, count, types): notes that have a field, and the classes of its values.

    One aggregation for all fields, however many there are.
    """
    out = fields.groupBy(F.col("key").alias("field")).agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("types"))
    return out if limit is None else out.orderBy(F.desc("count"), "field").limit(limit)


def preset_coverage(presets: list[str], preset_files: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """(preset, files, embedded); presets that cover nothing count 0."""
    spark = preset_files.sparkSession
    names = spark.createDataFrame([(p,) for p in presets], "preset string")
    files = preset_files.groupBy("preset").agg(F.count("*").alias("files"))
    out = F.broadcast(names).join(files, "preset", "left")
    if embedded is not None:
        have = preset_files.join(embedded.select("path").distinct(), "path", "left_semi").groupBy("preset").agg(F.count("*").alias("embedded"))
        out = out.join(have, "preset", "left")
    else:
        out = out.withColumn("embedded", F.lit(0).cast("long"))
    return out.select("preset", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("embedded", F.lit(0)).alias("embedded"))


def recent(notes: DataFrame, limit: int = RECENT_SHOWN) -> DataFrame:
    return notes.orderBy(F.desc("_mtime"), "path").limit(limit)


def hubs(ranks: DataFrame, limit: int = HUBS_SHOWN) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), "path").limit(limit)


def change_detect(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, state): added, changed (time or size differs), vanished; unchanged files have no row."""
    a = listing.select("path", F.col("_mtime").alias("m"), F.col("_size").alias("s"), F.lit(True).alias("here"))
    b = stored.select("path", F.col("_mtime").alias("m2"), F.col("_size").alias("s2"), F.lit(True).alias("there"))
    both = a.join(b, "path", "full_outer")
    state = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "vanished").when(~(F.col("m").eqNullSafe(F.col("m2")) & F.col("s").eqNullSafe(F.col("s2"))), "changed")
    return both.select("path", state.alias("state")).where("state is not null")
