"""Heading outlines and chunks, worked out inside each note's row: no exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import once

_HEADING = r"^(#{1,6}) +(.*)"
_HEADS = "array<struct<line:int,before:bigint,text:string>>"


def headings(lines: Column) -> Column:
    """A struct of the headings outside code fences (line from 1, characters before it, text), and the number of lines and characters."""
    start = F.struct(F.lit(0).alias("line"), F.lit(0).cast("long").alias("chars"), F.lit(False).alias("fenced"), F.array().cast(_HEADS).alias("heads"))

    def step(done: Column, x: Column) -> Column:
        fenced = done["fenced"] != x.rlike(r"^\s*(```|~~~)")
        own = F.array(F.struct((done["line"] + 1).alias("line"), done["chars"].alias("before"), x.alias("text")))
        heads = F.when(x.rlike(_HEADING) & ~fenced, F.concat(done["heads"], own)).otherwise(done["heads"])
        return F.struct((done["line"] + 1).alias("line"), (done["chars"] + F.length(x) + 1).alias("chars"), fenced.alias("fenced"), heads.alias("heads"))

    return F.aggregate(lines, start, step)


def outline(notes: DataFrame, raw: str = "raw", path: str = "path") -> DataFrame:
    """(path, idx, level, heading, start_line, end_line, tokens): a section ends before the next heading of any level."""
    found = notes.select(F.col(path).alias("path"), once(headings(F.split(raw, "\n"))).alias("h"))
    # The end of the text stands as one more heading, so that each has a next one.
    end = F.array(F.struct((F.col("h.line") + 1).alias("line"), F.col("h.chars").alias("before"), F.lit("").alias("text")))
    each = found.select("path", F.concat("h.heads", end).alias("all"), F.posexplode("h.heads").alias("idx", "own")).withColumn("next", F.get("all", F.col("idx") + 1))
    size = F.col("next.before") - F.col("own.before") - 1
    return each.select(
        "path", "idx", F.length(F.regexp_extract("own.text", _HEADING, 1)).alias("level"), F.trim(F.regexp_extract("own.text", _HEADING, 2)).alias("heading"),
        F.col("own.line").alias("start_line"), (F.col("next.line") - 1).alias("end_line"), F.ceil(size / 4).alias("tokens"),
    )


def chunks(notes: DataFrame, body: str = "body", path: str = "path", offset: str | None = None) -> DataFrame:
    """(path, chunk, start_line, end_line, text): headings of the body cut it; what comes before the first is a chunk; blank chunks go.

    ``offset`` names a column with the lines before the body in the file.
    """
    shift = F.col(offset) if offset else F.lit(0)
    found = notes.select(F.col(path).alias("path"), shift.alias("shift"), once(F.split(body, "\n")).alias("lines")).withColumn("h", once(headings(F.col("lines"))))
    starts = F.array_distinct(F.concat(F.array(F.lit(1)), F.transform("h.heads", lambda x: x["line"])))
    cut = found.select("path", "shift", "lines", starts.alias("starts"), F.concat(F.slice(starts, F.lit(2), F.size("lines")), F.array(F.size("lines") + 1)).alias("stops"))
    text = lambda a, z: F.array_join(F.slice("lines", a, z - a), "\n")
    parts = F.transform(F.arrays_zip("starts", "stops"), lambda x: F.struct(x["starts"].alias("start"), x["stops"].alias("stop"), text(x["starts"], x["stops"]).alias("text")))
    own = cut.select("path", "shift", F.posexplode(F.filter(parts, lambda x: x["text"].rlike(r"\S"))).alias("chunk", "p"))
    return own.select("path", "chunk", (F.col("p.start") + F.col("shift")).alias("start_line"), (F.col("p.stop") - 1 + F.col("shift")).alias("end_line"), "p.text")


def section_of(found: DataFrame, sections: DataFrame) -> DataFrame:
    """``found`` (path, line) with the section that holds the line: of those that do, the one that starts last."""
    s = sections.select(F.col("path").alias("p"), "idx", "heading", "start_line", "end_line")
    hit = found.join(s, (F.col("path") == F.col("p")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    best = F.max_by(F.struct("idx", "heading", "start_line", "end_line"), "start_line").alias("s")
    return hit.groupBy("path", "line").agg(best).select("path", "line", "s.*")
