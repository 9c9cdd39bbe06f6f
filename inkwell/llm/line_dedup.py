"""Line dedup by site-relative frequency, in DataFrame operations only.

A line's ratio is the number of its host's pages that contain it (however often) divided by all of the host's pages.
A line goes where that ratio exceeds ``max_ratio`` and at least ``min_pages`` pages of the host contain it, so that
small hosts don't lose lines that one page has. Lines are compared after trimming blanks; empty lines are not judged
and stay.

Plan: hashes of each page's distinct lines are counted by (host, line) with partial sums on the map side, so a hot host
or line reaches a reducer as one row for each map task. Lines below ``min_pages`` go before the totals are joined.
What is left for a host has at most (mean lines of its pages / max_ratio) entries, as each entry stands on over
max_ratio of the pages. It is broadcast only when its measured size is below ``broadcast_bytes``; otherwise the join
shuffles, and adaptive execution splits a hot host.

Defined cases: null text is kept null and has no lines; a null host is a site of its own; an empty table gives an empty
table; repeated rows count as pages of their own; all other columns pass through, whatever their names.

With ``once``, pages of one host with equal texts count as one page, so that a group of copies doesn't lose the lines
that only it has, before a later step keeps one of them. Texts are told apart by their MD5; null texts are one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize

_HOST, _BAD, _LINE = "__inkwell_host", "__inkwell_bad", "__inkwell_line"

#: Markup whose content is not text, and elements that begin a line. Fixed values.
HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
BLOCKS = r"(?i)</?(html|head|body|title|nav|header|footer|main|article|section|aside|div|p|br|hr|ul|ol|li|h1|h2|h3|h4|h5|h6|table|tr|td|th|form|pre|blockquote)(\s[^>]*)?/?>"
TAGS = r"<[^>]*>"


def html_lines(html: Column) -> Column:
    """The trimmed non-empty text lines of a page; block elements end lines."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n"), TAGS, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def _key(host: Column, line: Column) -> Column:
    return F.xxhash64(host, F.trim(line))


def boilerplate(pages: DataFrame, host: Column, lines: Column, max_ratio: float = 0.1, min_pages: int = 3, once: Column | None = None) -> DataFrame:
    """Per host with any: the hashes of the lines that go. Pages of a host with equal ``once`` count as one."""
    judged = F.filter(F.coalesce(F.col("lines"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    base = pages.select(host.alias("host"), lines.alias("lines"), F.lit(None).alias("once") if once is None else once.alias("once"))
    base = base.select("host", "once", F.array_distinct(F.transform(judged, lambda x: _key(F.col("host"), x))).alias("lines"))
    if once is not None:
        base = materialize(base.distinct(), "distinct")
    totals = base.groupBy("host").agg(F.count("*").alias("pages"))
    each = base.select("host", F.explode("lines").alias("line"))
    seen = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    seen = seen.withColumnRenamed("host", "h")
    over = seen.join(totals, F.col("h").eqNullSafe(F.col("host"))).where(F.col("n") > F.col("pages") * F.lit(float(max_ratio)))
    return over.groupBy("host").agg(F.collect_list("line").alias("bad"))


def with_boilerplate(pages: DataFrame, host: Column, lines: Column, max_ratio: float = 0.1, min_pages: int = 3, broadcast_bytes: int = 8 << 20, once: Column | None = None) -> DataFrame:
    """``pages`` with two more columns: the host, and the hashes of its lines that go (null: none)."""
    bad = materialize(boilerplate(pages, host, lines, max_ratio, min_pages, once), "boilerplate")
    size = bad.agg(F.sum(8 * F.size("bad") + 16 + F.coalesce(F.octet_length(F.col("host").cast("string")), F.lit(0)))).first()[0] or 0
    bad = bad.select(F.col("host").alias(_HOST), F.col("bad").alias(_BAD))
    left = pages.withColumn(_LINE, host)
    if size <= broadcast_bytes:
        bad = F.broadcast(bad)
    return left.join(bad, F.col(_LINE).eqNullSafe(F.col(_HOST)), "left").drop(_HOST).withColumnRenamed(_LINE, _HOST)


def kept(lines: Column) -> Column:
    """Lines without those that go."""
    host, bad = F.col(_HOST), F.col(_BAD)
    return F.when(bad.isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(bad, _key(host, x))))


def drop_lines(docs: DataFrame, *, host: str = "source", text: str = "text", n_chars: str | None = "n_chars", max_ratio: float = 0.1, min_pages: int = 3, once: bool = False) -> DataFrame:
    """``docs`` with the boilerplate lines of each host taken out of the text; all columns kept, n_chars recounted.

    With ``once``, copies of a text count as one page of their host."""
    lines = F.split(F.col(text), "\n")
    judged = with_boilerplate(docs, F.col(host), lines, max_ratio, min_pages, once=F.md5(text) if once else None)
    new = F.array_join(kept(lines), "\n")
    out = judged.withColumn(text, F.when(F.col(text).isNotNull(), new)).drop(_HOST, _BAD)
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)


def clean_pages(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html", max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """Per page: its host, number of text lines, of dropped lines, and the text of the others."""
    lined = pages.select(F.col(page), host_of(F.col(url)).alias("host"), html_lines(F.col(html)).alias("lines"))
    # Written once: counting and cutting both need the lines, and markup costs most.
    lined = materialize(lined, "lines")
    judged = with_boilerplate(lined, F.col("host"), F.col("lines"), max_ratio, min_pages)
    out = judged.select(page, "host", F.size("lines").cast("long").alias("n_lines"), kept(F.col("lines")).alias("left"))
    return out.select(page, "host", "n_lines", (F.col("n_lines") - F.size("left")).cast("long").alias("n_dropped"), F.array_join("left", "\n").alias("text"))
