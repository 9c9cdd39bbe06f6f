"""Notes made from the documents table, the same in Spark and in DuckDB, for the registered queries.

The tables hold no markdown, so each document becomes a note with front matter, two sections and three links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRESETS = {"default": "true", "en": "source in ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')", "raw": "source >= 'src15' and length(source) = 5"}


#: Bytes of a table below which its rows are dealt to all cores: a small file is one row group, which one task reads.
SMALL = 256 << 20


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small table over all cores; larger tables stay as their files split them, without an exchange."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, doc_id, source, lang, title, summary, tags, status, created, text, body, raw, _mtime, _size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    n = docs.agg(F.max("doc_id")).first()[0] + 1
    docs = dealt(docs)
    nl = F.char(F.lit(10))
    ident, half = F.col("doc_id"), F.floor(F.length("text") / 2).cast("int")
    df = docs.select(
        F.concat("source", F.lit("/doc-"), ident, F.lit(".md")).alias("path"), "doc_id", "source", "lang",
        F.translate(F.substring(F.split_part("text", nl, F.lit(1)), 1, 60), '"\\', "  ").alias("title"), F.concat("lang", F.lit(" note of "), "source").alias("summary"),
        F.concat(F.lit('["'), "lang", F.lit('","t'), ident % 7, F.lit('"]')).alias("tags"), F.when(ident % 3 == 0, "active").when(ident % 3 == 1, "draft").alias("status"),
        F.concat(F.lit("2024-01-"), F.lpad(1 + ident % 28, 2, "0"), F.lit(" 10:"), F.lpad(ident % 60, 2, "0"), F.lit(":00"), F.when(ident % 4 == 0, "-0800").when(ident % 4 == 1, "Z").when(ident % 4 == 2, "+0530").otherwise("")).alias("created"),
        "text", F.substring("text", F.lit(1), half).alias("a"), F.substring("text", half + 1, F.length("text")).alias("b"), (1.7e12 + ident * 3600000.0).alias("_mtime"),
    )
    link = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    body = F.concat(F.lit("# "), "title", nl, "a", nl, F.lit("## part"), nl, "b", nl, F.when(ident % 9 == 4, "").otherwise(link("[[doc-", (ident * 6 + 2) % n, "]] [[doc-", (ident * 14 + 4) % n, "|alias]] ")), link("[[ghost-", ident % 5, "]]"), nl)
    df = df.withColumn("body", body)
    raw = F.concat(F.lit("---"), nl, F.lit('title: "'), "title", F.lit('"'), nl, F.lit("tags: "), "tags", nl, F.lit("status: "), F.coalesce("status", F.lit("null")), nl, F.lit("---"), nl, nl, "body")
    df = df.withColumn("raw", raw)
    return df.withColumn("_size", F.octet_length("raw").cast("long")).drop("a", "b")


#: The same notes in DuckDB: a WITH list, to be continued.
NOTES_SQL = r"""
doc_count AS (SELECT max(doc_id) + 1 AS n FROM documents),
note_parts AS (SELECT source || '/doc-' || doc_id || '.md' AS path, doc_id, source, lang,
  replace(replace(substr(split_part(text, chr(10), 1), 1, 60), '"', ' '), '\', ' ') AS title, lang || ' note of ' || source AS summary,
  '["' || lang || '","t' || (doc_id % 7) || '"]' AS tags, CASE doc_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' END AS status,
  '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || ' 10:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || ':00' ||
    CASE doc_id % 4 WHEN 0 THEN '-0800' WHEN 1 THEN 'Z' WHEN 2 THEN '+0530' ELSE '' END AS created, text,
  substr(text, 1, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b, CAST(1.7e12 + doc_id * 3600000.0 AS DOUBLE) AS _mtime FROM documents),
note_bodies AS (SELECT note_parts.*, '# ' || title || chr(10) || a || chr(10) || '## part' || chr(10) || b || chr(10) ||
  CASE WHEN doc_id % 9 = 4 THEN '' ELSE '[[doc-' || ((doc_id * 6 + 2) % n) || ']] [[doc-' || ((doc_id * 14 + 4) % n) || '|alias]] ' END || '[[ghost-' || (doc_id % 5) || ']]' || chr(10) AS body FROM note_parts, doc_count),
notes AS (SELECT *, CAST(strlen(raw) AS BIGINT) AS _size FROM (SELECT *, '---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'tags: ' || tags || chr(10) ||
  'status: ' || coalesce(status, 'null') || chr(10) || '---' || chr(10) || chr(10) || body AS raw FROM note_bodies))
"""

LINKS_SQL = (
    NOTES_SQL
    + r""",
named AS (SELECT DISTINCT path AS src, trim(unnest(regexp_extract_all(body, '\[\[([^\]|#]+)[^\]]*\]\]', 1))) AS target FROM notes),
links AS (SELECT src, target, lower(target) AS target_base, (SELECT min(path) FROM notes WHERE lower(regexp_extract(path, '([^/]*)\.md$', 1)) = lower(target)) AS dst FROM named)
"""
)

#: Token positions of title, summary and text by the plain tokenizer.
TOKENS_SQL = (
    NOTES_SQL
    + r""",
columns_of AS (SELECT path, 'title' AS col, title AS t FROM notes UNION ALL SELECT path, 'summary', summary FROM notes UNION ALL SELECT path, 'text', text FROM notes),
terms_of AS (SELECT path, col, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS terms FROM columns_of),
tokens AS (SELECT path, col, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM terms_of),
sizes AS (SELECT path, CAST(sum(len(terms)) AS BIGINT) AS size FROM terms_of GROUP BY path)
"""
)
