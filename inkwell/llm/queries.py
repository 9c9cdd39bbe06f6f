"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, chat, decontamination, fingerprints, line_dedup, near_dedup, pii, suffix_dedup, token_counts, toxicity
from inkwell.llm.common import bounded_batches, documents, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontamination.digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), VOCABULARY, PATTERN)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.deduplicate(documents(spark, sf_dir, "doc_id", "text"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]), F.lit(0))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(toxicity.fold() != 2))
    scored = docs.select("doc_id", (toxicity.fold() == 2).alias("held_out"), model.score(docs, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


#: The key of the registered query; a deployment passes its own secret.
PII_KEY = b"inkwell registered query key"
#: The vocabulary's free id ends documents.
END_OF_DOCUMENT = 50256


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    written = materialize(chat.transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "transcripts")
    return chat.format_transcripts(written, chat.train(written))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymize(documents(spark, sf_dir, "doc_id", "text"), PII_KEY).select("doc_id", "pii.*")
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in pii.KINDS]
    return found.select("doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_found"), *counts, "text", "spans")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    blocks = materialize(token_counts.write_stream(docs, VOCABULARY, PATTERN, END_OF_DOCUMENT), "tokens")
    return token_counts.documents_of(token_counts.count(blocks, END_OF_DOCUMENT))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_chat": op5_chat,
    "op6_pii": op6_pii,
    "op7_fingerprints": op7_fingerprints,
    "op10_line_dedup": op10_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
}

#: Words as the operator takes them: A-Z lowered, then runs of digits, a-z and characters beyond ASCII.
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

OP10_SQL = f"""
WITH l AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.HIDDEN}', chr(10), 'g'),
    '{line_dedup.BLOCKS}', chr(10), 'g'), '{line_dedup.TAGS}', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
p AS (SELECT row_number() OVER () AS k, * FROM l),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
n AS (SELECT host, line, count(DISTINCT k) AS n FROM (SELECT host, k, unnest(lines) AS line FROM p) GROUP BY host, line),
bad AS (SELECT n.host, list(line) AS bad FROM n JOIN t ON n.host = t.host WHERE n >= 3 AND n > pages * CAST(0.1 AS DOUBLE) GROUP BY n.host),
k AS (SELECT page_id, p.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept
      FROM p LEFT JOIN bad ON p.host = bad.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""

ORACLES = {"op10_line_dedup": OP10_SQL, "op3_decontamination": OP3_SQL}
