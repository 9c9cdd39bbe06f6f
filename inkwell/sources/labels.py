"""Labelled query sets: questions as JSON lines, judgements as tab-separated files with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, text) of lines {"_id": …, "text": …}; lines that are no JSON or have no id are left out."""
    rows = spark.read.schema("_id string, text string").json(path)
    return rows.where("_id is not null").select(F.col("_id").alias("query"), F.coalesce("text", F.lit("")).alias("text"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc, relevance) of lines query-id, corpus-id, score; of a pair that comes twice the highest."""
    rows = spark.read.schema("query string, doc string, relevance double").csv(path, sep="\t", header=True, enforceSchema=True)
    rows = rows.where("query is not null and doc is not null")
    return rows.groupBy("query", "doc").agg(F.coalesce(F.max("relevance"), F.lit(0.0)).alias("relevance"))


def judged(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """The questions that have a judgement above 0: those that can be evaluated."""
    return questions.join(labels.where("relevance > 0").select("query"), "query", "left_semi")
