"""Reciprocal rank fusion of match, link and vector lists, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import cut

#: Added to a rank before its reciprocal.
RRF = 60
LINK_FLOOR = 1e-9


def numbered(ranked: DataFrame, order: list) -> DataFrame:
    """``ranked`` with i, its place from 0. A candidate list is at most some dozens of rows: its cut comes first."""
    return ranked.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(matches: DataFrame, links: DataFrame | None = None, vectors: DataFrame | None = None, linked: DataFrame | None = None) -> DataFrame:
    """(path, score, via) of lists (path, i).

    via is match, link, vector or what of them a note comes from, joined by +; a match counts as linked only if it
    touches an edge (``linked``), though its link rank always counts for the score.
    """
    lists = matches.select("path", "i", F.lit("match").alias("kind"))
    for more, kind in ((links, "link"), (vectors, "vector")):
        if more is not None:
            lists = lists.unionByName(more.select("path", "i", F.lit(kind).alias("kind")))
    lists = lists if linked is None else cut(lists)
    got = lists.groupBy("path").agg(F.sum(1.0 / (RRF + F.col("i"))).alias("score"), F.collect_set("kind").alias("kinds"))
    touches = F.lit(True)
    if linked is not None:
        # Of all edges only those at the lists' notes, some dozens, go into the join.
        linked = linked.select("path").join(F.broadcast(lists.select("path")), "path", "left_semi")
        got = got.join(linked.select("path", F.lit(True).alias("touches")).distinct(), "path", "left")
        touches = F.coalesce("touches", F.lit(False))
    has = lambda k: F.array_contains("kinds", k)
    via = F.array_join(F.array_compact(F.array(F.when(has("match"), "match"), F.when(has("link") & (touches | ~has("match")), "link"), F.when(has("vector"), "vector"))), "+")
    return got.select("path", "score", via.alias("via"))


def fetch_size(k: int, narrow: bool) -> int:
    """Candidates of each list: more when the scope is narrower than the index."""
    return max(5 * k, 50) if narrow else max(3 * k, 30)


def evaluate(results: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg, mrr, hit) at k of ``results`` (query, doc, rank from 0) by ``labels`` (query, doc, relevance)."""
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 2)
    ideal = labels.where("relevance > 0").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), "doc")) - 1).where(F.col("r") < k)
    ideal = ideal.groupBy("query").agg(F.sum(gain(F.col("relevance"), F.col("r"))).alias("ideal"))
    got = results.where(F.col("rank") < k).join(labels.where("relevance > 0"), ["query", "doc"])
    got = got.groupBy("query").agg(F.sum(gain(F.col("relevance"), F.col("rank"))).alias("dcg"), F.min("rank").alias("first"))
    zero = F.lit(0.0)
    return ideal.join(got, "query", "left").select("query", F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"), F.coalesce(1 / (F.col("first") + 1), zero).alias("mrr"), F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"))


def sign_test(a: DataFrame, b: DataFrame, metric: str, tolerance: float = 1e-12) -> DataFrame:
    """(wins, losses, z) of ``b`` over ``a``, per query; differences within the tolerance are ties."""
    both = a.select("query", F.col(metric).alias("x")).join(b.select("query", F.col(metric).alias("y")), "query")
    w, l = F.count_if(F.col("y") - F.col("x") > tolerance), F.count_if(F.col("x") - F.col("y") > tolerance)  # noqa: E741
    out = both.agg(w.alias("wins"), l.alias("losses"))
    n = F.col("wins") + F.col("losses")
    return out.withColumn("z", F.when(n > 0, (F.col("wins") - F.col("losses")) / F.sqrt(n)).otherwise(0.0))
