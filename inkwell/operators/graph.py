"""Graph operators: PageRank, personalised PageRank, shortest paths, neighbourhoods.

Two forms of each loop. Below ``SMALL`` edges and nodes (counted first, so the bound is known) all iterations run in one
task on arrays: thirty Spark jobs would cost far more than the arithmetic. Above it each iteration is a join and an
aggregation with partial sums, cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import cut

SMALL = 2_000_000
DAMPING, ITERATIONS = 0.85, 30
PERSONAL_DAMPING, PERSONAL_ITERATIONS = 0.7, 15


def _power(edges: np.ndarray, n: int, base: np.ndarray, damping: float, iterations: int) -> np.ndarray:
    src, dst = edges
    out = np.bincount(src, minlength=n).astype(float)
    rank = base.copy()
    for _ in range(iterations):
        share = np.divide(rank, out, out=np.zeros(n), where=out > 0)
        lost = rank[out == 0].sum()
        rank = (1 - damping) * base + damping * (np.bincount(dst, share[src], n) + lost * base)
    return rank


def pagerank(edges: DataFrame, nodes: DataFrame, *, base: DataFrame | None = None, damping: float = DAMPING, iterations: int = ITERATIONS, small: int = SMALL) -> DataFrame:
    """(path, rank) of all ``nodes`` (path). ``edges`` (src, dst) count as often as they come.

    ``base`` (path, weight) is where the walk starts, restarts and goes from nodes without edges; uniform if not given.
    """
    known = nodes.select("path").distinct()
    if base is None:
        start = known.select("path", F.lit(1.0).alias("weight"))
    else:
        start = known.join(base.groupBy("path").agg(F.sum("weight").cast("double").alias("weight")), "path", "left").fillna(0.0, ["weight"])
    # Nodes by numbers that the cut fixes; nodes and edges are made once, each iteration shuffles numbers.
    start = cut(start.withColumn("id", F.monotonically_increasing_id()))
    number = lambda name: start.select(F.col("path").alias(name), F.col("id").alias(name[0]))
    live = cut(edges.select("src", "dst").where("src is not null and dst is not null").join(number("src"), "src").join(number("dst"), "dst").select("s", "d"))
    if start.count() + live.count() <= small:
        no = F.lit(-1).cast("long")
        both = start.select(no.alias("s"), F.col("id").alias("d"), "path", "weight").unionByName(live.select("s", "d", F.lit(None).cast("string").alias("path"), F.lit(None).cast("double").alias("weight")))

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            names = pdf[pdf.s < 0].sort_values("path")
            links = pdf[pdf.s >= 0]
            index = pd.Index(names.d)
            weight = names.weight.to_numpy(float)
            total = weight.sum()
            weight = weight / total if total else weight
            ends = np.array([index.get_indexer(links.s), index.get_indexer(links.d)])
            return pd.DataFrame({"path": names.path.to_numpy(), "rank": _power(ends, len(index), weight, damping, iterations)})

        return both.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(whole, "path string, rank double")
    total = start.agg(F.sum("weight")).first()[0] or 1.0
    degree = live.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("out"))
    state = cut(start.select("id", (F.col("weight") / total).alias("base")).join(degree, "id", "left").withColumn("rank", F.col("base")))
    for _ in range(iterations):
        lost = state.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        # Ranks of nothing give nothing: a walk from few seeds moves the edges that it has reached.
        given = state.where("out is not null and rank != 0").select(F.col("id").alias("s"), (F.col("rank") / F.col("out")).alias("share"))
        got = live.join(given, "s").groupBy(F.col("d").alias("id")).agg(F.sum("share").alias("got"))
        rank = (1 - damping) * F.col("base") + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("base"))
        state = cut(state.join(got, "id", "left").select("id", "base", "out", rank.alias("rank")))
    return start.select("path", "id").join(state.select("id", "rank"), "id").select("path", "rank")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def personalized(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None, **options) -> DataFrame:
    """PageRank over edges taken both ways that starts and restarts at ``seeds`` (path, weight)."""
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null"))
    around = nodes if nodes is not None else edges.select(F.col("src").alias("path")).union(edges.select("dst")).union(seeds.select("path"))
    return pagerank(both_ways(edges), around, base=seeds, damping=PERSONAL_DAMPING, iterations=PERSONAL_ITERATIONS, **options)


def rings(edges: DataFrame, start: str, *, directed: bool = False, max_depth: int | None = None, allowed: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """(path, depth, pred): breadth-first from ``start``; of several predecessors the least. The target is always allowed."""
    live = edges.where("src is not null and dst is not null").select("src", "dst")
    steps = cut((live if directed else both_ways(live)).distinct())
    spark = edges.sparkSession
    visited = spark.createDataFrame([(start, 0, None)], "path string, depth int, pred string")
    frontier, depth = visited, 0
    if allowed is not None:
        extra = spark.createDataFrame([(target,)] if target else [], "path string")
        allowed = cut(allowed.select("path").union(extra).distinct())
    while max_depth is None or depth < max_depth:
        depth += 1
        near = steps.join(frontier.select(F.col("path").alias("src")), "src").groupBy(F.col("dst").alias("path")).agg(F.min("src").alias("pred"))
        near = near.join(visited, "path", "left_anti")
        if allowed is not None:
            near = near.join(allowed, "path", "left_semi")
        frontier = cut(near.select("path", F.lit(depth).alias("depth"), "pred"))
        if frontier.isEmpty():
            break
        visited = cut(visited.unionByName(frontier))
        if target is not None and not frontier.where(F.col("path") == target).isEmpty():
            break
    return visited


def shortest_path(edges: DataFrame, start: str, target: str, **options) -> list[str] | None:
    """The notes of a shortest path, both ends included; None if there is none."""
    if start == target:
        return [start]
    seen = rings(edges, start, target=target, **options)
    hops, at = [], target
    while at is not None:
        row = seen.where(F.col("path") == at).first()
        if row is None:
            return None
        hops.append(at)
        at = row.pred
    return hops[::-1]


def neighbourhood(edges: DataFrame, start: str, hops: int, directed: bool = False) -> DataFrame:
    """(path, depth) within so many hops, the start left out."""
    return rings(edges, start, directed=directed, max_depth=hops).where("depth > 0").select("path", "depth")
