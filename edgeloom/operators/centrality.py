"""Node centralities and hub extraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.graph import above_quantile, degree, nodes_table
from edgeloom.operators.matrix import symmetrise
from edgeloom.session import checkpointed

CENTRALITIES = ("degree", "betweenness", "eigenvector")
MAX_BROADCAST_EDGES = 5_000_000  # 40 MB of int32 pairs
SOURCE_ROWS = 500_000_000  # rows (source, node) of the searches by joins that run together


def _edge_arrays(edges: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Edge ends on the driver, or None when there are too many to broadcast."""
    if edges.limit(MAX_BROADCAST_EDGES + 1).count() > MAX_BROADCAST_EDGES:
        return None
    pdf = edges.select("i", "j").toPandas()
    return pdf["i"].to_numpy(np.int32), pdf["j"].to_numpy(np.int32)


def _dependencies(p: int, a: np.ndarray, b: np.ndarray, source: int) -> np.ndarray:
    """Brandes dependencies of one source, one array operation per BFS level."""
    dist = np.full(p, -1)
    sigma = np.zeros(p)
    dist[source], sigma[source] = 0, 1.0
    levels = []
    d = 0
    while True:
        hop = (dist[a] == d) & ((dist[b] == -1) | (dist[b] == d + 1))
        if not hop.any():
            break
        u, v = a[hop], b[hop]
        dist[v] = d + 1
        np.add.at(sigma, v, sigma[u])
        levels.append((u, v))
        d += 1
    dep = np.zeros(p)
    for u, v in reversed(levels):
        np.add.at(dep, u, sigma[u] / sigma[v] * (1.0 + dep[v]))
    dep[source] = 0.0
    return dep


def betweenness(edges: DataFrame, p: int) -> DataFrame:
    """Normalised shortest-path betweenness: ``node, score``.

    Sources are spread over tasks against the broadcast edge list (size
    checked); beyond the limit the searches run as joins over
    (source, node) rows.
    """
    spark = edges.sparkSession
    arrays = _edge_arrays(edges)
    pairs = (p - 1) * (p - 2) if p > 2 else 1
    if arrays is None:
        return _betweenness_by_joins(edges, p, pairs)
    i, j = arrays
    shared = spark.sparkContext.broadcast((np.concatenate([i, j]), np.concatenate([j, i])))

    def run(batches):
        a, b = shared.value
        total = np.zeros(p)
        for pdf in batches:
            for s in pdf["id"].to_numpy(int):
                total += _dependencies(p, a, b, s)
        keep = np.flatnonzero(total)
        yield pd.DataFrame({"node": keep.astype(np.int32), "dep": total[keep]})

    part = spark.range(0, p, 1, min(p, spark.sparkContext.defaultParallelism)).mapInPandas(
        run, "node INT, dep DOUBLE")
    total = part.groupBy("node").agg(F.sum("dep").alias("dep"))
    return _all_nodes(spark, p, total, F.col("dep") / float(pairs))


def _all_nodes(spark, p: int, scores: DataFrame, value) -> DataFrame:
    return nodes_table(spark, p).join(scores, "node", "left").select(
        "node", F.coalesce(value, F.lit(0.0)).alias("score"))


def _betweenness_by_joins(edges: DataFrame, p: int, pairs: int) -> DataFrame:
    """Searches of ``SOURCE_ROWS / p`` sources at a time, each level a join.

    A level is a table of its own; a search needs the last two of them (what is
    next to a level is in it, before it or behind it) and the way back one at a
    time, so what is held is a row for each source of the batch and node.
    """
    spark = edges.sparkSession
    links = checkpointed(symmetrise(edges.select("i", "j"), []))
    total, batch = None, max(1, SOURCE_ROWS // p)
    for lo in range(0, p, batch):
        found = _search_back(links, _search(spark, links, lo, min(lo + batch, p)))
        if found is None:
            continue
        both = found if total is None else total.unionByName(found).groupBy("node").agg(F.sum("dep").alias("dep"))
        total = checkpointed(both)
    if total is None:
        total = spark.createDataFrame([], "node INT, dep DOUBLE")
    return _all_nodes(spark, p, total, F.col("dep") / float(pairs))


def _search(spark, links: DataFrame, lo: int, hi: int) -> list[DataFrame]:
    """Breadth-first levels ``src, node, sigma`` (shortest paths) of the sources ``lo .. hi - 1``."""
    start = spark.range(lo, hi).select(
        F.col("id").cast("int").alias("src"), F.col("id").cast("int").alias("node"), F.lit(1.0).alias("sigma"))
    levels = [checkpointed(start)]
    while True:
        step = levels[-1].join(links, "node").groupBy("src", F.col("nbr").alias("node")).agg(F.sum("sigma").alias("sigma"))
        for before in levels[-2:]:
            step = step.join(before.select("src", "node"), ["src", "node"], "left_anti")
        step = checkpointed(step.select("src", "node", "sigma"))
        if step.isEmpty():
            return levels
        levels.append(step)


def _search_back(links: DataFrame, levels: list[DataFrame]) -> DataFrame | None:
    """``node, dep``: dependencies of all sources on each node, gathered from the farthest level to the nearest."""
    dep, total = None, None
    for lower, upper in zip(reversed(levels[1:]), reversed(levels[:-1])):
        below = lower.withColumn("dep", F.lit(0.0)) if dep is None else lower.join(
            dep, ["src", "node"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
        flow = below.select("src", F.col("node").alias("nbr"), ((1.0 + F.col("dep")) / F.col("sigma")).alias("f")).join(
            links, "nbr").join(upper, ["src", "node"])
        dep = checkpointed(flow.groupBy("src", "node").agg(F.sum(F.col("f") * F.col("sigma")).alias("dep")))
        level = dep.filter("src <> node").groupBy("node").agg(F.sum("dep").alias("dep"))
        total = level if total is None else total.unionByName(level)
    return None if total is None else total.groupBy("node").agg(F.sum("dep").alias("dep"))


def eigenvector(edges: DataFrame, p: int, max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """Eigenvector centrality by power iteration; degree if it does not converge.

    The edge list of a graph within the broadcast limit is iterated in one
    task on an executor; beyond it every iteration is a join and an aggregation.
    """
    spark = edges.sparkSession
    arrays = _edge_arrays(edges)
    if arrays is None:
        return _eigenvector_by_joins(edges, p, max_iter, tol)
    i, j = arrays
    shared = spark.sparkContext.broadcast((np.concatenate([i, j]), np.concatenate([j, i])))

    def iterate(batches):
        a, b = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            x, close = np.full(p, 1.0 / p), False
            for _ in range(max_iter):
                y = x + np.bincount(a, weights=x[b], minlength=p)
                y /= np.linalg.norm(y) or 1.0
                close = np.abs(y - x).sum() < p * tol
                if close:
                    break
                x = y
            score = y if close else np.bincount(a, minlength=p).astype(float)
            yield pd.DataFrame({"node": np.arange(p, dtype=np.int32), "score": score})

    return spark.range(0, 1, 1, 1).mapInPandas(iterate, "node INT, score DOUBLE")


def _eigenvector_by_joins(edges: DataFrame, p: int, max_iter: int, tol: float) -> DataFrame:
    spark = edges.sparkSession
    links = checkpointed(symmetrise(edges.select("i", "j"), []))
    x = checkpointed(nodes_table(spark, p).withColumn("x", F.lit(1.0 / p)))
    for _ in range(max_iter):
        push = links.join(x, "node").groupBy("nbr").agg(F.sum("x").alias("s"))
        y = checkpointed(x.join(push, F.col("node") == F.col("nbr"), "left").select(
            "node", "x", (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("y")))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        gap = y.agg(F.sum(F.abs(F.col("y") / norm - F.col("x")))).first()[0]
        x = y.select("node", (F.col("y") / norm).alias("x"))
        if gap < p * tol:
            return x.withColumnRenamed("x", "score")
    return degree(edges, p).select("node", F.col("degree").cast("double").alias("score"))


def centrality_scores(edges: DataFrame, p: int, centrality: str = "degree") -> DataFrame:
    if centrality == "degree":
        return degree(edges, p).select("node", F.col("degree").cast("double").alias("score"))
    if centrality == "betweenness":
        return betweenness(edges, p)
    if centrality == "eigenvector":
        return eigenvector(edges, p)
    raise ValueError(f"centrality must be one of {CENTRALITIES}; got {centrality!r}")


def hub_genes(edges: DataFrame, variables: DataFrame, p: int, centrality: str = "degree",
              quantile: float = 0.9) -> DataFrame:
    """``gene, score`` of nodes at or above the centrality quantile; empty for an empty graph."""
    scores = centrality_scores(edges, p, centrality)
    hubs = above_quantile(scores, quantile)
    nonempty = edges.agg(F.count(F.lit(1)) > 0).scalar()
    return (
        hubs.filter(nonempty)
        .join(variables.select(F.col("var_id").alias("node"), F.col("var_name").alias("gene")), "node")
        .select("gene", "score")
    )
