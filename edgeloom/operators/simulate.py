"""Synthetic samples from a sparse precision matrix.

The p x p model is small and built on the driver (size checked); the samples,
which may be any number, are drawn by tasks. Each block of rows has its own
seeded generator, so a retried task or another partitioning draws the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.gram import matrix_edges
from edgeloom.operators.matrix import check_dense

TOPOLOGIES = ("hub", "scale-free", "cluster", "random", "null", "dense")
EDGE_WEIGHT, MIN_EIG = 0.3, 0.1  # fixed values
ROWS_PER_BLOCK = 1000


@dataclass(frozen=True)
class GeneratedData:
    samples: DataFrame
    theta_edges: DataFrame
    true_edges: DataFrame
    theta_diagonal: float
    n: int
    p: int
    topology: str
    seed: int


def _attach(adj: np.ndarray, hub: int, spokes) -> None:
    adj[hub, spokes] = adj[spokes, hub] = 1


def adjacency(p: int, topology: str, prob: float, rng: np.random.Generator,
              hub_spread: int = 20, cluster_share: int = 5) -> np.ndarray:
    """0/1 adjacency of a named topology."""
    check_dense(p, "a simulated graph")
    adj = np.zeros((p, p), dtype=int)
    if topology == "random":
        i, j = np.triu_indices(p, 1)
        on = rng.random(len(i)) < prob
        adj[i[on], j[on]] = 1
    elif topology == "hub":
        hubs = max(1, p // hub_spread)
        for h in np.arange(hubs) * max(1, p // hubs):
            others = np.delete(np.arange(p), h)
            _attach(adj, h, rng.choice(others, min(max(1, p // 5), p - 1), replace=False))
    elif topology == "scale-free":
        m = max(1, int(round(prob * p)))
        ends = list(range(m))  # attachment targets, repeated by degree
        for v in range(m, p):
            targets: set[int] = set()
            while len(targets) < m:
                targets.add(int(ends[rng.integers(len(ends))]))
            _attach(adj, v, sorted(targets))
            ends.extend(sorted(targets) + [v] * m)
    elif topology == "cluster":
        size = max(3, p // cluster_share)
        for start in range(0, p - size + 1, size):
            i, j = np.triu_indices(size, 1)
            on = rng.random(len(i)) < 0.4
            adj[start + i[on], start + j[on]] = 1
    elif topology == "dense":
        adj[:] = 1
    elif topology != "null":
        raise ValueError(f"topology must be one of {TOPOLOGIES}; got {topology!r}")
    adj = np.maximum(adj, adj.T)
    np.fill_diagonal(adj, 0)
    return adj


def diagonal_shift(theta: np.ndarray, min_eig: float = MIN_EIG) -> float:
    """Amount added to the diagonal so that the matrix is positive definite."""
    low = float(np.linalg.eigvalsh(theta)[0])
    return abs(low) + min_eig + 0.1 if low <= min_eig else 0.0


def precision_matrix(adj: np.ndarray) -> np.ndarray:
    theta = adj * EDGE_WEIGHT
    return theta + diagonal_shift(theta) * np.eye(len(adj))


def draw(spark, factor: np.ndarray, n: int, seed: int) -> DataFrame:
    """``row_id, x`` with covariance ``factor @ factor.T``."""
    shared = spark.sparkContext.broadcast(factor)
    p = factor.shape[0]

    def run(batches):
        low = shared.value
        for pdf in batches:
            for block in pdf["id"].to_numpy(int):
                rows = min(ROWS_PER_BLOCK, n - block * ROWS_PER_BLOCK)
                z = np.random.default_rng([seed, int(block)]).standard_normal((rows, p))
                yield pd.DataFrame({"row_id": block * ROWS_PER_BLOCK + np.arange(rows),
                                    "x": list(z @ low.T)})

    blocks = -(-n // ROWS_PER_BLOCK)
    tasks = max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, blocks, 1, tasks).mapInPandas(run, "row_id BIGINT, x ARRAY<DOUBLE>")


def generate(spark, n: int, p: int, topology: str = "hub", prob: float = 0.05, seed: int = 42,
             **shape) -> GeneratedData:
    rng = np.random.default_rng(seed)
    adj = adjacency(p, topology, prob, rng, **shape)
    theta = precision_matrix(adj)
    factor = np.linalg.cholesky(np.linalg.inv(theta))
    true = matrix_edges(spark, adj.astype(float), "label").filter("label <> 0").select(
        "i", "j", F.col("label").cast("int").alias("label"))
    return GeneratedData(
        draw(spark, factor, n, seed),
        matrix_edges(spark, theta, "theta").filter("theta <> 0"),
        true, float(theta[0, 0]), n, p, topology, seed,
    )
