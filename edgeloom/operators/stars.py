"""Stability approach to regularisation selection (StARS)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.matrix import width
from edgeloom.operators.sampling import with_subsets


def default_grid() -> list[float]:
    return [float(t) for t in np.linspace(0.01, 0.5, 30)]


def instability(freq: DataFrame, pairs: int, keys: list[str]) -> DataFrame:
    """``D = mean 4F(1-F)`` over all ``pairs``; absent pairs count as F = 0."""
    return freq.groupBy(*keys).agg(
        (F.sum(4.0 * F.col("freq") * (1.0 - F.col("freq"))) / F.lit(float(pairs))).alias("d")
    )


def instability_by_threshold(values: DataFrame, selected, grid: list[float], n_subsamples: int,
                             pairs: int) -> DataFrame:
    """``theta, d`` from one table of per-subsample values.

    A fit does not depend on the threshold, so each subsample is fitted once
    and compared with the whole (short, literal) grid.
    """
    thetas = F.array(*[F.lit(float(t)) for t in grid])
    hits = values.select(
        "i", "j",
        F.explode(F.filter(thetas, lambda t: selected(F.col("value"), t))).alias("theta"),
    )
    freq = hits.groupBy("theta", "i", "j").agg(
        (F.count(F.lit(1)) / F.lit(float(n_subsamples))).alias("freq")
    )
    d = instability(freq, pairs, ["theta"])
    every = values.sparkSession.createDataFrame([(float(t),) for t in grid], "theta DOUBLE")
    return every.join(F.broadcast(d), "theta", "left").select(  # at most len(grid) rows
        "theta", F.coalesce("d", F.lit(0.0)).alias("d")
    )


def stars_select(samples: DataFrame, estimator, beta: float = 0.05, n_subsamples: int = 20,
                 subsample_frac: float = 0.75, threshold_grid=None, n_jobs: int = 1,
                 seed: int = 0, direction: str = "largest") -> tuple[DataFrame, float]:
    """``(adjacency, threshold)``: the first threshold whose instability is within ``beta``.

    ``direction='largest'`` scans from the largest threshold down, whatever the
    estimator. For an FDR level a larger threshold is a denser graph;
    ``direction='smallest'`` scans the other way.
    """
    if not 0.0 < beta < 1.0:
        raise ValueError(f"beta must be in (0, 1); got {beta}")
    if not 0.0 < subsample_frac < 1.0:
        raise ValueError(f"subsample_frac must be in (0, 1); got {subsample_frac}")
    if n_jobs == 0:
        raise ValueError("n_jobs must not be 0")
    if direction not in ("largest", "smallest"):
        raise ValueError(f"direction must be 'largest' or 'smallest'; got {direction!r}")
    grid = default_grid() if threshold_grid is None else [float(t) for t in threshold_grid]
    if not grid:
        raise ValueError("threshold_grid must contain at least one value")
    p = width(samples)
    n = samples.count()
    estimator.fit(samples)
    keyed = with_subsets(samples, n, math.floor(subsample_frac * n), n_subsamples, seed)
    values = estimator.keyed_values(keyed, p)
    table = instability_by_threshold(
        values, estimator.selected, grid, n_subsamples, p * (p - 1) // 2
    )
    stable = [r["theta"] for r in table.filter(F.col("d") <= beta).collect()]
    if stable:
        theta = max(stable) if direction == "largest" else min(stable)
    else:
        theta = min(grid)
    adj = estimator.value_edges().withColumn(
        "is_edge", estimator.selected(F.col("value"), F.lit(theta)).cast("int")
    )
    return adj, float(theta)
