"""Edge tests: z, p-values, false-discovery control, confidence intervals."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.normal import two_sided_p
from edgeloom.operators.gram import stat_blocks, assemble
from edgeloom.operators.kernels import nodewise_precision
from edgeloom.operators.matrix import check_dense, pair_grid, width
from edgeloom.operators.prefix import ROWS_PER_SLICE, lookup, running
from edgeloom.operators.sampling import with_subsets
from edgeloom.session import spread

METHODS = {"BH": "BH", "bh": "BH", "BY": "BY", "by": "BY"}


def penalty(n: int, p: int, scale: float = 1.0, method: str = "scaled") -> float:
    """Lasso penalty of the node regressions.

    ``scaled`` is ``sqrt(2 ln(p / sqrt(n)) / n)``; where that logarithm is not
    positive the low-dimensional rate ``sqrt(2 ln(max(p, 2)) / n)`` applies.
    ``relaxed`` is ``1 / sqrt(n)``.
    """
    if method == "relaxed":
        return scale / math.sqrt(n)
    if method != "scaled":
        raise ValueError(f"lambda_method must be 'scaled' or 'relaxed'; got {method!r}")
    ratio = p / math.sqrt(n)
    inside = ratio if ratio > 1.0 else float(max(p, 2))
    return scale * math.sqrt(2.0 * math.log(inside) / n)


def floor_residuals(nodes: DataFrame) -> DataFrame:
    """Floor near-zero residual variances and flag those nodes as degenerate."""
    limit = nodes.agg(
        F.greatest(
            F.coalesce(F.avg(F.when(F.col("tau2") > 0, F.col("tau2"))) * 1e-6, F.lit(1e-8)),
            F.lit(1e-8),
        ).alias("_floor")
    ).scalar()
    return nodes.select(
        *[c for c in nodes.columns if c != "tau2"],
        F.greatest(F.col("tau2"), limit).alias("tau2"),
        (F.col("tau2") <= limit).alias("degenerate"),
    )


def precision_edges(nodes: DataFrame, beta: DataFrame, n: int, p: int,
                    dof_correction: bool = False, variance: str = "literal") -> DataFrame:
    """``i, j, omega, variance, z, p_value`` for every pair.

    ``nodes`` is ``i, tau2, nnz`` (floored), ``beta`` the non-zero directed
    coefficients ``i, j, beta``. Both directions of a coefficient are added by
    one aggregation instead of a self-join. ``variance='literal'`` is
    ``tau2_i tau2_j``; ``'textbook'`` is its reciprocal, the variance of a
    precision entry when ``omega_ii = 1 / tau2_i``.
    """
    spark = nodes.sparkSession
    tau = nodes.select("i", "tau2", F.greatest(F.lit(n) - F.col("nnz"), F.lit(1)).alias("df"))
    contrib = (
        beta.join(tau.select("i", "tau2"), "i")
        .select(
            F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"),
            (-F.col("beta") / F.col("tau2")).alias("w"),
        )
        .groupBy("i", "j").agg((F.sum("w") / 2.0).alias("omega"))
    )
    ti = tau.select("i", F.col("tau2").alias("t_i"), F.col("df").alias("df_i"))
    tj = tau.select(F.col("i").alias("j"), F.col("tau2").alias("t_j"), F.col("df").alias("df_j"))
    grid = pair_grid(spark, p).join(ti, "i").join(tj, "j").join(contrib, ["i", "j"], "left")
    omega = F.coalesce(F.col("omega"), F.lit(0.0))
    if dof_correction:
        omega = omega * F.lit(float(n)) / ((F.col("df_i") + F.col("df_j")) / 2.0)
    var = F.col("t_i") * F.col("t_j")
    if variance == "textbook":
        var = 1.0 / var
    edges = grid.select("i", "j", omega.alias("omega"), var.alias("variance"))
    return with_tests(edges, n)


def with_tests(edges: DataFrame, n: int) -> DataFrame:
    z = F.when(
        F.col("variance") > 0, F.lit(math.sqrt(n)) * F.col("omega") / F.sqrt("variance")
    ).otherwise(0.0)
    return edges.withColumn("z", z).withColumn("p_value", two_sided_p(F.col("z")))


def z_to_pvalues(edges: DataFrame, z: str = "z", out: str = "p_value") -> DataFrame:
    return edges.withColumn(out, two_sided_p(F.col(z)))


def harmonic(m: int) -> float:
    """``sum(1/k)`` for k = 1..m (asymptotic series beyond 10^7)."""
    if m <= 10_000_000:
        return float((1.0 / np.arange(1, m + 1)).sum())
    return math.log(m) + 0.57721566490153286 + 1 / (2 * m) - 1 / (12 * m * m)


def fdr_adjust(edges: DataFrame, method: str = "BH", m: int | None = None,
               p_col: str = "p_value", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``q_value``, the step-up adjusted p-value over all rows of ``edges``.

    Equal p-values share their q-value, so the adjustment is computed once per
    distinct p. Beyond one slice the running count and the running minimum are
    sliced and the result is looked up with hot p-values (p = 1) broadcast.
    """
    if method not in METHODS:
        raise ValueError(f"method must be 'BH' or 'BY'; got {method!r}")
    m = edges.count() if m is None else m
    c = harmonic(m) if METHODS[method] == "BY" else 1.0
    raw = lambda rank: F.col(p_col) * F.lit(c * m) / rank
    if m <= rows_per_slice:
        upto = Window.orderBy(p_col).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        down = Window.orderBy(F.col(p_col).desc()).rangeBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        ranked = edges.withColumn("_r", raw(F.count(F.lit(1)).over(upto)))
        return ranked.withColumn(
            "q_value", F.least(F.lit(1.0), F.min("_r").over(down))
        ).drop("_r")
    counts = edges.groupBy(p_col).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counts, p_col, {"_k": ("_c", "sum")}, rows=m, rows_per_slice=rows_per_slice)
    adjusted = running(
        ranked.select(p_col, "_c", raw(F.col("_k")).alias("_r")), p_col, {"_q": ("_r", "min")},
        rows=m, descending=True, rows_per_slice=rows_per_slice,
    ).select(p_col, "_c", F.least(F.lit(1.0), F.col("_q")).alias("q_value"))
    return lookup(edges, adjusted, [p_col], "_c", m, rows_per_slice)


def fdr_adjust_within(df: DataFrame, keys: list[str], p_col: str = "p_value",
                      out: str = "adjusted_p_value") -> DataFrame:
    """Benjamini-Hochberg inside each group of ``keys`` (one family per group)."""
    upto = Window.partitionBy(*keys).orderBy(p_col).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy(F.col(p_col).desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = df.withColumn("_r", F.col(p_col) * size / F.count(F.lit(1)).over(upto))
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min("_r").over(down))).drop("_r")


def fdr_control(edges: DataFrame, alpha: float = 0.05, method: str = "BH",
                m: int | None = None) -> DataFrame:
    """Add ``q_value`` and ``is_edge`` (``q_value <= alpha``)."""
    return fdr_adjust(edges, method, m).withColumn(
        "is_edge", (F.col("q_value") <= alpha).cast("int")
    )


def asymptotic_ci(edges: DataFrame, n: int, alpha: float = 0.05) -> DataFrame:
    """Add ``lower`` and ``upper``: ``omega -+ z * sqrt(variance / n)``."""
    half = F.lit(NormalDist().inv_cdf(1.0 - alpha / 2.0)) * F.sqrt(F.col("variance") / F.lit(float(n)))
    return edges.withColumn("lower", F.col("omega") - half).withColumn(
        "upper", F.col("omega") + half
    )


def keyed_precision(samples: DataFrame, p: int, lambda_scale: float = 1.0,
                    lambda_method: str = "scaled", dof_correction: bool = False,
                    standardised: bool = False, max_iter: int = 10_000,
                    tol: float = 1e-12) -> DataFrame:
    """De-sparsified precision per key: ``key, i, j, omega, variance, z``.

    All groups share one pass over the samples; a task then fits one group
    from its p x p statistics (size checked).
    """
    check_dense(p, "a fit per group")

    def fit(pdf):
        st = assemble(pdf)
        g = st.second_moment() if standardised else st.correlation()
        lam = penalty(st.n, p, lambda_scale, lambda_method)
        omega, var = nodewise_precision(g, st.n, lam, max_iter, tol, dof_correction)
        i, j = np.triu_indices(p, k=1)
        import pandas as pd

        w, v = omega[i, j], var[i, j]
        z = np.sqrt(st.n) * w / np.sqrt(v)
        return pd.DataFrame(
            {"key": int(pdf["key"].iloc[0]), "i": i, "j": j, "omega": w, "variance": v, "z": z}
        )

    return spread(stat_blocks(samples, p, keyed=True), "key").groupBy("key").applyInPandas(
        fit, "key INT, i INT, j INT, omega DOUBLE, variance DOUBLE, z DOUBLE"
    )


def ensemble_ci(samples: DataFrame, n_splits: int = 25, subsample_frac: float = 0.5,
                alpha: float = 0.05, lambda_scale: float = 1.0, seed: int = 0,
                lambda_method: str = "scaled", dof_correction: bool = False,
                n: int | None = None) -> DataFrame:
    """Split-and-average intervals: ``i, j, omega, lower, upper``.

    The interval is for the average over overlapping subsamples; its width
    shrinks with the number of splits.
    """
    if n_splits < 2:
        raise ValueError(f"n_splits must be >= 2; got {n_splits}")
    if not 0.0 < subsample_frac < 1.0:
        raise ValueError(f"subsample_frac must be in (0, 1); got {subsample_frac}")
    n = samples.count() if n is None else n
    p = width(samples)
    keyed = with_subsets(samples, n, math.floor(subsample_frac * n), n_splits, seed)
    fits = keyed_precision(keyed, p, lambda_scale, lambda_method, dof_correction)
    crit = F.lit(NormalDist().inv_cdf(1.0 - alpha / 2.0))
    half: Column = crit * F.stddev_samp("omega") / math.sqrt(n_splits)
    return fits.groupBy("i", "j").agg(
        F.avg("omega").alias("omega"),
        (F.avg("omega") - half).alias("lower"),
        (F.avg("omega") + half).alias("upper"),
    )
