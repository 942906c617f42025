"""Network estimators over a sample table ``row_id, x ARRAY<DOUBLE>``."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import inference as inf
from edgeloom.operators.gram import assemble, collect_stats, stat_blocks
from edgeloom.operators.kernels import glasso, lasso_nodes, residual_variance
from edgeloom.operators.matrix import MAX_DENSE_P, check_dense, pair_grid, width
from edgeloom.operators.sampling import with_folds, with_subsets
from edgeloom.operators.screened import (
    covariance_rows, dense_precision, fold_rows, largest_off_diagonal, solve_blocks, solved_edges,
)
from edgeloom.session import checkpointed, spread


def fan_out(spark, p: int) -> DataFrame:
    """One row per node, spread over the cluster."""
    return spark.range(0, p, 1, min(p, max(1, spark.sparkContext.defaultParallelism)))


def fit_nodes(spark, g: np.ndarray, lam: float, max_iter: int, tol: float) -> DataFrame:
    """Node regressions ``i, tau2, nnz, idx, val`` from a Gram matrix.

    The matrix is broadcast; its size is checked here, and wider tables take
    ``wide.fit_nodes_by_active_set`` instead.
    """
    check_dense(g.shape[0], "the broadcast Gram matrix")
    shared = spark.sparkContext.broadcast(g)

    def solve(batches):
        gram = shared.value
        for pdf in batches:
            nodes = pdf["id"].to_numpy(int)
            if nodes.size == 0:
                continue
            beta = lasso_nodes(gram, lam, nodes, max_iter, tol)
            tau2 = residual_variance(gram, nodes, beta)
            idx = [np.flatnonzero(b) for b in beta]
            yield pd.DataFrame(
                {
                    "i": nodes, "tau2": tau2, "nnz": [len(k) for k in idx],
                    "idx": idx, "val": [b[k] for b, k in zip(beta, idx)],
                }
            )

    return fan_out(spark, g.shape[0]).mapInPandas(
        solve, "i INT, tau2 DOUBLE, nnz INT, idx ARRAY<INT>, val ARRAY<DOUBLE>"
    )


def beta_table(nodes: DataFrame) -> DataFrame:
    """Directed non-zero coefficients ``i, j, beta``."""
    return nodes.select("i", F.inline(F.arrays_zip(F.col("idx").alias("j"), F.col("val").alias("beta"))))


@dataclass(frozen=True)
class GGMInferenceResult:
    """Edge and node tables of one fit; ``edges`` has one row per pair."""

    edges: DataFrame
    nodes: DataFrame
    n: int
    p: int
    adj_fdr: DataFrame | None = None
    fdr_alpha: float | None = None


class DesparifiedGGM:
    """De-sparsified nodewise Lasso with a z-test for every pair.

    ``tol`` bounds the last coordinate step; the default is tight because the
    optimum, not the iterate, is the result.
    """

    def __init__(self, lambda_scale: float = 1.0, lambda_method: str = "scaled",
                 dof_correction: bool = False, standardise: bool = True,
                 max_iter: int = 10_000, tol: float = 1e-10, n_jobs: int = 1,
                 variance: str = "literal") -> None:
        if lambda_method not in ("scaled", "relaxed"):
            raise ValueError(f"lambda_method must be 'scaled' or 'relaxed'; got {lambda_method!r}")
        if variance not in ("literal", "textbook"):
            raise ValueError(f"variance must be 'literal' or 'textbook'; got {variance!r}")
        self.lambda_scale = lambda_scale
        self.lambda_method = lambda_method
        self.dof_correction = dof_correction
        self.standardise = standardise
        self.max_iter = max_iter
        self.tol = tol
        self.n_jobs = n_jobs  # accepted for compatibility; Spark schedules the work
        self.variance = variance
        self.result_: GGMInferenceResult | None = None

    def fit(self, samples: DataFrame) -> "DesparifiedGGM":
        p = width(samples)
        if p > MAX_DENSE_P:
            from edgeloom.operators.wide import fit_nodes_by_active_set

            raw, n = fit_nodes_by_active_set(
                samples, p, lambda n: self._penalty(n, p), self.standardise,
                self.max_iter, self.tol,
            )
        else:
            stats = collect_stats(samples, p)
            n = stats.n
            g = stats.correlation() if self.standardise else stats.second_moment()
            raw = fit_nodes(samples.sparkSession, g, self._penalty(n, p), self.max_iter, self.tol)
            raw = raw.persist()  # read by four consumers below; recomputable from the broadcast
        nodes = inf.floor_residuals(raw.select("i", "tau2", "nnz"))
        edges = inf.precision_edges(
            nodes, beta_table(raw), n, p, self.dof_correction, self.variance
        ).persist()  # adjacency, scores and intervals all read it
        self._held = [raw, edges]
        self.beta_ = beta_table(raw)
        self.result_ = GGMInferenceResult(edges, nodes, n, p)
        return self

    def _penalty(self, n: int, p: int) -> float:
        if n < 5 * p:
            warnings.warn(f"n={n} < 5p={5 * p}: asymptotic normality may not hold", stacklevel=3)
        if self.lambda_method == "scaled" and p / math.sqrt(n) <= 1.0:
            warnings.warn(
                f"p={p} <= sqrt(n): using the low-dimensional penalty sqrt(2 ln p / n)",
                stacklevel=3,
            )
        return inf.penalty(n, p, self.lambda_scale, self.lambda_method)

    def _fitted(self) -> GGMInferenceResult:
        if self.result_ is None:
            raise RuntimeError("call fit() first")
        return self.result_

    @property
    def degenerate_nodes_(self) -> list[int]:
        """Nodes whose residual variance was floored (an action on p rows)."""
        rows = self._fitted().nodes.filter("degenerate").select("i").orderBy("i").collect()
        if rows:
            warnings.warn("some nodes have near-zero residual variance", stacklevel=2)
        return [r["i"] for r in rows]

    def get_adjacency(self, alpha: float = 0.05, method: str = "BH") -> DataFrame:
        """All pairs with ``q_value`` and ``is_edge``."""
        r = self._fitted()
        out = inf.fdr_control(r.edges, alpha, method, m=r.p * (r.p - 1) // 2)
        self.result_ = replace(r, adj_fdr=out, fdr_alpha=alpha)
        return out

    def release(self) -> None:
        """Drop the cached tables of the last fit (they can be recomputed)."""
        for df in getattr(self, "_held", []):
            df.unpersist()

    def scores(self) -> DataFrame:
        return self._fitted().edges.select("i", "j", F.abs("z").alias("score"))

    def assessed(self, alpha: float = 0.05) -> DataFrame:
        """Every pair with ``is_edge`` and ``score``."""
        return self.get_adjacency(alpha).select("i", "j", "is_edge", F.abs("z").alias("score"))

    def confidence_intervals(self, alpha: float = 0.05, method: str = "asymptotic",
                             X: DataFrame | None = None, n_splits: int = 25,
                             seed: int = 0) -> DataFrame:
        if method == "asymptotic":
            r = self._fitted()
            return inf.asymptotic_ci(r.edges, r.n, alpha)
        if method == "ensemble":
            if X is None:
                raise ValueError("method='ensemble' needs the samples: pass X")
            return inf.ensemble_ci(
                X, n_splits=n_splits, alpha=alpha, lambda_scale=self.lambda_scale, seed=seed,
                lambda_method=self.lambda_method, dof_correction=self.dof_correction,
            )
        raise ValueError(f"method must be 'asymptotic' or 'ensemble'; got {method!r}")

    # per-group interface used by stability selection over subsamples
    def keyed_values(self, keyed: DataFrame, p: int) -> DataFrame:
        """``key, i, j, value``: BH q-value of every pair within each key."""
        fits = inf.keyed_precision(
            keyed, p, self.lambda_scale, self.lambda_method, self.dof_correction,
            not self.standardise, self.max_iter, self.tol,
        )
        tested = fits.withColumn("p_value", inf.two_sided_p(F.col("z")))
        return inf.fdr_adjust_within(tested, ["key"], out="value").select("key", "i", "j", "value")

    def value_edges(self) -> DataFrame:
        return self.get_adjacency().select("i", "j", F.col("q_value").alias("value"))

    @staticmethod
    def selected(value, threshold):
        return value <= threshold


class _PrecisionEstimator:
    """Shared surface of estimators whose result is a penalised precision matrix.

    The result stays where its blocks were solved: ``_solved`` has a row a block.
    """

    _solved: DataFrame | None = None

    def _keep(self, solved: DataFrame, p: int) -> None:
        self.release()
        self._solved, self._p = solved.persist(), p
        self._spark = solved.sparkSession
        stopped = self._solved.filter("not ok").count()
        if stopped:
            warnings.warn(f"the graphical lasso did not converge in {stopped} blocks", stacklevel=3)

    def _fitted(self) -> DataFrame:
        if self._solved is None:
            raise RuntimeError("call fit() first")
        return self._solved

    def release(self) -> None:
        """Drop the cached blocks of the last fit (they can be recomputed)."""
        if self._solved is not None:
            self._solved.unpersist()

    @property
    def blocks_(self) -> DataFrame:
        """The solved blocks: ``key, lam, block, ok, logdet, fit, idx, theta``."""
        return self._fitted()

    @property
    def precision_matrix(self) -> np.ndarray:
        """The precision matrix on the driver (size checked)."""
        return dense_precision(self._fitted(), self._p)

    @property
    def precision_(self) -> DataFrame:
        """Edge table ``i, j, omega``."""
        found = solved_edges(self._fitted()).drop("key")
        return pair_grid(self._spark, self._p).join(found, ["i", "j"], "left").select(
            "i", "j", F.coalesce("omega", F.lit(0.0)).alias("omega"))

    def get_adjacency(self, threshold: float = 0.0) -> DataFrame:
        """``i, j, omega, is_edge`` with ``|omega| > threshold``."""
        return self.precision_.withColumn(
            "is_edge", (F.abs("omega") > F.lit(float(threshold))).cast("int")
        )

    def scores(self) -> DataFrame:
        return self.precision_.select("i", "j", F.abs("omega").alias("score"))

    def assessed(self, alpha: float = 0.05) -> DataFrame:
        """Every pair with ``is_edge`` and ``score`` (``alpha`` does not apply)."""
        return self.get_adjacency().select("i", "j", "is_edge", F.abs("omega").alias("score"))

    def value_edges(self) -> DataFrame:
        return self.precision_.select("i", "j", F.abs("omega").alias("value"))

    @staticmethod
    def selected(value, threshold):
        return value > threshold


def _refined(alphas: list[float], best: int, last_finite: int, k: int) -> list[float]:
    """Penalties between the neighbours of the best one (log scale)."""
    if best == 0:
        hi, lo = alphas[0], alphas[1]
    elif best == last_finite and best != len(alphas) - 1:
        hi, lo = alphas[best], alphas[best + 1]
    elif best == len(alphas) - 1:
        hi, lo = alphas[best], 0.01 * alphas[best]
    else:
        hi, lo = alphas[best - 1], alphas[best + 1]
    return list(np.logspace(math.log10(hi), math.log10(lo), k + 2)[1:-1])


class SklearnGLasso(_PrecisionEstimator):
    """Graphical lasso with the penalty chosen by cross-validation.

    Folds are contiguous in ``row_id``. One pass yields the statistics of every
    fold; the training covariance of a fold is the merge of the others, row by
    row. The likelihood of held-out samples is a sum over the blocks that each
    (fold, penalty) falls into, so every block is a task and the driver sees
    one number for each penalty. Folds that stop before they are done are counted in
    ``unconverged_`` and named in a warning.
    """

    def __init__(self, cv: int = 5, max_iter: int = 200, n_jobs: int = -1,
                 n_alphas: int = 4, n_refinements: int = 4) -> None:
        self.cv, self.max_iter, self.n_jobs = cv, max_iter, n_jobs
        self.n_alphas, self.n_refinements = n_alphas, n_refinements

    def fit(self, samples: DataFrame) -> "SklearnGLasso":
        spark = samples.sparkSession
        p = width(samples)
        n = samples.count()
        rows = checkpointed(fold_rows(with_folds(samples, n, self.cv), p, self.cv))
        whole = rows.filter("key = -1")
        top = largest_off_diagonal(whole)
        grid = list(np.logspace(math.log10(1e-2 * top), math.log10(top), self.n_alphas))[::-1]
        score: dict[float, float] = {}
        self.unconverged_ = 0
        for _ in range(self.n_refinements):
            todo = [a for a in grid if a not in score]
            problems = spark.createDataFrame(
                [(f, float(a)) for f in range(self.cv) for a in todo], "key INT, lam DOUBLE")
            solved = solve_blocks(rows.filter("key >= 0"), problems, p, max_iter=self.max_iter)
            each = solved.groupBy("key", "lam").agg(
                ((F.sum("logdet") - F.sum("fit") - p * math.log(2.0 * math.pi)) / 2.0).alias("score"),
                F.min("ok").alias("ok"))
            scored = each.groupBy("lam").agg(
                F.avg("score").alias("score"), F.sum((~F.col("ok")).cast("int")).alias("open")).collect()  # a row a penalty
            score.update({r["lam"]: r["score"] for r in scored})
            self.unconverged_ += sum(r["open"] for r in scored)
            alphas = sorted(score, reverse=True)
            best, last_finite, best_score = 0, 0, -math.inf
            for k, a in enumerate(alphas):
                if math.isfinite(score[a]):
                    last_finite = k
                    if score[a] >= best_score:
                        best_score, best = score[a], k
            self.alpha_ = alphas[best]
            grid = _refined(alphas, best, last_finite, self.n_alphas)
        if self.unconverged_:
            warnings.warn(f"{self.unconverged_} fits of folds did not converge", stacklevel=2)
        self.cv_scores_ = score
        one = spark.createDataFrame([(-1, float(self.alpha_))], "key INT, lam DOUBLE")
        self._keep(solve_blocks(whole, one, p, max_iter=self.max_iter), p)
        return self

    def keyed_values(self, keyed: DataFrame, p: int) -> DataFrame:
        """Fit every key at the penalty chosen on the whole table."""
        return _keyed_glasso(keyed, p, self.alpha_, 0)


class GGLassoEstimator(_PrecisionEstimator):
    """Graphical lasso at a fixed penalty on the sample covariance."""

    def __init__(self, lambda1: float = 0.1) -> None:
        self.lambda1 = lambda1

    def fit(self, samples: DataFrame) -> "GGLassoEstimator":
        p = width(samples)
        one = samples.sparkSession.createDataFrame([(0, float(self.lambda1))], "key INT, lam DOUBLE")
        self._keep(solve_blocks(covariance_rows(samples, p, ddof=1), one, p), p)
        return self

    def keyed_values(self, keyed: DataFrame, p: int) -> DataFrame:
        return _keyed_glasso(keyed, p, self.lambda1, 1)


def _keyed_glasso(keyed: DataFrame, p: int, lam: float, ddof: int) -> DataFrame:
    """``key, i, j, value`` of every pair and group; the groups' blocks are solved side by side."""
    rows = covariance_rows(keyed, p, ddof, keyed=True)
    solved = solve_blocks(rows, lam, p)
    found = solved_edges(solved)
    keys = rows.filter("i = 0").select("key")
    grid = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(p - 2))).alias("i")).select(
        "key", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(p - 1))).alias("j"))
    return grid.join(found, ["key", "i", "j"], "left").select(
        "key", "i", "j", F.abs(F.coalesce("omega", F.lit(0.0))).alias("value"))


class PIGLassoEstimator:
    """Stability selection over a graphical-lasso path, with an optional prior.

    Each subsample's path is one task (penalties are solved in order with warm
    starts). Selection counts are aggregated as ordinary rows.
    """

    EDGE_EPS = 1e-5  # fixed value: an entry above it counts as selected

    def __init__(self, Q: int = 50, b_perc: float = 0.65, n_lambda: int = 20,
                 lambda_lo: float = 0.05, lambda_hi: float = 0.30,
                 pi_thr: float | str = 0.9, v_target: float = 1.0,
                 prior_weight: float = 0.5, n_jobs: int = 1, seed: int = 42) -> None:
        if isinstance(pi_thr, str) and pi_thr != "adaptive":
            raise ValueError(f"pi_thr must be a number or 'adaptive'; got {pi_thr!r}")
        if isinstance(pi_thr, float) and not 0.5 < pi_thr <= 1.0:
            raise ValueError(f"a fixed pi_thr must be in (0.5, 1]; got {pi_thr}")
        if v_target <= 0:
            raise ValueError(f"v_target must be positive; got {v_target}")
        self.Q, self.b_perc, self.n_lambda = Q, b_perc, n_lambda
        self.lambda_lo, self.lambda_hi = lambda_lo, lambda_hi
        self.pi_thr, self.v_target, self.prior_weight = pi_thr, v_target, prior_weight
        self.n_jobs, self.seed = n_jobs, seed
        self.stability_: DataFrame | None = None
        self.pi_thr_adaptive_: float | None = None

    def selections(self, samples: DataFrame, n: int, p: int, mask: np.ndarray | None) -> DataFrame:
        """``sub_id, lam_idx, ok, i, j``: selected pairs, plus one row with NULL
        ends per (subsample, penalty) that carries the convergence flag."""
        size = max(2, math.ceil(self.b_perc * n))
        if size >= n:
            raise ValueError(f"b_perc={self.b_perc} leaves no sample out (b={size}, n={n})")
        grid = np.linspace(self.lambda_lo, self.lambda_hi, self.n_lambda)
        keyed = with_subsets(samples, n, size, self.Q, self.seed)
        eps = self.EDGE_EPS
        shared = None if mask is None else samples.sparkSession.sparkContext.broadcast(mask)

        def path(pdf: pd.DataFrame) -> pd.DataFrame:
            s = assemble(pdf).covariance()
            weight = None if shared is None else shared.value
            start, parts = None, []
            upper = np.triu(np.ones((p, p), bool), 1)
            for k, lam in enumerate(grid):
                theta, dual, ok = glasso(s, float(lam), weight, start, 500, 1e-5, 1e-4)
                parts.append(pd.DataFrame({"lam_idx": [k], "ok": [int(ok)], "i": [-1], "j": [-1]}))
                if not ok:
                    continue
                i, j = np.nonzero((np.abs(theta) > eps) & upper)
                parts.append(pd.DataFrame({"lam_idx": k, "ok": 1, "i": i, "j": j}))
                start = (theta, dual)
            out = pd.concat(parts, ignore_index=True)
            out.insert(0, "sub_id", int(pdf["key"].iloc[0]))
            return out

        return spread(stat_blocks(keyed, p, keyed=True), "key").groupBy("key").applyInPandas(
            path, "sub_id INT, lam_idx INT, ok INT, i INT, j INT"
        )

    def fit(self, samples: DataFrame, prior: DataFrame | None = None) -> "PIGLassoEstimator":
        spark = samples.sparkSession
        p = width(samples)
        check_dense(p, "stability selection")
        n = samples.count()
        mask = None if prior is None else penalty_mask(prior, p, self.prior_weight)
        sel = self.selections(samples, n, p, mask).persist()
        self.selections_ = sel
        failed = sel.filter("ok = 0").count()
        if failed:
            warnings.warn(f"{failed} of {self.Q * self.n_lambda} subsample solves did not converge and are left out", stacklevel=2)
        freq = selection_frequency(sel)
        self.stability_ = stability_scores(freq, pair_grid(spark, p))
        self.pi_thr_adaptive_ = adaptive_threshold(freq, p, self.n_lambda, self.v_target)
        return self

    @property
    def precision_(self) -> DataFrame:
        """The stability scores, under the name the benchmark runner expects."""
        if self.stability_ is None:
            raise RuntimeError("call fit() first")
        return self.stability_.withColumnRenamed("stability", "omega")

    def get_adjacency(self, threshold: float | None = None) -> DataFrame:
        """``stability >= threshold`` (inclusive)."""
        if self.stability_ is None:
            raise RuntimeError("call fit() first")
        if threshold is None:
            threshold = self.pi_thr_adaptive_ if self.pi_thr == "adaptive" else self.pi_thr
        return self.stability_.withColumn(
            "is_edge", (F.col("stability") >= F.lit(float(threshold))).cast("int")
        )

    def release(self) -> None:
        """Drop the cached selections of the last fit."""
        if self.stability_ is not None:
            self.selections_.unpersist()

    def scores(self) -> DataFrame:
        return self.precision_.select("i", "j", F.col("omega").alias("score"))

    def assessed(self, alpha: float = 0.05) -> DataFrame:
        """Every pair with ``is_edge`` and ``score`` (``alpha`` does not apply)."""
        return self.get_adjacency().select("i", "j", "is_edge", F.col("stability").alias("score"))


def penalty_mask(prior: DataFrame, p: int, weight: float) -> np.ndarray:
    """Per-pair penalty multiplier ``clip(1 - weight * prior, 0.1, 1)``."""
    from edgeloom.operators.preprocess import dense_from_edges

    dense = dense_from_edges(mask_edges(prior, weight), "mask", p, 1.0)
    dense[dense == 0.0] = 1.0  # pairs absent from the prior table
    return dense


def mask_edges(prior: DataFrame, weight: float) -> DataFrame:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prior")))
    mask = F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 - F.lit(float(weight)) * clipped))
    return prior.select("i", "j", mask.alias("mask"))


def selection_frequency(selections: DataFrame) -> DataFrame:
    """``lam_idx, i, j, freq`` over converged fits (pairs never selected are absent)."""
    fits = selections.filter("i = -1").groupBy("lam_idx").agg(F.sum("ok").alias("n_ok"))
    counts = selections.filter("i >= 0").groupBy("lam_idx", "i", "j").agg(
        F.count(F.lit(1)).alias("c")
    )
    return counts.join(F.broadcast(fits), "lam_idx").select(  # one row per penalty
        "lam_idx", "i", "j", (F.col("c") / F.greatest("n_ok", F.lit(1))).alias("freq")
    )


def stability_scores(freq: DataFrame, grid: DataFrame) -> DataFrame:
    """Largest selection frequency of every pair along the path."""
    best = freq.groupBy("i", "j").agg(F.max("freq").alias("s"))
    return grid.join(best, ["i", "j"], "left").select(
        "i", "j", F.coalesce("s", F.lit(0.0)).alias("stability")
    )


def adaptive_threshold(freq: DataFrame, p: int, n_lambda: int, v_target: float) -> float:
    pairs = p * (p - 1) / 2.0
    total = freq.agg(F.coalesce(F.sum("freq"), F.lit(0.0))).first()[0]
    q = total / (n_lambda * pairs) * pairs
    return float(min(0.90, max(0.501, 0.5 + q / (2.0 * math.sqrt(pairs * v_target)))))
