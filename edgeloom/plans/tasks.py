"""Benchmark runner and task grids.

Every estimator distributes its own work, so the runner starts them from the
driver one after another (or from a few driver threads, which lets Spark
overlap their stages). A failed method is a row with its traceback.
"""

from __future__ import annotations

import itertools
import time
import traceback
from concurrent.futures import ThreadPoolExecutor
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import diffusion, estimators, inference, metrics, preprocess, priors, simulate, stars
from edgeloom.operators.gram import collect_stats
from edgeloom.operators.matrix import width
from edgeloom.operators.metrics import NAN

# Samples and variables of the named configurations
CONFIGS = {
    "n100p50": (100, 50), "n237p78": (237, 78), "n513p164": (513, 164), "n1026p328": (1026, 328),
    "n100p160": (100, 160), "n300p160": (300, 160), "n500p160": (500, 160), "n700p160": (700, 160),
    "n900p160": (900, 160), "n1100p160": (1100, 160), "n1300p160": (1300, 160), "n1500p160": (1500, 160),
}
TOPOLOGIES = ("hub", "scale-free", "cluster", "random")
METRICS = ["aupr", "auroc", "f1", "f1_opt", "mcc", "shd", "precision", "recall", "tp", "fp", "tn", "fn"]
COUNTS = {"shd", "tp", "fp", "tn", "fn"}


def run_single(cls: type, kwargs: dict, name: str, samples: DataFrame, truth: DataFrame,
               alpha: float = 0.05) -> dict:
    """Fit one method and score it; never raises."""
    row: dict = {"method": name, "error": None}
    start = time.perf_counter()
    try:
        est = cls(**kwargs).fit(samples)
        if not hasattr(est, "assessed"):
            raise AttributeError("the estimator has no assessed() table of pairs")
        got = metrics.assess(est.assessed(alpha), truth, width(samples)).first()
        row.update(got.asDict())
        if hasattr(est, "release"):
            est.release()
    except Exception:
        row["error"] = traceback.format_exc()
    row["wall_seconds"] = time.perf_counter() - start
    return row


def run_benchmark(specs: list[tuple[type, dict, str]], samples: DataFrame, truth: DataFrame,
                  alpha: float = 0.05, n_jobs: int = 1) -> DataFrame:
    """One row per ``(class, kwargs, name)``."""
    spark = samples.sparkSession
    run = lambda s: run_single(s[0], s[1], s[2], samples, truth, alpha)
    if n_jobs == 1:
        rows = [run(s) for s in specs]
    else:
        with ThreadPoolExecutor(max_workers=max(1, n_jobs if n_jobs > 0 else len(specs))) as pool:
            rows = list(pool.map(run, specs))
    return results_table(spark, rows)


def results_table(spark: SparkSession, rows: list[dict], extra: str = "") -> DataFrame:
    """Result rows with a fixed schema (a handful of rows from the driver)."""
    fields = "method STRING, error STRING, " + ", ".join(
        f"{m} {'BIGINT' if m in COUNTS else 'DOUBLE'}" for m in METRICS) + ", wall_seconds DOUBLE" + extra
    names = [f.split()[0] for f in fields.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], fields)


def make_estimator(method: str, truth: DataFrame | None = None, p: int = 0, samples: DataFrame | None = None,
                   seed: int = 0, prior_weight: float = 0.5, prior_noise: float = 0.2):
    """``(estimator, prior)`` for a benchmark method name.

    ``piglasso_oracle_nXX`` uses a noisy oracle prior with noise ``XX / 20``.
    """
    pig = estimators.PIGLassoEstimator
    if method == "desparsified":
        return estimators.DesparifiedGGM(), None
    if method == "glasso":
        return estimators.SklearnGLasso(), None
    if method == "gglasso":
        return estimators.GGLassoEstimator(), None
    if method in ("ssglasso", "piglasso"):
        return pig(), None
    if method == "piglasso_adaptive":
        return pig(pi_thr="adaptive"), None
    if method == "piglasso_corr":
        return pig(prior_weight=prior_weight), priors.corr_prior(samples, p)
    if method.startswith("piglasso_oracle"):
        tag = method.removeprefix("piglasso_oracle").removeprefix("_n")
        noise = int(tag) / 20.0 if tag else prior_noise
        return pig(prior_weight=prior_weight), priors.noisy_oracle_prior(truth, p, noise, seed)
    raise ValueError(f"unknown method {method!r}")


def replicate_seed(topology: str, rep: int, seed_offset: int = 0) -> int:
    """Reproducible seed of a replicate (the topology enters by a fixed checksum)."""
    return seed_offset * 100_000 + rep * 1000 + crc32(topology.encode()) % 1000


def fit_and_score(est, prior, samples: DataFrame, truth: DataFrame, p: int, alpha: float) -> dict:
    start = time.perf_counter()
    est = est.fit(samples) if prior is None else est.fit(samples, prior)
    row = metrics.assess(est.assessed(alpha), truth, p).first().asDict()
    if hasattr(est, "release"):
        est.release()
    row["wall_seconds"] = time.perf_counter() - start
    return row


def synthetic_task(spark: SparkSession, topology: str, config: str, method: str, rep: int,
                   seed_offset: int = 0, alpha: float = 0.05) -> DataFrame:
    n, p = CONFIGS[config]
    seed = replicate_seed(topology, rep, seed_offset)
    data = simulate.generate(spark, n, p, topology, 0.05, seed)
    samples = data.samples.persist()
    est, prior = make_estimator(method, data.true_edges, p, samples, seed)
    row = fit_and_score(est, prior, samples, data.true_edges, p, alpha)
    samples.unpersist()
    row.update(method=method, topology=topology, config=config, rep=rep, n=n, p=p, seed_offset=seed_offset)
    return results_table(spark, [row], ", topology STRING, config STRING, rep INT, n INT, p INT, seed_offset INT")


def stars_task(spark: SparkSession, topology: str, config: str, rep: int, beta: float = 0.05,
               n_subsamples: int = 20) -> DataFrame:
    n, p = CONFIGS[config]
    data = simulate.generate(spark, n, p, topology, 0.05, replicate_seed(topology, rep))
    start = time.perf_counter()
    est = estimators.DesparifiedGGM()
    adj, theta = stars.stars_select(data.samples, est, beta, n_subsamples)
    row = metrics.evaluate_predictions(adj, data.true_edges, p, est.scores()).first().asDict()
    row.update(method="stars", wall_seconds=time.perf_counter() - start, topology=topology, config=config,
               rep=rep, n=n, p=p, beta=beta, selected_threshold=theta, n_subsamples=n_subsamples)
    return results_table(spark, [row], ", topology STRING, config STRING, rep INT, n INT, p INT, beta DOUBLE, "
                                       "selected_threshold DOUBLE, n_subsamples INT")


def expression_task(samples: DataFrame, variables: DataFrame, truth: DataFrame, method: str,
                    top: int | None = None, npn: bool = True, log2: bool = False,
                    prior: DataFrame | None = None, alpha: float = 0.05, prior_weight: float = 0.5) -> DataFrame:
    """Score one method on an expression table (top variables by variance, then rank transform).

    ``prior`` (``i, j, prior``) belongs to the stability methods (names that
    begin with ``piglasso``); ``prior_weight`` is how much it lowers a penalty.
    """
    if prior is not None and not method.startswith("piglasso"):
        raise ValueError(f"method {method!r} takes no prior")
    spark = samples.sparkSession
    if top is not None:
        keep = [r["var_id"] for r in preprocess.top_variance(samples, top).collect()]
        samples = preprocess.select_variables(samples, keep)
        order = spark.createDataFrame(list(enumerate(keep)), "new INT, var_id INT")
        to = variables.join(order, "var_id")
        truth = _renumber(truth, order)
        prior = None if prior is None else _renumber(prior, order)
        variables = to.select(F.col("new").alias("var_id"), "var_name")
    if log2:
        samples = preprocess.log2p1(samples)
    if npn:
        samples = preprocess.npn_shrinkage(samples)
    p = width(samples)
    samples = samples.persist()
    if prior is None:
        est, own = make_estimator(method, truth, p, samples, prior_weight=prior_weight)
    else:
        limit = "adaptive" if method == "piglasso_adaptive" else 0.9
        est, own = estimators.PIGLassoEstimator(pi_thr=limit, prior_weight=prior_weight), prior
    row = fit_and_score(est, own, samples, truth, p, alpha)
    samples.unpersist()
    row.update(method=method, p=p)
    return results_table(spark, [row], ", p INT")


# fixed values: columns of a diffusion record, in order
DIFFUSION_COLUMNS = [
    "topology", "config", "method", "rep", "n", "p", "delta_mode", "diffusion_spearman_mean", "diffusion_spearman_min",
    "diffusion_mae_mean", "knockout_spearman", "knockout_top10_recall", "knockout_topk_recall", "n_components_pred",
    "diffusion_spearman_mean_null", "knockout_spearman_null", "diffusion_spearman_norm", "knockout_spearman_norm", "wall_seconds"]


def diffusion_records(predicted: DataFrame, truth: DataFrame, p: int, n: int, topology: str, config: str, method: str, rep: int,
                      delta: str = "all", mode: str = "both", tmin: float = 1e-4, tmax: float = 3.0, nt: int = 80,
                      reduction: float = 0.3, topk: int = 10, normalised: bool = False, seed: int = 0) -> DataFrame:
    """A record of ``DIFFUSION_COLUMNS`` for each start signal asked for.

    Stability methods have no order that the other signals would follow, so they
    are always scored with the random one. What a mode does not measure is NaN.
    """
    spark = predicted.sparkSession
    modes = ["random"] if method.startswith("piglasso") else ["random", "hub", "fiedler"] if delta == "all" else [delta]
    times = [float(t) for t in np.linspace(tmin, tmax, nt)]
    out = None
    for m in modes:
        start = time.perf_counter()
        row = diffusion.diffusion_task(predicted, truth, p, m, times, seed, mode, reduction, topk, normalised).first().asDict()
        row.update(topology=topology, config=config, method=method, rep=rep, n=n, p=p, delta_mode=m,
                   wall_seconds=time.perf_counter() - start)
        kinds = {"topology": "STRING", "config": "STRING", "method": "STRING", "delta_mode": "STRING", "rep": "INT", "n": "INT", "p": "INT"}
        one = spark.createDataFrame([tuple(row[c] for c in DIFFUSION_COLUMNS)], ", ".join(f"{c} {kinds.get(c, 'DOUBLE')}" for c in DIFFUSION_COLUMNS))
        out = one if out is None else out.unionByName(one)
    return out


def _renumber(edges: DataFrame, order: DataFrame) -> DataFrame:
    a = order.select(F.col("var_id").alias("i"), F.col("new").alias("_i"))
    b = order.select(F.col("var_id").alias("j"), F.col("new").alias("_j"))
    rest = [c for c in edges.columns if c not in ("i", "j")]
    return edges.join(a, "i").join(b, "j").select(
        F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), *rest)


def task_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the given axis values, one row each."""
    rows = list(itertools.product(*axes.values()))
    return spark.createDataFrame(pd.DataFrame(rows, columns=list(axes)))


def coverage_study(spark: SparkSession, topology: str, n: int, p: int, reps: int, n_splits: int = 25,
                   frac: float = 0.5, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Share of true precision entries inside the intervals, over all, null and active pairs."""
    out = None
    for rep in range(reps):
        data = simulate.generate(spark, n, p, topology, min(0.4, max(0.05, 3.0 / max(p - 1, 1))),
                                 replicate_seed(topology, rep, seed), hub_spread=5, cluster_share=4)
        scale = preprocess.column_stats(data.samples).select("var_id", "std")
        si = scale.select(F.col("var_id").alias("i"), F.col("std").alias("si"))
        sj = scale.select(F.col("var_id").alias("j"), F.col("std").alias("sj"))
        est = estimators.DesparifiedGGM().fit(data.samples)
        one = inference.asymptotic_ci(est.result_.edges, n, alpha).select("i", "j", F.lit("asymptotic").alias("kind"), "lower", "upper")
        many = inference.ensemble_ci(data.samples, n_splits, frac, alpha, seed=seed, n=n).select(
            "i", "j", F.lit("ensemble").alias("kind"), "lower", "upper")
        # samples are standardised before the fit: entries are compared on that scale
        theta = data.theta_edges.select("i", "j", "theta")
        part = one.unionByName(many).join(theta, ["i", "j"], "left").join(si, "i").join(sj, "j").select(
            "kind", "lower", "upper", (F.coalesce("theta", F.lit(0.0)) * F.col("si") * F.col("sj")).alias("t"))
        out = part if out is None else out.unionByName(part)
    inside = ((F.col("lower") <= F.col("t")) & (F.col("t") <= F.col("upper"))).cast("double")
    return out.groupBy("kind").agg(
        F.avg(inside).alias("coverage_all"),
        F.coalesce(F.avg(F.when(F.col("t") == 0, inside)), F.lit(NAN)).alias("coverage_null"),
        F.coalesce(F.avg(F.when(F.col("t") != 0, inside)), F.lit(NAN)).alias("coverage_active"),
        F.avg(F.col("upper") - F.col("lower")).alias("mean_width"),
    ).withColumns({"topology": F.lit(topology), "n": F.lit(n), "p": F.lit(p)})


def burn_network(samples: DataFrame, variables: DataFrame, alphas=(0.05, 0.10)) -> tuple[DataFrame, DataFrame]:
    """``(edges with names, summary)`` of one fit tested at several FDR levels."""
    from edgeloom.operators.graph import network_summary
    from edgeloom.operators.matrix import named

    x = preprocess.npn_shrinkage(samples).persist()
    stats = collect_stats(x)
    est = estimators.DesparifiedGGM().fit(x)
    tested = est.get_adjacency(max(alphas)).persist()
    summary = None
    for a in alphas:  # the fit and the q-values are shared by all levels
        s = network_summary(tested.filter(F.col("q_value") <= a), stats.p).withColumn("alpha", F.lit(a))
        summary = s if summary is None else summary.unionByName(s)
    return named(tested, variables), summary
