"""Heat diffusion and knock-out analysis on graphs.

A graph enters as an edge table. Small graphs (``DENSE_NODES``, or
``MAX_DENSE_P`` for one signal a graph) are decomposed inside tasks. Larger
ones are never made a matrix: their edges are broadcast behind a check of
their number, and tasks apply a Chebyshev series of the heat kernel to some
times, or to some knocked-out nodes at once. Graphs whose edges are too many to
broadcast are diffused by the same series with products as joins.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.graph import components, degree, erdos_renyi_matching, hub_node, laplacian
from edgeloom.operators.matrix import MAX_DENSE_P, check_dense
from edgeloom.operators.metrics import NAN, normalised_score, top_k_recall
from edgeloom.operators.preprocess import dense_from_edges
from edgeloom.operators.prefix import average_rank
from edgeloom.operators.sparse import (
    MAX_CELLS, MAX_EDGES, Laplacian, chebyshev_weights, edge_arrays, fiedler_vector, heat_series,
)
from edgeloom.session import checkpointed, spread

DENSE_NODES = 256  # up to here a decomposition is as cheap as a series


def dense_laplacian(a: np.ndarray, normalised: bool = False) -> np.ndarray:
    d = a.sum(axis=1)
    lap = np.diag(d) - a
    if normalised:
        inv = np.where(d > 0, 1.0 / np.sqrt(np.where(d > 0, d, 1.0)), 0.0)
        lap = inv[:, None] * lap * inv[None, :]
    return lap


def dense_adjacency(edges: DataFrame, p: int) -> np.ndarray:
    check_dense(p, "a dense adjacency matrix")
    return dense_from_edges(edges.select("i", "j", F.lit(1.0).alias("a")), "a", p, 0.0)


def heat(lap: np.ndarray, delta: np.ndarray, t_grid: np.ndarray) -> np.ndarray:
    """Columns ``exp(-t L) delta``."""
    lam, v = np.linalg.eigh(lap)
    return v @ (np.exp(-np.outer(lam, t_grid)) * (v.T @ delta)[:, None])


def make_delta(edges: DataFrame, p: int, mode: str, seed: int = 0) -> np.ndarray:
    """Unit start signal: ``random``, one-hot at the ``hub``, or the ``fiedler`` vector."""
    if mode == "hub":
        out = np.zeros(p)
        out[hub_node(edges, p).first()["node"]] = 1.0
        return out
    if mode == "fiedler" and p > DENSE_NODES:
        if components(edges, p).agg(F.countDistinct("component")).first()[0] == 1:
            return _sparse_fiedler(edges, p)
        warnings.warn("the graph is disconnected: using a random start signal", stacklevel=2)
    elif mode == "fiedler":
        lam, v = np.linalg.eigh(dense_laplacian(dense_adjacency(edges, p)))
        if int((lam < 1e-10).sum()) == 1:
            return v[:, 1] / np.linalg.norm(v[:, 1])
        warnings.warn("the graph is disconnected: using a random start signal", stacklevel=2)
    elif mode != "random":
        raise ValueError(f"unknown delta mode {mode!r}")
    out = np.random.default_rng(seed).standard_normal(p)
    return out / np.linalg.norm(out)


def _sparse_fiedler(edges: DataFrame, p: int) -> np.ndarray:
    """The Fiedler vector in one task; with products as Spark jobs where the edges are too many for it."""
    spark = edges.sparkSession
    arrays = edge_arrays(edges)
    if arrays is None:
        return fiedler_vector(distributed_product(edges, p), p)
    shared = spark.sparkContext.broadcast(arrays)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                lap = Laplacian(p, *shared.value)
                yield pd.DataFrame({"v": [fiedler_vector(lambda x: lap @ x, p)]})

    return np.asarray(spark.range(1).mapInPandas(run, "v ARRAY<DOUBLE>").first()["v"])  # p doubles


def distributed_product(edges: DataFrame, p: int):
    """``x -> L x`` as a job over the edge table; the vector (p doubles) is broadcast and comes back."""
    spark = edges.sparkSession
    ends = edges.select("i", "j")

    def product(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def partial(batches):
            v = shared.value
            for pdf in batches:
                i, j = pdf["i"].to_numpy(int), pdf["j"].to_numpy(int)
                moved = v[i] - v[j]
                yield pd.DataFrame({"node": np.concatenate([i, j]), "y": np.concatenate([moved, -moved])})

        sums = ends.mapInPandas(partial, "node INT, y DOUBLE").groupBy("node").agg(F.sum("y").alias("y")).toArrow()
        out = np.zeros(p)
        out[sums.column("node").to_numpy()] = sums.column("y").to_numpy()
        shared.destroy()
        return out

    return product


def diffuse(graphs: DataFrame, p: int, delta: np.ndarray, t_grid, normalised: bool = False) -> DataFrame:
    """``graph, node, t_idx, t, s`` for edges keyed by ``graph``; one task per graph."""
    times = np.asarray(t_grid, dtype=float)
    if p > MAX_DENSE_P:
        return _diffuse_sparse(graphs, p, delta, times, normalised)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((p, p))
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        a[i, j] = a[j, i] = 1.0
        s = heat(dense_laplacian(a, normalised), delta, times)
        nodes, steps = np.meshgrid(np.arange(p), np.arange(len(times)), indexing="ij")
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "node": nodes.ravel(),
                             "t_idx": steps.ravel(), "t": times[steps.ravel()], "s": s.ravel()})

    return spread(graphs.select("graph", "i", "j"), "graph").groupBy("graph").applyInPandas(
        run, "graph STRING, node INT, t_idx INT, t DOUBLE, s DOUBLE"
    )


def _diffuse_sparse(graphs: DataFrame, p: int, delta: np.ndarray, times: np.ndarray, normalised: bool) -> DataFrame:
    """One task for some times of a graph, on its broadcast edges; by joins where they are too many."""
    spark = graphs.sparkSession
    some, out = max(1, MAX_CELLS // p), None
    for name in [r["graph"] for r in graphs.select("graph").distinct().collect()]:  # a few graphs
        edges = graphs.filter(F.col("graph") == name).select("i", "j")
        arrays = edge_arrays(edges)
        if arrays is None:
            rows = _diffuse_by_joins(edges, p, delta, times, normalised)
        else:
            shared = spark.sparkContext.broadcast((arrays, delta))

            def run(batches, shared=shared):
                for pdf in batches:
                    for lo in pdf["id"].to_numpy(int):
                        own, start = shared.value
                        lap = Laplacian(p, *own, normalised)
                        part = times[lo:lo + some]
                        for k, s in enumerate(heat_series(lambda x: lap @ x, lap.top, start, part)):
                            yield pd.DataFrame({"node": np.arange(p), "t_idx": lo + k, "t": part[k], "s": s})

            cuts = -(-len(times) // some)
            rows = spark.range(0, len(times), some, cuts).mapInPandas(run, "node INT, t_idx INT, t DOUBLE, s DOUBLE")
        rows = rows.select(F.lit(name).alias("graph"), "node", "t_idx", "t", "s")
        out = rows if out is None else out.unionByName(rows)
    return out


def _diffuse_by_joins(edges: DataFrame, p: int, delta: np.ndarray, times: np.ndarray, normalised: bool) -> DataFrame:
    """The Chebyshev series with each product a join: ``T_k = 2 (2 L / c - 1) T_(k-1) - T_(k-2)``.

    The terms do not depend on t, so one product a term serves the whole time
    grid; the sums for all times travel with the node. There are about
    ``sqrt(c t)`` terms.
    """
    spark = edges.sparkSession
    lap = checkpointed(laplacian(edges, p, normalised))
    c = 2.0 if normalised else 2.0 * max(degree(edges, p).agg(F.max("degree")).first()[0], 1)
    w = chebyshev_weights(times, c)
    weights = lambda k: F.array(*[F.lit(float(x)) for x in w[k]])
    start = spark.createDataFrame(pd.DataFrame({"node": np.arange(p, dtype=np.int32), "v": delta}))
    state = start.select("node", F.lit(0.0).alias("u"), "v", F.transform(weights(0), lambda x: x * F.col("v")).alias("s"))
    for k in range(1, len(w)):
        product = (
            lap.join(state.select(F.col("node").alias("j"), "v"), "j").groupBy(F.col("i").alias("node"))
            .agg(F.sum(F.col("l") * F.col("v")).alias("lv"))
        )
        step = F.coalesce("lv", F.lit(0.0)) * (2.0 / c) - F.col("v")
        new = step if k == 1 else 2.0 * step - F.col("u")
        moved = state.join(product, "node", "left").select("node", F.col("v").alias("u"), new.alias("v"), "s")
        # the state is read twice by the next term, so it is stored after each
        state = checkpointed(moved.select(
            "node", "u", "v", F.zip_with("s", weights(k), lambda s, x: s + x * F.col("v")).alias("s")))
    t_grid = F.array(*[F.lit(float(t)) for t in times])
    return state.select("node", F.posexplode("s").alias("t_idx", "s")).select(
        "node", "t_idx", F.element_at(t_grid, F.col("t_idx") + 1).alias("t"), "s")


def _correlation(x: str, y: str):
    """Correlation of two columns, null (and no error) where one of them is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def diffusion_metrics(signals: DataFrame, predicted: str, truth: str, p: int) -> DataFrame:
    """Spearman (mean and worst over t) and mean absolute error of two signals."""
    a = signals.filter(F.col("graph") == truth).select("t_idx", "node", F.round("s", 12).alias("a"), F.col("s").alias("ra"))
    b = signals.filter(F.col("graph") == predicted).select("t_idx", "node", F.round("s", 12).alias("b"), F.col("s").alias("rb"))
    both = a.join(b, ["t_idx", "node"])
    ranked = average_rank(average_rank(both, "a", ["t_idx"], p, "ka"), "b", ["t_idx"], p, "kb")
    per_t = ranked.groupBy("t_idx").agg(
        _correlation("ka", "kb").alias("rho"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("mae")
    )
    rho = F.when(F.col("rho").isNull() | F.isnan("rho"), 0.0).otherwise(F.col("rho"))
    return per_t.agg(
        F.avg(rho).alias("diffusion_spearman_mean"), F.min(rho).alias("diffusion_spearman_min"),
        F.avg("mae").alias("diffusion_mae_mean"),
    )


def evaluate_diffusion(predicted: DataFrame, truth: DataFrame, p: int, delta: np.ndarray, t_grid,
                       normalised: bool = False) -> DataFrame:
    graphs = predicted.select(F.lit("pred").alias("graph"), "i", "j").unionByName(
        truth.select(F.lit("true").alias("graph"), "i", "j"))
    m = diffusion_metrics(diffuse(graphs, p, delta, t_grid, normalised), "pred", "true", p)
    n_comp = components(predicted, p).agg(F.countDistinct("component").alias("c")).scalar()
    return m.withColumn("n_components_pred", n_comp)


def knockout_impacts(edges: DataFrame, p: int, delta: np.ndarray, t_grid,
                     reduction: float = 0.3) -> DataFrame:
    """``node, impact``: largest signal change when a node's edges are weakened.

    Nodes are spread over tasks. Small graphs are decomposed for each node;
    larger ones stay sparse (``_sparse_impacts``). The edge arrays are broadcast
    (size-checked).
    """
    spark = edges.sparkSession
    times = np.asarray(t_grid, dtype=float)
    if p > DENSE_NODES:
        return _sparse_impacts(edges, p, delta, times, reduction)
    base_a = dense_adjacency(edges, p)
    base_s = heat(dense_laplacian(base_a), delta, times)
    shared = spark.sparkContext.broadcast((base_a, base_s, delta, times))

    def score(batches):
        a, s0, d, ts = shared.value
        for pdf in batches:
            impacts = []
            for node in pdf["id"].to_numpy(int):
                weak = a.copy()
                weak[node] *= reduction
                weak[:, node] *= reduction
                diff = heat(dense_laplacian(weak), d, ts) - s0
                impacts.append(float(np.sqrt((diff**2).sum(axis=0)).max()))
            yield pd.DataFrame({"node": pdf["id"].astype("int32"), "impact": impacts})

    tasks = min(p, spark.sparkContext.defaultParallelism)
    return spark.range(0, p, 1, tasks).mapInPandas(score, "node INT, impact DOUBLE")


def _sparse_impacts(edges: DataFrame, p: int, delta: np.ndarray, times: np.ndarray, reduction: float) -> DataFrame:
    """Impacts by Chebyshev series: a task carries some nodes' perturbed signals as columns.

    The perturbed Laplacians differ from the common one in the edges of one
    node each, so a term is one sparse product for all columns and a correction
    at those edges. Column 0 is the signal without a perturbation.
    """
    spark = edges.sparkSession
    arrays = edge_arrays(edges)
    if arrays is None:
        raise ValueError(f"knock-outs need the graph in a task; the limit is {MAX_EDGES} edges")
    shared = spark.sparkContext.broadcast((*arrays, delta))
    at_once = max(1, min(len(times), MAX_CELLS // (2 * p)))
    columns = max(1, MAX_CELLS // (at_once * p) - 1)

    def impacts(lap: Laplacian, nodes: np.ndarray, start: np.ndarray) -> np.ndarray:
        lo, hi = lap.starts[nodes], lap.starts[nodes + 1]
        col = np.repeat(np.arange(1, len(nodes) + 1), hi - lo)
        pos = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange(len(col))
        v, u, change = nodes[col - 1], lap.cols[pos], (reduction - 1.0) * lap.w[pos]

        def product(x: np.ndarray) -> np.ndarray:
            y = lap @ x
            moved = change * (x[u, col] - x[v, col])
            np.add.at(y, (u, col), moved)
            np.subtract.at(y, (v, col), moved)
            return y

        x, worst = np.repeat(start[:, None], len(nodes) + 1, axis=1), np.zeros(len(nodes))
        for k in range(0, len(times), at_once):
            s = heat_series(product, lap.top, x, times[k:k + at_once])
            far = np.sqrt(((s[:, :, 1:] - s[:, :, :1]) ** 2).sum(axis=1))
            worst = np.maximum(worst, far.max(axis=0))
        return worst

    def score(batches):
        lap = None
        for pdf in batches:
            i, j, w, start = shared.value
            lap = lap or Laplacian(p, i, j, w)
            nodes = pdf["id"].to_numpy(int)
            for k in range(0, len(nodes), columns):
                some = nodes[k:k + columns]
                yield pd.DataFrame({"node": some.astype(np.int32), "impact": impacts(lap, some, start)})

    tasks = min(p, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, p, 1, tasks).mapInPandas(score, "node INT, impact DOUBLE")


def knockout_ranking(impacts: DataFrame) -> DataFrame:
    """Nodes by descending impact (one row per node)."""
    w = Window.orderBy(F.desc("impact"), "node")
    return impacts.withColumn("rank", F.row_number().over(w))


def knockout_metrics(impact_true: DataFrame, impact_pred: DataFrame, p: int, topk: int = 10) -> DataFrame:
    """Spearman of the impacts and recall of the most critical nodes."""
    k_eff, top10 = max(1, min(topk, p // 5)), min(10, p)
    both = impact_true.select("node", F.round("impact", 12).alias("a")).join(
        impact_pred.select("node", F.round("impact", 12).alias("b")), "node")
    ranked = average_rank(average_rank(both.withColumn("_g", F.lit(0)), "a", ["_g"], p, "ka"), "b", ["_g"], p, "kb")
    r10 = top_k_recall(both, top10, "a", "b").scalar()
    rk = top_k_recall(both, k_eff, "a", "b").scalar()
    return ranked.agg(_correlation("ka", "kb").alias("rho")).select(
        F.when(F.col("rho").isNull() | F.isnan("rho"), 0.0).otherwise(F.col("rho")).alias("knockout_spearman"),
        r10.alias("knockout_top10_recall"), rk.alias("knockout_topk_recall"),
    )


def evaluate_knockouts(predicted: DataFrame, truth: DataFrame, p: int, delta: np.ndarray, t_grid,
                       reduction: float = 0.3, topk: int = 10,
                       impact_true: DataFrame | None = None) -> DataFrame:
    """Knock-out metrics; pass ``impact_true`` to reuse it over many predictions."""
    if impact_true is None:
        impact_true = knockout_impacts(truth, p, delta, t_grid, reduction)
    return knockout_metrics(
        impact_true, knockout_impacts(predicted, p, delta, t_grid, reduction), p, topk)


N_NULL = 5  # fixed value: random graphs per null baseline


def diffusion_task(predicted: DataFrame, truth: DataFrame, p: int, delta_mode: str, t_grid,
                   seed: int = 0, mode: str = "both", reduction: float = 0.3, topk: int = 10,
                   normalised: bool = False) -> DataFrame:
    """Diffusion and knock-out metrics with a random-graph baseline, one row."""
    if mode not in ("diffusion", "knockout", "both"):
        raise ValueError(f"mode must be 'diffusion', 'knockout' or 'both'; got {mode!r}")
    spark = predicted.sparkSession
    delta = make_delta(truth, p, delta_mode, seed)
    row: dict[str, float] = dict.fromkeys(
        ["diffusion_spearman_mean", "diffusion_spearman_min", "diffusion_mae_mean",
         "knockout_spearman", "knockout_top10_recall", "knockout_topk_recall",
         "n_components_pred", "diffusion_spearman_mean_null", "knockout_spearman_null"], NAN)
    nulls = [erdos_renyi_matching(predicted, p, seed + k + 1) for k in range(N_NULL)]
    if mode != "knockout":
        row.update(evaluate_diffusion(predicted, truth, p, delta, t_grid, normalised).first().asDict())
        graphs = truth.select(F.lit("true").alias("graph"), "i", "j")
        for k, g in enumerate(nulls):
            graphs = graphs.unionByName(g.select(F.lit(f"null{k}").alias("graph"), "i", "j"))
        signals = diffuse(graphs, p, delta, t_grid, normalised).persist()
        got = [diffusion_metrics(signals, f"null{k}", "true", p).first()[0] for k in range(N_NULL)]
        signals.unpersist()
        row["diffusion_spearman_mean_null"] = float(np.mean(got))
    if mode != "diffusion":
        true_impacts = knockout_impacts(truth, p, delta, t_grid, reduction).persist()
        row.update(evaluate_knockouts(predicted, truth, p, delta, t_grid, reduction, topk, true_impacts).first().asDict())
        got = [evaluate_knockouts(g, truth, p, delta, t_grid, reduction, topk, true_impacts).first()[0] for g in nulls]
        true_impacts.unpersist()
        row["knockout_spearman_null"] = float(np.mean(got))
    row = {k: float(v) for k, v in row.items()}
    out = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} DOUBLE" for k in row))
    return out.withColumns({
        "diffusion_spearman_norm": normalised_score(F.col("diffusion_spearman_mean"), F.col("diffusion_spearman_mean_null")),
        "knockout_spearman_norm": normalised_score(F.col("knockout_spearman"), F.col("knockout_spearman_null")),
    })
