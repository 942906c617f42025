"""Node regressions for tables too wide to broadcast their Gram matrix.

A Lasso solution is sparse, so each node needs only the Gram rows of its active
set. Working sets start from the correlations above the penalty that matter
most and grow by the variables that violate the optimality conditions; the
result is the exact optimum, reached when nothing is violated. A working set
only grows, so no round repeats an earlier one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.gram import gram_rows
from edgeloom.operators.kernels import lasso_nodes
from edgeloom.session import checkpointed, spread

GROW = 64  # candidates added to a working set per round
_STATE = "i INT, gii DOUBLE, tau2 DOUBLE, idx ARRAY<INT>, val ARRAY<DOUBLE>, work ARRAY<INT>, add ARRAY<INT>"


def scaled_rows(samples: DataFrame, p: int, standardise: bool) -> tuple[DataFrame, int]:
    """Gram rows ``i, x`` (correlations, or raw second moments) kept distributed."""
    rows = checkpointed(gram_rows(samples, p).drop("key"))
    n = int(rows.select("n").first()["n"])
    if not standardise:
        own = F.element_at("mean", F.col("i") + 1)
        g = F.zip_with("x", "mean", lambda c, m: c / float(n) + m * own)
        return rows.select("i", g.alias("x")), n
    diag = [
        float(r["d"]) for r in rows.select("i", F.element_at("x", F.col("i") + 1).alias("d"))
        .orderBy("i").toLocalIterator()
    ]  # p doubles
    inv = np.array([1.0 / np.sqrt(d) if d > 0 else 0.0 for d in diag])
    shared = samples.sparkSession.sparkContext.broadcast(inv)

    def scale(batches):
        s = shared.value
        for pdf in batches:
            i = pdf["i"].to_numpy(int)
            pdf["x"] = [np.asarray(x) * s * s[k] for x, k in zip(pdf["x"], i)]
            yield pdf

    return rows.select("i", "x").mapInPandas(scale, "i INT, x ARRAY<DOUBLE>"), n


def _solver(lam: float, max_iter: int, tol: float):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        """One node: rows are its own Gram row and those of its working set."""
        node = int(pdf["node"].iloc[0])
        own = pdf[pdf["k"] == node].iloc[0]
        g_own = np.asarray(own["x"])
        work = pdf[pdf["k"] != node].sort_values("k")
        idx = work["k"].to_numpy(int)
        p = len(g_own)
        beta = np.zeros(0)
        grad = g_own.copy()
        if idx.size:
            rows = np.stack(work["x"].to_numpy())
            order = np.concatenate([[node], idx])
            sub = np.vstack([g_own[order], np.column_stack([g_own[idx], rows[:, idx]])])
            beta = lasso_nodes(sub, lam, np.array([0]), max_iter, tol)[0][1:]
            grad = g_own - beta @ rows
        over = np.abs(grad) - lam
        over[idx] = -1.0
        over[node] = -1.0
        bad = np.flatnonzero(over > 1e-9)
        add = bad[np.argsort(-over[bad])][:GROW]
        fit = float(beta @ g_own[idx]) if idx.size else 0.0
        quad = float(beta @ rows[:, idx] @ beta) if idx.size else 0.0
        keep = np.flatnonzero(beta)
        return pd.DataFrame({
            "i": [node], "gii": [g_own[node]], "tau2": [max(g_own[node] - 2 * fit + quad, 0.0)],
            "idx": [idx[keep].astype(np.int32)], "val": [beta[keep]],
            "work": [idx.astype(np.int32)], "add": [add.astype(np.int32)],
        })

    return solve


def fit_nodes_by_active_set(samples: DataFrame, p: int, penalty_of, standardise: bool,
                            max_iter: int, tol: float) -> tuple[DataFrame, int]:
    """``(i, tau2, nnz, idx, val), n`` without a p x p matrix in any one place.

    A task holds ``|working set| x p`` numbers for one node.
    """
    scaled, n = scaled_rows(samples, p, standardise)
    rows = checkpointed(scaled)
    lam = penalty_of(n)
    entries = rows.select("i", F.posexplode("x").alias("k", "g")).filter(
        (F.abs("g") > lam) & (F.col("k") != F.col("i")))
    top = Window.partitionBy("i").orderBy(F.desc(F.abs("g")), "k")
    want = entries.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= GROW).select(
        F.col("i").alias("node"), "k")
    own = rows.select(F.col("i").alias("node"), F.col("i").alias("k"))
    todo = own
    done = None
    while True:
        asked = checkpointed(want.unionByName(todo).distinct())
        fitted = checkpointed(
            spread(asked.join(rows.select(F.col("i").alias("k"), "x"), "k"), "node")
            .groupBy("node").applyInPandas(_solver(lam, max_iter, tol), _STATE))
        ready = fitted.filter(F.size("add") == 0)
        done = ready if done is None else done.unionByName(ready)
        open_nodes = fitted.filter(F.size("add") > 0)
        if open_nodes.isEmpty():
            break
        todo = own.join(open_nodes.select(F.col("i").alias("node")), "node", "left_semi")
        want = open_nodes.select(
            F.col("i").alias("node"), F.explode(F.array_union("work", "add")).alias("k"))
    return done.select("i", "tau2", F.size("idx").alias("nnz"), "idx", "val"), n
