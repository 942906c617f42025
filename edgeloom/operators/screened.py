"""Graphical lasso by blocks of the screened covariance, solved in tasks.

Where no path of covariances above the penalty joins two variables, their
entry of the solution is exactly zero (Mazumder and Hastie 2012). So the
problem falls into the connected components of ``|s_ij| > lam * mask_ij``, and
each of them is a task of its own. Covariance rows stay distributed; a task
holds one block, and the driver holds sums.

A problem is a row of ``key INT, lam DOUBLE``; its covariance rows are
``key, i, s ARRAY<DOUBLE>[, t ARRAY<DOUBLE>]``, ``t`` being a second matrix that
the solution is scored against.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.gram import _combine, _chunk_rows, stat_blocks
from edgeloom.operators.graph import star_roots
from edgeloom.operators.kernels import admm_glasso, components_of
from edgeloom.operators.matrix import MAX_DENSE_P, check_dense
from edgeloom.operators.sampling import Grouped
from edgeloom.session import checkpointed, spread

_ROWS = "key INT, i INT, n BIGINT, s ARRAY<DOUBLE>, t ARRAY<DOUBLE>"
_BLOCKS = "key INT, lam DOUBLE, block INT, idx ARRAY<INT>, s ARRAY<DOUBLE>, t ARRAY<DOUBLE>"
SOLVED = "key INT, lam DOUBLE, block INT, ok BOOLEAN, logdet DOUBLE, fit DOUBLE, idx ARRAY<INT>, theta ARRAY<DOUBLE>"


def covariance_rows(samples: DataFrame | Grouped, p: int, ddof: int = 0, keyed: bool = False) -> DataFrame:
    """``key, i, n, s, t`` (t null): row ``i`` of each group's covariance."""
    step = _chunk_rows(p)

    def cut(batches):
        for pdf in batches:
            for key, chunk, n, m2 in zip(pdf["key"], pdf["chunk"], pdf["n"], pdf["m2"]):
                rows = np.asarray(m2).reshape(-1, p) / (n - ddof)
                yield pd.DataFrame({"key": key, "i": chunk * step + np.arange(len(rows)), "n": n, "s": list(rows),
                                    "t": [None] * len(rows)})

    return stat_blocks(samples, p, keyed).mapInPandas(cut, _ROWS)


def fold_rows(folds: Grouped, p: int, k: int) -> DataFrame:
    """``key, i, n, s, t``: covariance of all folds but ``key`` in ``s`` and of fold ``key`` in ``t``; key -1 has all in ``s``.

    Blocks of a few rows of each fold meet, never whole matrices.
    """
    step = _chunk_rows(p)
    targets = F.explode(F.sequence(F.lit(-1), F.lit(k - 1)))
    routed = stat_blocks(folds, p, keyed=True).select(targets.alias("target"), "key", "chunk", "src", "n", "mean", "m2")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        target, chunk = int(pdf["target"].iloc[0]), int(pdf["chunk"].iloc[0])
        train = _combine(pdf[pdf["key"] != target])
        rows = np.asarray(train["m2"].iloc[0]).reshape(-1, p) / train["n"].iloc[0]
        held = pdf[pdf["key"] == target]
        test = [None] * len(rows) if held.empty else list(np.asarray(held["m2"].iloc[0]).reshape(-1, p) / held["n"].iloc[0])
        return pd.DataFrame({"key": target, "i": chunk * step + np.arange(len(rows)), "n": train["n"].iloc[0],
                             "s": list(rows), "t": test})

    return spread(routed, "target", "chunk").groupBy("target", "chunk").applyInPandas(split, _ROWS)


def largest_off_diagonal(rows: DataFrame) -> float:
    """The largest ``|s_ij|`` with ``i <> j`` (one number)."""
    other = F.filter("s", lambda v, k: k != F.col("i"))
    return float(rows.agg(F.max(F.array_max(F.transform(other, F.abs)))).first()[0] or 0.0)


def _cut_dense(p: int, mask):
    """A task that takes one problem's rows apart into blocks; for matrices that one task may hold."""
    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        key, lam = int(pdf["key"].iloc[0]), float(pdf["lam"].iloc[0])
        s = np.stack(pdf["s"].to_numpy())
        s = (s + s.T) / 2.0
        t = None if pdf["t"].iloc[0] is None else np.stack(pdf["t"].to_numpy())
        linked = np.abs(s) > lam * (1.0 if mask is None else mask.value)
        np.fill_diagonal(linked, False)
        label = components_of(linked)
        out = []
        for b in np.unique(label):
            idx = np.flatnonzero(label == b)
            here = np.ix_(idx, idx)
            out.append((key, lam, int(b), idx, s[here].ravel(), None if t is None else t[here].ravel()))
        return pd.DataFrame(out, columns=["key", "lam", "block", "idx", "s", "t"])

    return cut


def _cut_by_joins(each: DataFrame, p: int, mask) -> DataFrame:
    """The same blocks where no task may hold a matrix: components by stars, entries routed by their block."""
    def entries(batches):
        weight = None if mask is None else mask.value
        for pdf in batches:
            for key, lam, i, s in zip(pdf["key"], pdf["lam"], pdf["i"], pdf["s"]):
                x = np.asarray(s)
                cut = lam * (1.0 if weight is None else weight[i])
                j = np.flatnonzero(np.abs(x) > cut)
                j = j[j > i]
                yield pd.DataFrame({"key": key, "lam": lam, "i": i, "j": j})

    spec = "key INT, lam DOUBLE, i INT, j INT"
    # a problem's nodes have numbers of their own, so that all problems share the rounds
    by_problem = Window.orderBy("key", "lam")  # one row a problem
    numbered = checkpointed(each.filter("i = 0").select("key", "lam").select(
        "key", "lam", (F.row_number().over(by_problem) - 1).alias("q")))
    links = each.mapInPandas(entries, spec).join(F.broadcast(numbered), ["key", "lam"])
    node = lambda c: F.col("q").cast("bigint") * p + F.col(c)
    roots = star_roots(links.select(node("i").alias("i"), node("j").alias("j")))
    label = roots.select(
        F.floor(F.col("u") / p).cast("int").alias("q"), (F.col("u") % p).cast("int").alias("i"),
        (F.col("c") % p).cast("int").alias("block"))
    known = each.join(F.broadcast(numbered), ["key", "lam"])
    member = checkpointed(known.select("key", "lam", "q", "i").join(label, ["q", "i"], "left").select(
        "key", "lam", "q", "i", F.coalesce("block", "i").alias("block")))
    sets = member.groupBy("q", "block").agg(F.sort_array(F.collect_list("i")).alias("idx"))  # a block, size checked below
    pick = lambda c: F.when(F.col(c).isNotNull(), F.transform("idx", lambda j: F.element_at(c, j + 1)))
    wanted = (
        known.select("q", "i", "s", "t").join(member.select("key", "lam", "q", "i", "block"), ["q", "i"])
        .join(sets, ["q", "block"])
        .select("key", "lam", "block", "i", "idx", pick("s").alias("s"), pick("t").alias("t"))
    )

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        check_dense(len(pdf), "a connected block of the graphical lasso (a larger penalty splits it)")
        s = np.stack(pdf["s"].to_numpy())
        t = None if pdf["t"].iloc[0] is None else np.stack(pdf["t"].to_numpy()).ravel()
        return pd.DataFrame([(int(pdf["key"].iloc[0]), float(pdf["lam"].iloc[0]), int(pdf["block"].iloc[0]),
                              pdf["idx"].iloc[0], ((s + s.T) / 2.0).ravel(), t)],
                            columns=["key", "lam", "block", "idx", "s", "t"])

    return wanted.groupBy("key", "lam", "block").applyInPandas(assemble, _BLOCKS)


def _solve(p: int, mask, max_iter: int, tol: float):
    def run(batches):
        for pdf in batches:
            out = []
            for key, lam, block, idx, s, t in zip(pdf["key"], pdf["lam"], pdf["block"], pdf["idx"], pdf["s"], pdf["t"]):
                idx = np.asarray(idx)
                m = len(idx)
                s = np.asarray(s).reshape(m, m)
                if m == 1:
                    theta, ok = np.array([[1.0 / s[0, 0] if s[0, 0] > 0 else 0.0]]), True
                else:
                    weight = None if mask is None else mask.value[np.ix_(idx, idx)]
                    theta, _, ok = admm_glasso(s, float(lam), weight, None, max_iter, tol, tol)
                    theta = (theta + theta.T) / 2.0
                sign, logdet = np.linalg.slogdet(theta)
                fit = np.nan if t is None else float((np.asarray(t).reshape(m, m) * theta).sum())
                out.append((key, lam, block, bool(ok), float(logdet) if sign > 0 else -np.inf, fit, idx, theta.ravel()))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SOLVED.split(", ")])

    return run


def solve_blocks(rows: DataFrame, problems: DataFrame | float, p: int, mask: np.ndarray | None = None,
                 max_iter: int = 2000, tol: float = 1e-8, dense_limit: int = MAX_DENSE_P) -> DataFrame:
    """Every block of every problem (``key, lam``; or one penalty for all keys), solved.

    Columns: ``key, lam, block, ok, logdet, fit, idx, theta``.

    ``theta`` is the block's precision over the variables ``idx``; ``fit`` the
    sum of ``t * theta``. Up to ``dense_limit`` variables one task takes a
    matrix apart; wider ones are taken apart by joins. Blocks are spread over
    the cluster either way.
    """
    spark = rows.sparkSession
    shared = None
    if mask is not None:
        check_dense(mask.shape[0], "a broadcast penalty mask")
        shared = spark.sparkContext.broadcast(mask)
    if isinstance(problems, DataFrame):
        each = rows.join(F.broadcast(problems), "key")  # one row a problem
    else:
        each = rows.withColumn("lam", F.lit(float(problems)))
    if p <= dense_limit:
        blocks = each.groupBy("key", "lam").applyInPandas(_cut_dense(p, shared), _BLOCKS)
    else:
        blocks = _cut_by_joins(checkpointed(each), p, shared)
    return spread(blocks, "key", "lam", "block").mapInPandas(_solve(p, shared, max_iter, tol), SOLVED)


def solved_edges(solved: DataFrame) -> DataFrame:
    """``key, i, j, omega``: non-zero entries ``i < j`` of the solutions."""
    def flat(batches):
        for pdf in batches:
            for key, idx, theta in zip(pdf["key"], pdf["idx"], pdf["theta"]):
                idx = np.asarray(idx)
                m = np.asarray(theta).reshape(len(idx), len(idx))
                a, b = np.nonzero(np.triu(m, 1))
                yield pd.DataFrame({"key": key, "i": idx[a], "j": idx[b], "omega": m[a, b]})

    return solved.select("key", "idx", "theta").mapInPandas(flat, "key INT, i INT, j INT, omega DOUBLE")


def dense_precision(solved: DataFrame, p: int) -> np.ndarray:
    """One solution as a matrix on the driver (size checked)."""
    check_dense(p, "a precision matrix on the driver")
    out = np.zeros((p, p))
    for r in solved.select("idx", "theta").toLocalIterator():
        idx = np.asarray(r["idx"])
        out[np.ix_(idx, idx)] = np.asarray(r["theta"]).reshape(len(idx), len(idx))
    return out
