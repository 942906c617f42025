"""Column transforms: scaling, rank-Gaussianising, rank correlations, selection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.normal import norm_ppf
from edgeloom.operators.gram import Stats, assemble, collect_stats, correlation_edges, stat_blocks
from edgeloom.operators.matrix import MAX_DENSE_P, check_dense, pair_grid, to_long, to_wide, validate, width
from edgeloom.operators.prefix import ROWS_PER_SLICE, average_rank
from edgeloom.session import checkpointed, spread


def column_stats(samples: DataFrame) -> DataFrame:
    """Mean and population standard deviation of every variable."""
    return (
        to_long(samples)
        .groupBy("var_id")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )


def _standardise_wide(samples: DataFrame) -> DataFrame:
    """Means and deviations of single columns: ``2 p`` numbers reach the driver, no ``p x p`` matrix is built."""
    rows = column_stats(samples).orderBy("var_id").toPandas()
    mean, std = rows["mean"].to_numpy(float), rows["std"].to_numpy(float)
    shared = samples.sparkSession.sparkContext.broadcast((mean, np.where(std > 0, std, 1.0)))
    at, wide = samples.columns.index("x"), len(mean)

    def scale(batches):
        centre, spread = shared.value
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
            scaled = ((x - centre) / spread).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(scaled) + 1, wide, dtype=np.int32)), pa.array(scaled))
            yield pa.RecordBatch.from_arrays([lists if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return validate(samples.withColumn("x", F.col("x").cast("array<double>")), wide).mapInArrow(
        scale, samples.withColumn("x", F.col("x").cast("array<double>")).schema)


def standardise(samples: DataFrame, stats: Stats | None = None) -> DataFrame:
    """Zero mean and unit (population) variance; constant columns become zero.

    The per-column constants are ``2 p`` literals, so the transform is a
    projection without a shuffle. Beyond ``MAX_DENSE_P`` columns they are
    measured per column and broadcast instead.
    """
    if stats is None and width(samples) > MAX_DENSE_P:
        return _standardise_wide(samples)
    stats = stats or collect_stats(samples)
    scale = np.sqrt(np.diag(stats.m2) / stats.n)
    scale = np.where(scale > 0, scale, 1.0)
    constants = F.array(
        *[
            F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s"))
            for m, s in zip(stats.mean, scale)
        ]
    )
    return samples.withColumn(
        "x", F.zip_with("x", constants, lambda v, c: (v - c["m"]) / c["s"])
    )


def log2p1(samples: DataFrame) -> DataFrame:
    """``log2(x + 1)``."""
    return samples.withColumn("x", F.transform("x", lambda v: F.log2(v + 1.0)))


def truncation_level(n: int) -> float:
    """Winsorising level ``1 / (4 n^(1/4) sqrt(pi ln n))``."""
    return 1.0 / (4.0 * n**0.25 * math.sqrt(math.pi * math.log(n)))


def npn_long(long: DataFrame, n: int, truncation: float | None = None,
             rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Normal scores of the clipped average ranks, in long form."""
    delta = truncation_level(n) if truncation is None else truncation
    ranked = average_rank(long, "value", ["var_id"], n, rows_per_slice=rows_per_slice)
    u = F.greatest(F.lit(delta), F.least(F.lit(1.0 - delta), F.col("rank") / (n + 1.0)))
    # named first: the quantile expression refers to u many times
    return ranked.withColumn("_u", u).select("row_id", "var_id", norm_ppf(F.col("_u")).alias("value"))


def npn_shrinkage(samples: DataFrame, truncation: float | None = None,
                  n: int | None = None) -> DataFrame:
    n = samples.count() if n is None else n
    return to_wide(npn_long(to_long(samples), n, truncation))


def rank_samples(samples: DataFrame, n: int) -> DataFrame:
    """Samples with every value replaced by its average rank in its variable."""
    ranked = average_rank(to_long(samples), "value", ["var_id"], n)
    return to_wide(ranked.select("row_id", "var_id", F.col("rank").alias("value")))


def spearman_edges(samples: DataFrame, p: int | None = None, n: int | None = None) -> DataFrame:
    """Spearman correlation of every pair."""
    p = p or width(samples)
    n = samples.count() if n is None else n
    return correlation_edges(rank_samples(samples, n), p).withColumnRenamed("corr", "rho")


# --- Kendall ---------------------------------------------------------------


def _pairs_below(values: np.ndarray, groups: np.ndarray) -> tuple[int, int]:
    """``(concordant, discordant)`` over pairs from different groups.

    Rows are ordered by group. Counting is a bottom-up merge over the group
    order: at each level a binary search counts smaller and larger partners.
    """
    order = np.argsort(groups, kind="stable")
    v = values[order]
    _, starts = np.unique(groups[order], return_index=True)
    runs = [np.sort(r) for r in np.split(v, starts[1:])]
    conc = disc = 0
    while len(runs) > 1:
        merged = []
        for a, b in zip(runs[::2], runs[1::2]):
            below = np.searchsorted(a, b, side="left")
            upto = np.searchsorted(a, b, side="right")
            conc += int(below.sum())
            disc += int(len(a) * len(b) - upto.sum())
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            merged.append(both)
        if len(runs) % 2:
            merged.append(runs[-1])
        runs = merged
    return conc, disc


def _tau(score: float, n: int, tx: float, ty: float) -> float:
    total = n * (n - 1) / 2.0
    denom = math.sqrt((total - tx) * (total - ty))
    return score / denom if denom > 0 else float("nan")


def _tie_pairs(v: np.ndarray) -> float:
    _, c = np.unique(v, return_counts=True)
    return float((c.astype(float) * (c - 1) / 2.0).sum())


_BLOCK_VARS = 8


def kendall_edges(samples: DataFrame, p: int | None = None, n: int | None = None,
                  rows_per_task: int = ROWS_PER_SLICE) -> DataFrame:
    """Kendall tau-b of every pair.

    Up to ``rows_per_task`` samples, tasks own a pair of variable blocks and
    count by merging. Longer columns are cut into value bins first (see
    ``_kendall_binned``), so no task holds a whole column.
    """
    p = p or width(samples)
    n = samples.count() if n is None else n
    if n > rows_per_task:
        return _kendall_binned(samples, p, n, rows_per_task)
    blocks = -(-p // _BLOCK_VARS)
    block = F.floor(F.col("var_id") / _BLOCK_VARS).cast("int")
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    routed = to_long(samples).select(
        "row_id", "var_id", "value", block.alias("_own"), F.explode(others).alias("_o")
    ).select(
        F.least("_own", "_o").alias("ba"), F.greatest("_own", "_o").alias("bb"),
        "row_id", "var_id", "value",
    )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.drop_duplicates(["row_id", "var_id"]).pivot(
            index="row_id", columns="var_id", values="value"
        )
        ba, bb = int(pdf["ba"].iloc[0]), int(pdf["bb"].iloc[0])
        cols = {int(c): grid[c].to_numpy() for c in grid.columns}
        ties = {c: _tie_pairs(v) for c, v in cols.items()}
        out = []
        for i in cols:
            for j in cols:
                if i < j and i // _BLOCK_VARS == ba and j // _BLOCK_VARS == bb:
                    conc, disc = _pairs_below(cols[j], cols[i])
                    out.append((i, j, _tau(conc - disc, len(grid), ties[i], ties[j])))
        return pd.DataFrame(out, columns=["i", "j", "tau"])

    return spread(routed, "ba", "bb").groupBy("ba", "bb").applyInPandas(count, "i INT, j INT, tau DOUBLE")


def _kendall_binned(samples: DataFrame, p: int, n: int, rows_per_task: int) -> DataFrame:
    """Kendall tau-b for columns too long for one task.

    One variable of a pair is cut into value bins; a value frequent enough to
    fill a bin gets its own. The bins are the leaves of a tree of fixed fan-out.
    Two rows part at one node of it, in different children, where they are
    compared: a level takes the rows of each node in order of the other variable
    and counts what came before by child (``_parted``). Rows of one bin are
    compared there, and in a single-value bin they are all tied. So a task holds
    a slice of a level or a bin, whatever n is.
    """
    bins = max(2, math.ceil(4 * n / rows_per_task))
    long = to_long(samples)
    counts = long.groupBy("var_id", "value").agg(F.count(F.lit(1)).alias("c"))
    ties = counts.groupBy("var_id").agg(
        F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2.0).alias("t")
    )
    hot = (
        counts.filter(F.col("c") > n / bins)
        .groupBy("var_id").agg(F.sort_array(F.collect_list("value")).alias("hot"))
    )  # fewer than `bins` values per variable
    cuts = long.groupBy("var_id").agg(
        F.percentile_approx("value", [k / bins for k in range(1, bins)], 10 * bins).alias("cuts")
    )
    plan = (
        cuts.join(hot, "var_id", "left")
        .select("var_id", "cuts", F.coalesce("hot", F.array().cast("array<double>")).alias("hot"))
        .collect()
    )  # p rows of fewer than 2 * bins values
    edges = {int(r["var_id"]): sorted(set(r["cuts"]) | set(r["hot"])) for r in plan}
    hots = {int(r["var_id"]): set(r["hot"]) for r in plan}
    spark = samples.sparkSession
    edges_b = spark.sparkContext.broadcast((edges, hots))

    def assign(batches):
        # bin 2k+1: exactly the k-th edge value; bin 2k: values between edges
        table, _ = edges_b.value
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            out = np.empty(x.shape, dtype=np.int32)
            for v in range(p):
                e = np.asarray(table[v])
                left = np.searchsorted(e, x[:, v], side="left")
                hit = (left < len(e)) & (e[np.minimum(left, len(e) - 1)] == x[:, v])
                out[:, v] = 2 * left + hit
            yield pa.RecordBatch.from_pydict(
                {
                    "x": batch.column("x"),
                    "b": pa.ListArray.from_arrays(
                        np.arange(0, out.size + 1, p, dtype=np.int32), pa.array(out.ravel())
                    ),
                }
            )

    tagged = samples.select("x").mapInArrow(assign, "x ARRAY<DOUBLE>, b ARRAY<INT>")
    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(p) for j in range(i + 1, p)
    ]) if p <= 8 else F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(p - 2)),
        lambda i: F.transform(F.sequence(i + 1, F.lit(p - 1)),
                              lambda j: F.struct(i.alias("i"), j.alias("j"))),
    ))
    flat = tagged.select("x", "b", F.explode(pairs).alias("e")).select(
        "e.i", "e.j",
        F.element_at("x", F.col("e.i") + 1).alias("x"), F.element_at("x", F.col("e.j") + 1).alias("y"),
        F.element_at("b", F.col("e.i") + 1).alias("bx"), F.element_at("b", F.col("e.j") + 1).alias("by"),
    )
    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        conc, disc = _pairs_below(pdf["y"].to_numpy(), pdf["x"].to_numpy())
        return pd.DataFrame({"i": [int(pdf["i"].iloc[0])], "j": [int(pdf["j"].iloc[0])], "score": [float(conc - disc)]})

    schema = "i INT, j INT, score DOUBLE"
    leaves, depth = 2 * max(len(e) for e in edges.values()) + 1, 1
    while _FAN_OUT ** depth < leaves:
        depth += 1
    parts = [flat.filter(F.col("bx") % 2 == 0).groupBy("i", "j", "bx").applyInPandas(within, schema)]  # odd bins hold one value
    for level in range(depth):
        parts.append(_parted(flat, _FAN_OUT ** (depth - level - 1), n * p * (p - 1) // 2, rows_per_task))
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    scores = scores.groupBy("i", "j").agg(F.sum("score").alias("score"))
    total = F.lit(n * (n - 1) / 2.0)
    ti = ties.select(F.col("var_id").alias("i"), F.col("t").alias("ti"))
    tj = ties.select(F.col("var_id").alias("j"), F.col("t").alias("tj"))
    return scores.join(ti, "i").join(tj, "j").select(
        "i", "j",
        (F.col("score") / F.sqrt((total - F.col("ti")) * (total - F.col("tj")))).alias("tau"),
    )


_FAN_OUT = 32  # children of a node


def _parted(flat: DataFrame, width: int, rows: int, rows_per_task: int) -> DataFrame:
    """``i, j, score``: concordant less discordant pairs of rows that part at one level of the tree over ``bx``.

    ``width`` is the number of bins below a child. Rows that agree in node, child
    and y travel as one with a count. They are dealt into slices by (node, y);
    each slice knows how many rows of each child came before it.
    """
    child = F.floor(F.col("bx") / width).cast("int")
    counts = flat.select("i", "j", F.floor(child / _FAN_OUT).cast("int").alias("node"), (child % _FAN_OUT).alias("child"), "y").groupBy(
        "i", "j", "node", "child", "y").agg(F.count(F.lit(1)).alias("c"))
    where = ["i", "j", "node"]
    sliced = checkpointed(counts.repartitionByRange(max(1, -(-rows // rows_per_task)), *where, "y").withColumn(
        "part", F.spark_partition_id()))
    totals = sliced.groupBy(*where, "child", "part").agg(F.sum("c").alias("c"))
    # a child may have rows before a slice and none in it, so every slice of a node has a row for each child
    slices = totals.select(*where, "part").distinct().withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(_FAN_OUT - 1))))
    earlier = Window.partitionBy(*where, "child").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.join(totals, [*where, "child", "part"], "left").select(
        *where, "part", "child", F.sum(F.coalesce("c", F.lit(0))).over(earlier).alias("c")).filter("c > 0")

    def count(here: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        if here.empty:
            return pd.DataFrame({"i": [], "j": [], "score": []})
        here = here.sort_values("y")
        y, own, c = here["y"].to_numpy(), here["child"].to_numpy(int), here["c"].to_numpy(float)
        seen = np.zeros(_FAN_OUT)
        np.add.at(seen, past["child"].to_numpy(int), past["c"].to_numpy(float))
        score, starts = 0.0, np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
        value = np.cumsum(np.r_[True, y[1:] != y[:-1]]) - 1
        for lo in range(0, len(starts), 4096):  # some values at once
            rows_ = slice(starts[lo], starts[lo + 4096] if lo + 4096 < len(starts) else len(y))
            table = np.zeros((min(4096, len(starts) - lo), _FAN_OUT))
            np.add.at(table, (value[rows_] - lo, own[rows_]), c[rows_])
            below = np.cumsum(table, axis=0) - table + seen  # by child, of smaller y
            upto = np.cumsum(below, axis=1)
            less, more = upto - below, upto[:, -1:] - upto
            score += float((table * (less - more)).sum())
            seen = seen + table.sum(axis=0)
        return pd.DataFrame({"i": [int(here["i"].iloc[0])], "j": [int(here["j"].iloc[0])], "score": [score]})

    key = [*where, "part"]
    past = carried.select(*[F.col(k).alias(f"{k}_") for k in key], F.col("child"), "c")
    return sliced.groupBy(*key).cogroup(past.groupBy(*[f"{k}_" for k in key])).applyInPandas(count, "i INT, j INT, score DOUBLE")


# --- SKEPTIC ---------------------------------------------------------------


def latent_from_tau(tau: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(tau * (math.pi / 2.0))))


def latent_from_rho(rho: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2.0 * F.sin(rho * (math.pi / 6.0))))


def skeptic_correlation(samples: DataFrame, corr_type: str = "kendall",
                        n: int | None = None) -> DataFrame:
    """Latent Gaussian correlation of every pair, before any regularisation."""
    if corr_type == "kendall":
        return kendall_edges(samples, n=n).select("i", "j", latent_from_tau(F.col("tau")).alias("c"))
    if corr_type == "spearman":
        return spearman_edges(samples, n=n).select("i", "j", latent_from_rho(F.col("rho")).alias("c"))
    raise ValueError(f"corr_type must be 'kendall' or 'spearman'; got {corr_type!r}")


def dense_from_edges(edges: DataFrame, value: str, p: int, diagonal: float) -> np.ndarray:
    """Symmetric matrix on the driver (size checked)."""
    check_dense(p, "a matrix collected from an edge table")
    pdf = edges.select("i", "j", value).toPandas()
    m = np.full((p, p), 0.0)
    i, j = pdf["i"].to_numpy(int), pdf["j"].to_numpy(int)
    m[i, j] = m[j, i] = pdf[value].to_numpy(float)
    np.fill_diagonal(m, diagonal)
    return m


def npn_skeptic(samples: DataFrame, corr_type: str = "kendall") -> DataFrame:
    """Scaled samples multiplied by the Cholesky factor of the latent correlation.

    Only the p x p factor is computed on the driver; the samples are mapped
    where they lie.
    """
    stats = collect_stats(samples)
    p, n = stats.p, stats.n
    c = dense_from_edges(skeptic_correlation(samples, corr_type, n), "c", p, 1.0)
    vals, vecs = np.linalg.eigh(c)
    c = (vecs * np.maximum(vals, 1e-6)) @ vecs.T
    factor = np.linalg.cholesky((c + c.T) / 2.0)
    std = np.sqrt(np.diag(stats.m2) / (n - 1)) + 1e-12
    shared = samples.sparkSession.sparkContext.broadcast((stats.mean, std, factor))

    def rotate(batches):
        mean, scale, low = shared.value
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y = ((x - mean) / scale) @ low.T
            yield pa.RecordBatch.from_pydict(
                {
                    "row_id": batch.column("row_id"),
                    "x": pa.ListArray.from_arrays(
                        np.arange(0, y.size + 1, p, dtype=np.int32), pa.array(y.ravel())
                    ),
                }
            )

    return samples.select("row_id", "x").mapInArrow(rotate, "row_id BIGINT, x ARRAY<DOUBLE>")


def npn_transform(samples: DataFrame, method: str = "shrinkage", truncation: float | None = None,
                  corr_type: str = "kendall") -> DataFrame:
    if method == "shrinkage":
        return npn_shrinkage(samples, truncation)
    if method == "skeptic":
        return npn_skeptic(samples, corr_type)
    raise ValueError(f"method must be 'shrinkage' or 'skeptic'; got {method!r}")


# --- variable selection ----------------------------------------------------


def top_variance(samples: DataFrame, k: int) -> DataFrame:
    """The ``k`` variables of largest sample variance (ties: lower id first)."""
    return (
        to_long(samples)
        .groupBy("var_id")
        .agg(F.var_samp("value").alias("variance"))
        .orderBy(F.desc("variance"), F.asc("var_id"))
        .limit(k)
    )


def select_variables(samples: DataFrame, var_ids: list[int]) -> DataFrame:
    """Keep the given variables, in the given order (a projection)."""
    return samples.withColumn(
        "x", F.array(*[F.element_at("x", int(v) + 1) for v in var_ids])
    )


def match_names(wanted: DataFrame, variables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(found, missing)`` for requested names ``pos, var_name``; request order is kept."""
    found = wanted.join(variables, "var_name").select("pos", "var_id", "var_name")
    return found, wanted.join(variables, "var_name", "left_anti")


def partial_correlations(samples: DataFrame, p: int | None = None) -> DataFrame:
    """Partial correlation of every pair.

    With more samples than variables, from the pseudo-inverse of the
    correlation matrix, taken in one task (size checked); otherwise from the
    blocks of a cross-validated graphical lasso, each where it was solved.
    """
    p = p or width(samples)
    check_dense(p, "the pseudo-inverse of a correlation matrix")
    n = samples.count()
    if n > p:
        def invert(pdf: pd.DataFrame) -> pd.DataFrame:
            m = _partial(np.linalg.pinv(assemble(pdf).correlation()))
            i, j = np.triu_indices(p, k=1)
            return pd.DataFrame({"i": i, "j": j, "pcorr": m[i, j]})

        return stat_blocks(samples, p).groupBy("key").applyInPandas(invert, "i INT, j INT, pcorr DOUBLE")
    from edgeloom.operators.estimators import SklearnGLasso

    rows = column_stats(samples).orderBy("var_id").collect()  # 2 p numbers
    unbiased = math.sqrt(n / (n - 1))
    constants = F.array(*[F.struct(F.lit(r["mean"]).alias("m"), F.lit(r["std"] * unbiased or 1.0).alias("s")) for r in rows])
    scaled = samples.withColumn("x", F.zip_with("x", constants, lambda v, c: (v - c["m"]) / c["s"]))
    est = SklearnGLasso(cv=5, max_iter=500).fit(scaled)

    def entries(batches):
        for pdf in batches:
            for idx, theta in zip(pdf["idx"], pdf["theta"]):
                idx = np.asarray(idx)
                m = _partial(np.asarray(theta).reshape(len(idx), len(idx)))
                a, b = np.nonzero(np.triu(m, 1))
                yield pd.DataFrame({"i": idx[a], "j": idx[b], "pcorr": m[a, b]})

    found = est.blocks_.select("idx", "theta").mapInPandas(entries, "i INT, j INT, pcorr DOUBLE")
    return pair_grid(samples.sparkSession, p).join(found, ["i", "j"], "left").select(
        "i", "j", F.coalesce("pcorr", F.lit(0.0)).alias("pcorr"))


def _partial(prec: np.ndarray) -> np.ndarray:
    """``-m_ij / sqrt(m_ii m_jj)``, zero where that is undefined."""
    d = np.diag(prec)
    denom = np.sqrt(np.maximum(np.outer(d, d), 0.0))
    return np.where(denom > 0, -prec / np.where(denom > 0, denom, 1.0), 0.0)
