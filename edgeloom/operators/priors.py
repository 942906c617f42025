"""Prior tables for penalised estimators: ``i, j, prior`` in [0, 1]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import rank_hash
from edgeloom.operators.gram import correlation_edges
from edgeloom.operators.matrix import pair_grid
from edgeloom.operators.sampling import smallest


def corr_prior(samples: DataFrame, p: int | None = None, gamma: float = 2.0) -> DataFrame:
    """``|correlation| ** gamma``."""
    prior = F.pow(F.abs(F.coalesce("corr", F.lit(0.0))), F.lit(float(gamma)))
    return correlation_edges(samples, p).select("i", "j", F.least(F.lit(1.0), prior).alias("prior"))


def noisy_oracle_prior(truth: DataFrame, p: int, noise: float = 0.2, seed: int = 0) -> DataFrame:
    """True edges with ``round(noise * pairs)`` randomly chosen pairs flipped."""
    pairs = p * (p - 1) // 2
    flips = max(0, round(noise * pairs))
    key = rank_hash(F.col("i").cast("bigint") * F.lit(p) + F.col("j"), seed)
    grid = pair_grid(truth.sparkSession, p)
    chosen = smallest(grid, key, flips, ["i", "j"]).withColumn("_f", F.lit(1))
    label = truth.select("i", "j", F.lit(1).alias("_t")).distinct()
    return (
        grid.join(label, ["i", "j"], "left").join(chosen, ["i", "j"], "left")
        .select("i", "j", F.when(F.col("_f") == 1, 1 - F.coalesce("_t", F.lit(0)))
                .otherwise(F.coalesce("_t", F.lit(0))).cast("double").alias("prior"))
    )


def prior_from_names(named_edges: DataFrame, variables: DataFrame, p: int) -> DataFrame:
    """Binary prior over the pair grid from edges ``gene_a, gene_b``."""
    a = variables.select(F.col("var_name").alias("gene_a"), F.col("var_id").alias("_a"))
    b = variables.select(F.col("var_name").alias("gene_b"), F.col("var_id").alias("_b"))
    hits = (
        named_edges.join(a, "gene_a").join(b, "gene_b")
        .select(F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j"))
        .filter("i < j").distinct().withColumn("_h", F.lit(1.0))
    )
    return pair_grid(named_edges.sparkSession, p).join(hits, ["i", "j"], "left").select(
        "i", "j", F.coalesce("_h", F.lit(0.0)).alias("prior"))


def reindex_prior(prior: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The same prior under another variable order, matched by name.

    A name of the new order that the prior lacks is an error.
    """
    missing = new.join(old, "var_name", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"the prior has no entry for {[r['var_name'] for r in missing]}")
    to = old.select("var_name", F.col("var_id").alias("_old")).join(
        new.select("var_name", F.col("var_id").alias("_new")), "var_name")
    ti = to.select(F.col("_old").alias("i"), F.col("_new").alias("_i"))
    tj = to.select(F.col("_old").alias("j"), F.col("_new").alias("_j"))
    return prior.join(ti, "i").join(tj, "j").select(
        F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "prior")
