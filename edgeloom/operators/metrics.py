"""Edge-recovery metrics over a table of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.matrix import pair_grid
from edgeloom.operators.prefix import ROWS_PER_SLICE, running

NAN = float("nan")


def _true_pairs(truth: DataFrame) -> DataFrame:
    """``i, j, _t``: one row a pair with ``i < j``, whatever order its ends are stored in and however often."""
    label = F.col("label").cast("int") if "label" in truth.columns else F.lit(1)
    ends = truth.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), label.alias("_t"))
    return ends.filter(F.col("i") < F.col("j")).groupBy("i", "j").agg(F.max("_t").alias("_t"))


def scored_pairs(predicted: DataFrame, truth: DataFrame, p: int,
                 scores: DataFrame | None = None) -> DataFrame:
    """``i, j, pred, truth, score`` for every pair.

    ``predicted`` has ``is_edge``, ``truth`` lists the true pairs (optional
    ``label``), ``scores`` has ``score`` (higher means more likely an edge);
    without scores the prediction itself is the score.
    """
    spark = predicted.sparkSession
    pred = predicted.select("i", "j", F.col("is_edge").cast("int").alias("_p"))
    out = pair_grid(spark, p).join(pred, ["i", "j"], "left").join(_true_pairs(truth), ["i", "j"], "left")
    if scores is not None:
        out = out.join(scores.select("i", "j", F.col("score").alias("_s")), ["i", "j"], "left")
    else:
        out = out.withColumn("_s", F.col("_p").cast("double"))
    return out.select(
        "i", "j",
        F.coalesce("_p", F.lit(0)).alias("pred"),
        F.coalesce("_t", F.lit(0)).alias("truth"),
        F.coalesce("_s", F.lit(0.0)).alias("score"),
    )


def assess(assessed: DataFrame, truth: DataFrame, p: int) -> DataFrame:
    """Metrics from one table that already holds every pair with ``is_edge`` and ``score``."""
    pairs = assessed.join(_true_pairs(truth), ["i", "j"], "left").select(
        "i", "j", F.col("is_edge").cast("int").alias("pred"),
        F.coalesce("_t", F.lit(0)).alias("truth"), "score")
    return evaluate(pairs, rows=p * (p - 1) // 2)


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """TP, FP, TN, FN, precision, recall, F1, MCC and SHD per key."""
    hit = lambda a, b: F.sum(
        F.when((F.col("pred") == a) & (F.col("truth") == b), 1).otherwise(0)
    ).cast("bigint")
    counts = pairs.groupBy(*(keys or [])).agg(
        hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fn")
    )
    return _scores_from_counts(counts)


def _scores_from_counts(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    denom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1": _ratio(2.0 * precision * recall, precision + recall),
            "mcc": _ratio(tp * tn - fp * fn, denom),
            "shd": F.col("fp") + F.col("fn"),
        }
    )


def evaluate(pairs: DataFrame, keys: list[str] | None = None, rows: int | None = None,
             rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """All twelve metrics, one row per key.

    Pairs are first collapsed to one row per score, so ties cost nothing
    later and the ranking passes see distinct scores only.
    """
    keys = keys or []
    t = F.col("truth").cast("bigint")
    q = F.col("pred").cast("bigint")
    by_score = pairs.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum(t).alias("pos"),
        F.sum(t * q).alias("tp"), F.sum(q).alias("called"),
    )
    cum = running(
        by_score, "score", {"cn": ("n", "sum"), "cpos": ("pos", "sum")}, keys, rows,
        descending=True, rows_per_slice=rows_per_slice,
    )
    totals = by_score.groupBy(*keys).agg(F.sum("pos").alias("P"))
    joined = cum.join(totals, keys) if keys else cum.withColumn(
        "P", by_score.agg(F.sum("pos")).scalar()
    )
    neg = F.col("n") - F.col("pos")
    agg = joined.groupBy(*keys).agg(
        F.sum("tp").alias("tp"),
        (F.sum("called") - F.sum("tp")).alias("fp"),
        (F.sum("n") - F.sum("pos") - F.sum("called") + F.sum("tp")).alias("tn"),
        (F.sum("pos") - F.sum("tp")).alias("fn"),
        F.sum("pos").cast("double").alias("_P"),
        F.sum(neg).cast("double").alias("_N"),
        F.sum(F.col("pos") * F.col("cpos") / F.col("cn")).alias("_ap"),
        F.sum(neg * (F.col("cpos") - F.col("pos") / F.lit(2.0))).alias("_u"),
        F.max(2.0 * F.col("cpos") / (F.col("cn") + F.col("P"))).alias("_f1"),
    )
    out = _scores_from_counts(agg)
    return out.select(
        *keys,
        F.when(F.col("_P") > 0, F.col("_ap") / F.nullif(F.col("_P"), F.lit(0.0))).otherwise(NAN).alias("aupr"),
        F.when((F.col("_P") > 0) & (F.col("_N") > 0),
               F.col("_u") / F.nullif(F.col("_P") * F.col("_N"), F.lit(0.0))).otherwise(NAN).alias("auroc"),
        "f1",
        F.when(F.col("_P") > 0, F.col("_f1")).otherwise(NAN).alias("f1_opt"),
        "mcc", "shd", "precision", "recall", "tp", "fp", "tn", "fn",
    )


def evaluate_predictions(predicted: DataFrame, truth: DataFrame, p: int,
                         scores: DataFrame | None = None) -> DataFrame:
    """One row of metrics for one predicted network."""
    return evaluate(scored_pairs(predicted, truth, p, scores), rows=p * (p - 1) // 2)


def top_k_recall(scores: DataFrame, k: int, a: str, b: str, node: str = "node") -> DataFrame:
    """Share of the ``k`` best nodes by ``a`` that are also among the best by ``b``.

    Ties go to the higher node id on both sides.
    """
    best = lambda c: (
        scores.select(node, c).orderBy(F.desc(c), F.desc(node)).limit(k).select(node)
    )
    shared = best(a).join(best(b), node, "left_semi")
    return shared.agg((F.count(F.lit(1)) / F.lit(float(k))).alias("recall"))


def coverage(gold: DataFrame, pcorr: DataFrame, variables: DataFrame,
             threshold: float = 0.1) -> DataFrame:
    """How many gold edges have both ends in the table and a visible partial correlation."""
    pairs = gold_pairs(gold, variables)
    total = gold.filter(F.col("label") == 1).agg(F.count(F.lit(1))).scalar()
    found = pairs.join(pcorr, ["i", "j"], "left").select(
        F.abs(F.coalesce("pcorr", F.lit(0.0))).alias("a")
    )
    middle = exact_percentiles(found.withColumn("_k", F.lit(0)), ["_k"], "a", {"m": 0.5}).agg(F.max("m")).scalar()
    return found.agg(
        F.count(F.lit(1)).alias("in_gene_set"),
        F.sum((F.col("a") >= threshold).cast("bigint")).alias("detectable"),
        F.avg("a").alias("mean_abs"),
    ).withColumn("median_abs", middle).select(
        total.alias("total_gold"), "in_gene_set",
        F.coalesce("detectable", F.lit(0)).cast("bigint").alias("detectable"),
        F.when(F.col("in_gene_set") > 0,
               F.col("detectable") / F.nullif(F.col("in_gene_set"), F.lit(0))).otherwise(NAN).alias("coverage"),
        F.coalesce("median_abs", F.lit(NAN)).alias("median_abs"),
        F.coalesce("mean_abs", F.lit(NAN)).alias("mean_abs"),
    )


def gold_pairs(gold: DataFrame, variables: DataFrame) -> DataFrame:
    """Directed positive gold edges with both ends known, as ``i < j`` (kept per direction)."""
    tf = variables.select(F.col("var_name").alias("TF"), F.col("var_id").alias("_a"))
    tg = variables.select(F.col("var_name").alias("target"), F.col("var_id").alias("_b"))
    return (
        gold.filter(F.col("label") == 1).join(tf, "TF").join(tg, "target")
        .select(F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j"))
    )


def gold_truth(gold: DataFrame, variables: DataFrame) -> DataFrame:
    """Symmetric truth edges of a gold standard."""
    return gold_pairs(gold, variables).filter("i < j").distinct()


# --- summaries of result tables --------------------------------------------


def summarise(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard deviation and standard error per group."""
    return results.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
    )


def summarise_by_seed(results: DataFrame, keys: list[str], value: str,
                      seed: str = "seed_offset") -> DataFrame:
    """Mean per seed, then mean and spread over seeds (one level when there is one seed)."""
    per_seed = results.groupBy(*keys, seed).agg(
        F.avg(value).alias("m"), F.stddev_samp(value).alias("s")
    )
    return per_seed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("m").alias("mean"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("m")).otherwise(F.max("s")).alias("std"),
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float],
                      rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Linearly interpolated percentiles per group.

    Equal values are counted first and located by running counts, so a group
    of any size is never held by one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running(counts, value, {"_cum": ("_c", "sum")}, keys, counts.count(), rows_per_slice=rows_per_slice)
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    placed = cum.join(sizes, keys)

    def at(position):
        here = (F.col("_cum") > position) & (F.col("_cum") - F.col("_c") <= position)
        return F.max(F.when(here, F.col(value)))

    picks = []
    for name, share in shares.items():
        h = (F.col("_n") - 1) * F.lit(float(share))
        picks += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}"),
                  F.max(h - F.floor(h)).alias(f"_f_{name}")]
    return placed.groupBy(*keys).agg(*picks).select(*keys, *[
        (F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in shares])


def wall_percentiles(results: DataFrame, keys: list[str], value: str = "wall_seconds") -> DataFrame:
    return exact_percentiles(results, keys, value, {"p25": 0.25, "median": 0.5, "p75": 0.75})


def max_normalised(results: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Grand mean of every metric divided by the best method's grand mean."""
    means = results.groupBy(key).agg(*[F.avg(m).alias(m) for m in metrics])
    everything = Window.partitionBy()  # one row per method
    return means.select(
        key, *[F.try_divide(F.col(m), F.max(m).over(everything)).alias(m) for m in metrics]
    )


def diffusion_vs_recovery(diffusion: DataFrame, synthetic: DataFrame, diff_value: str,
                          syn_value: str, keys: list[str]) -> DataFrame:
    """Cell means of a diffusion metric next to cell means of a recovery metric."""
    a = diffusion.groupBy(*keys).agg(F.avg(diff_value).alias(diff_value))
    b = synthetic.groupBy(*keys).agg(F.avg(syn_value).alias(syn_value))
    return a.join(b, keys)


def normalised_score(score, null):
    """``(score - null) / (1 - null)``; NaN when undefined."""
    denom = 1.0 - null
    bad = F.isnan(score) | F.isnan(null) | (F.abs(denom) < 1e-9)
    return F.when(bad, F.lit(NAN)).otherwise((score - null) / F.when(bad, F.lit(1.0)).otherwise(denom))
