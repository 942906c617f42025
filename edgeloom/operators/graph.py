"""Graph operators over edge tables ``i, j`` (``i < j``) and node counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.hashing import rank_hash
from edgeloom.operators.matrix import pair_grid, symmetrise
from edgeloom.operators.metrics import exact_percentiles
from edgeloom.operators.sampling import smallest
from edgeloom.session import checkpointed


def nodes_table(spark, p: int) -> DataFrame:
    return spark.range(p).select(F.col("id").cast("int").alias("node"))


def degree(edges: DataFrame, p: int) -> DataFrame:
    """``node, degree`` for every node, isolated ones included."""
    counts = symmetrise(edges.select("i", "j"), []).groupBy("node").agg(
        F.count(F.lit(1)).alias("d")
    )
    return nodes_table(edges.sparkSession, p).join(counts, "node", "left").select(
        "node", F.coalesce("d", F.lit(0)).cast("bigint").alias("degree")
    )


def network_summary(edges: DataFrame, p: int) -> DataFrame:
    pairs = p * (p - 1) / 2.0
    return degree(edges, p).agg(
        F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"),
        F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"),
    ).withColumn("density", F.col("edges") / F.lit(pairs))


def laplacian(edges: DataFrame, p: int, normalised: bool = False, weight: str | None = None) -> DataFrame:
    """Non-zero entries ``i, j, l`` of the graph Laplacian, diagonal included."""
    w = F.col(weight) if weight else F.lit(1.0)
    both = symmetrise(edges.select("i", "j", w.cast("double").alias("w")), ["w"])
    strength = both.groupBy("node").agg(F.sum("w").alias("d"))
    diag = strength.select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("d").alias("l"))
    off = both.select(F.col("node").alias("i"), F.col("nbr").alias("j"), (-F.col("w")).alias("l"))
    out = off.unionByName(diag)
    if not normalised:
        return out
    di = strength.select(F.col("node").alias("i"), F.col("d").alias("di"))
    dj = strength.select(F.col("node").alias("j"), F.col("d").alias("dj"))
    return out.join(di, "i").join(dj, "j").select(
        "i", "j", (F.col("l") / F.sqrt(F.col("di") * F.col("dj"))).alias("l")
    )


def hub_node(edges: DataFrame, p: int) -> DataFrame:
    """The node of largest degree (lowest id on ties)."""
    return degree(edges, p).orderBy(F.desc("degree"), "node").limit(1)


def above_quantile(scores: DataFrame, quantile: float, value: str = "score") -> DataFrame:
    """Rows at or above a (linearly interpolated) quantile of their score."""
    cut = exact_percentiles(scores.withColumn("_k", F.lit(0)), ["_k"], value, {"q": quantile}).agg(F.max("q")).scalar()
    return scores.filter(F.col(value) >= cut)


def degree_tiers(edges: DataFrame, p: int) -> DataFrame:
    """hub / high / connected / peripheral by mean and population spread of degree."""
    d = degree(edges, p)
    mu = d.agg(F.avg("degree")).scalar()
    sd = d.agg(F.stddev_pop("degree")).scalar()
    x = F.col("degree")
    tier = (
        F.when(x >= mu + 2 * sd, "hub").when(x >= mu + sd, "high")
        .when(x >= mu, "connected").otherwise("peripheral")
    )
    return d.withColumn("tier", tier)


def star_roots(edges: DataFrame) -> DataFrame:
    """``u, c``: the lowest node that each node with an edge to a lower one is connected to.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the
    edge set is a set of stars: a logarithmic number of rounds in practice, each a
    group-by and a join. Every round is cut into reliable storage.
    """
    links = checkpointed(
        edges.select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v"))
        .filter("u <> v").distinct()
    )
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        links = checkpointed(small)
        state = links.agg(
            F.count(F.lit(1)), F.sum("u"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    return links.groupBy("u").agg(F.min("v").alias("c"))


def components(edges: DataFrame, p: int) -> DataFrame:
    """``node, component``: the lowest node id each node is connected to."""
    root = star_roots(edges)
    return nodes_table(edges.sparkSession, p).join(root, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("c", "node").alias("component")
    )


def erdos_renyi_matching(edges: DataFrame, p: int, seed: int) -> DataFrame:
    """A random graph with as many edges: the pairs of smallest hash."""
    m = edges.count()
    key = rank_hash(F.col("i").cast("bigint") * F.lit(p) + F.col("j"), seed)
    return smallest(pair_grid(edges.sparkSession, p), key, m, ["i", "j"])


def neighbours_of(edges: DataFrame, hub: int) -> DataFrame:
    """``node, z``: neighbours of one node and the weight of the joining edge."""
    return symmetrise(edges.select("i", "j", "w"), ["w"]).filter(F.col("node") == hub).select(
        F.col("nbr").alias("node"), F.col("w").alias("z")
    )


def triangle_closing_edges(edges: DataFrame, hub: int) -> DataFrame:
    """Edges whose two ends are both neighbours of ``hub``, with the hub weights."""
    nb = neighbours_of(edges, hub)
    return (
        edges.join(nb.select(F.col("node").alias("i"), F.col("z").alias("zi")), "i")
        .join(nb.select(F.col("node").alias("j"), F.col("z").alias("zj")), "j")
        .select("i", "j", "w", (F.col("zi") + F.col("zj")).alias("support"))
    )


def _top_rows(df: DataFrame, k: int | None, *order) -> DataFrame:
    """Rank rows by ``order`` as ``k``-bounded positions starting at 0."""
    top = df.orderBy(*order) if k is None else df.orderBy(*order).limit(k)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)


def edge_filtration(edges: DataFrame, steps: int) -> DataFrame:
    """Edge counts per threshold, thresholds log-spaced from the largest weight to the smallest.

    An edge is active from its first step on, so it is counted once at that
    step and the counts are accumulated: no edge x threshold table.
    """
    first = _first_step(edges, steps)
    per = first.groupBy("step").agg(F.count(F.lit(1)).alias("c"))
    grid = _thresholds(edges, steps)
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # `steps` rows
    return grid.join(F.broadcast(per), "step", "left").select(
        "step", "threshold",
        F.sum(F.coalesce("c", F.lit(0))).over(w).cast("bigint").alias("active_edges"),
    )


def _thresholds(edges: DataFrame, steps: int) -> DataFrame:
    lo, hi = edges.agg(F.min("w"), F.max("w")).first()
    a, b = math.log10(hi), math.log10(lo)
    gap = (b - a) / max(steps - 1, 1)
    rows = [
        (k, hi if k == 0 else lo if k == steps - 1 else 10 ** (a + gap * k)) for k in range(steps)
    ]
    return edges.sparkSession.createDataFrame(rows, "step INT, threshold DOUBLE")


def _first_step(edges: DataFrame, steps: int) -> DataFrame:
    cuts = [r["threshold"] for r in _thresholds(edges, steps).orderBy("step").collect()]
    thresholds = F.array(*[F.lit(float(t)) for t in cuts])
    above = F.size(F.filter(thresholds, lambda t: t > F.col("w")))
    return edges.select("i", "j", above.alias("step")).filter(F.col("step") < steps)


def filtration_degrees(edges: DataFrame, steps: int, p: int) -> DataFrame:
    """``step, node, degree`` for nodes with at least one active edge."""
    first = symmetrise(_first_step(edges, steps), ["step"])
    arrivals = first.groupBy("node", "step").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("node").orderBy("step")  # at most `steps` rows per node
    spans = arrivals.select(
        "node", "step", F.sum("c").over(w).alias("degree"),
        F.coalesce(F.lead("step").over(w), F.lit(steps)).alias("until"),
    )
    return spans.select(
        F.explode(F.sequence("step", F.col("until") - 1)).alias("step"), "node",
        F.col("degree").cast("bigint").alias("degree"),
    )


def cascade_schedule(edges: DataFrame, hub: int, frames: tuple[int, int, int, int],
                     secondary: int = 30) -> DataFrame:
    """Edges left after each frame of a hub knock-out.

    ``frames`` are the ends of the intact, hub-removal and secondary-removal
    phases and the number of frames. Hub edges go weakest first; then up to
    ``secondary`` triangle-closing edges, best-supported first. Both phases use
    the smoothstep ``t^2 (3 - 2t)``.
    """
    p1, p2, p3, n_frames = frames
    spark = edges.sparkSession
    total = edges.agg(F.count(F.lit(1)).alias("c")).scalar()
    hub_edges = neighbours_of(edges, hub).agg(F.count(F.lit(1)).alias("c")).scalar()
    side = triangle_closing_edges(edges, hub).agg(
        F.least(F.count(F.lit(1)), F.lit(secondary)).alias("c")
    ).scalar()
    f = F.col("frame")

    def removed(start: int, end: int, size):
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (f - start) / F.lit(float(end - start))))
        return F.rint(t * t * (3.0 - 2.0 * t) * size).cast("bigint")

    return (
        spark.range(n_frames).select(F.col("id").cast("int").alias("frame"))
        .withColumns({"hub_removed": removed(p1, p2, hub_edges),
                      "secondary_removed": removed(p2, p3, side)})
        .withColumn("edges_left", total - F.col("hub_removed") - F.col("secondary_removed"))
        .withColumn("hub_edges_left", hub_edges - F.col("hub_removed"))
    )


def cascade_removals(edges: DataFrame, hub: int, secondary: int = 30) -> DataFrame:
    """Removal order: ``phase, pos, i, j`` (0 = hub edges, 1 = secondary edges)."""
    h = edges.filter((F.col("i") == hub) | (F.col("j") == hub)).select("i", "j", "w")
    first = _top_rows(h, None, F.asc("w"), F.asc("i"), F.asc("j")).select(
        F.lit(0).alias("phase"), "pos", "i", "j")
    t = triangle_closing_edges(edges, hub)
    second = _top_rows(t, secondary, F.desc("support"), F.asc("i"), F.asc("j")).select(
        F.lit(1).alias("phase"), "pos", "i", "j")
    return first.unionByName(second)


def cascade_degrees(edges: DataFrame, hub: int, frames: tuple[int, int, int, int], p: int,
                    secondary: int = 30) -> DataFrame:
    """``frame, node, degree`` of the nodes that lose edges, for every frame."""
    plan = cascade_schedule(edges, hub, frames, secondary)
    order = symmetrise(cascade_removals(edges, hub, secondary), ["phase", "pos"])
    base = degree(edges, p)
    touched = order.join(base, "node")
    gone = F.when(F.col("phase") == 0, F.col("pos") < F.col("hub_removed")).otherwise(
        F.col("pos") < F.col("secondary_removed")
    )
    steps = F.broadcast(plan.select(  # one row holding n_frames entries
        F.lit(0).alias("_k"), "frame", "hub_removed", "secondary_removed"
    ).groupBy("_k").agg(F.collect_list(F.struct("frame", "hub_removed", "secondary_removed")).alias("f")))
    return (
        touched.withColumn("_k", F.lit(0)).join(steps, "_k")
        .select("node", "degree", "phase", "pos", F.inline("f"))
        .groupBy("frame", "node")
        .agg((F.max("degree") - F.sum(gone.cast("bigint"))).alias("degree"))
    )


def precision_from_graph(edges: DataFrame, p: int, edge_weight: float = 0.3,
                         min_eig: float = 0.1) -> tuple[DataFrame, float]:
    """Off-diagonal weights and the diagonal of a positive-definite precision matrix."""
    from edgeloom.operators.preprocess import dense_from_edges
    from edgeloom.operators.simulate import diagonal_shift

    dense = dense_from_edges(edges.select("i", "j", F.lit(1.0).alias("a")), "a", p, 0.0)
    shift = diagonal_shift(dense * edge_weight, min_eig)
    return edges.select("i", "j", F.lit(edge_weight).alias("theta")), shift
