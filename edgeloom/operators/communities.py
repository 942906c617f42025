"""Community detection and community gene sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.graph import components
from edgeloom.operators.matrix import symmetrise
from edgeloom.session import checkpointed, spread

ALGORITHMS = ("greedy_modularity", "label_propagation")
MAX_COMPONENT_EDGES = 2_000_000  # larger components are merged by joins


def _merge_component(edges: pd.DataFrame, m: float) -> dict[int, int]:
    """Greedy modularity merging of one connected component.

    ``m`` is the edge count of the whole graph. Ties go to the pair with the
    lowest community ids.
    """
    nodes = np.unique(edges[["i", "j"]].to_numpy())
    at = {int(v): k for k, v in enumerate(nodes)}
    n = len(nodes)
    e: list[dict[int, float]] = [{} for _ in range(n)]
    a = np.zeros(n)
    unit = 1.0 / (2.0 * m)
    for i, j in edges[["i", "j"]].itertuples(index=False):
        u, v = at[int(i)], at[int(j)]
        e[u][v] = e[v][u] = unit
        a[u] += unit
        a[v] += unit
    owner = np.arange(n)
    alive = set(range(n))

    def best_of(u: int):
        return max(((2.0 * (w - a[u] * a[v]), -min(u, v), -max(u, v)) for v, w in e[u].items()),
                   default=None)

    row_best = [best_of(u) for u in range(n)]
    while True:
        live = [row_best[u] for u in alive if row_best[u] is not None]
        top = max(live, default=None)
        if top is None or top[0] <= 1e-15:
            break
        u, v = -top[1], -top[2]
        touched = set(e[u]) | set(e[v])
        for k, w in e[v].items():
            if k != u:
                e[u][k] = e[k][u] = e[u].get(k, 0.0) + w
            e[k].pop(v, None)
        e[v] = {}
        a[u] += a[v]
        owner[owner == v] = u
        alive.discard(v)
        row_best[v] = None
        for k in (touched | {u}) & alive:
            row_best[k] = best_of(k)
    first = {}
    for k in range(n):
        first.setdefault(owner[k], int(nodes[k]))
    return {int(nodes[k]): first[owner[k]] for k in range(n)}


def _by_component(edges: DataFrame, p: int, small_task, by_joins) -> DataFrame:
    """Partition every component in its own task, components too large for one by joins."""
    comp = checkpointed(components(edges, p))
    keyed = checkpointed(edges.select("i", "j").join(comp.withColumnRenamed("node", "i"), "i"))
    sizes = keyed.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    big = sizes.filter(F.col("c") > MAX_COMPONENT_EDGES).select("component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = small_task(pdf)
        return pd.DataFrame({"node": list(found), "community": list(found.values())})

    part = spread(keyed.join(big, "component", "left_anti"), "component").groupBy("component").applyInPandas(
        run, "node INT, community INT")
    if not big.isEmpty():
        part = part.unionByName(by_joins(keyed.join(big, "component")))
    return comp.join(part, "node", "left").select(
        "node", F.coalesce("community", "node").alias("community"))


def greedy_modularity(edges: DataFrame, p: int) -> DataFrame:
    """``node, community`` by greedy modularity (Clauset, Newman and Moore 2004).

    Communities of different components never merge and do not affect each
    other's gains, so every component is an independent task. A component too
    large for a task is merged step by step with joins.
    """
    m = float(edges.count())
    return _by_component(edges, p, lambda pdf: _merge_component(pdf, m), lambda big: _merge_by_joins(big, m))


def _merge_by_joins(edges: DataFrame, m: float) -> DataFrame:
    """The same merging for large components, one merge per component and step."""
    unit = 1.0 / (2.0 * m)
    links = checkpointed(edges.select(
        "component", F.col("i").alias("u"), F.col("j").alias("v"), F.lit(unit).alias("w")))
    ends = edges.select("component", F.explode(F.array("i", "j")).alias("u"))
    share = checkpointed(ends.groupBy("component", "u").agg((F.count(F.lit(1)) * unit).alias("a")))
    member = share.select("component", F.col("u").alias("node"), F.col("u").alias("community"))
    while True:
        gain = (
            links.join(share, ["component", "u"])
            .join(share.select("component", F.col("u").alias("v"), F.col("a").alias("b")), ["component", "v"])
            .select("component", F.struct(
                (2.0 * (F.col("w") - F.col("a") * F.col("b"))).alias("g"),
                (-F.col("u")).alias("nu"), (-F.col("v")).alias("nv")).alias("s"))
        )
        pick = checkpointed(
            gain.groupBy("component").agg(F.max("s").alias("s")).filter(F.col("s.g") > 1e-15)
            .select("component", (-F.col("s.nu")).alias("keep"), (-F.col("s.nv")).alias("gone")))
        if pick.isEmpty():
            return member.select("node", "community")

        def renamed(df: DataFrame, col: str) -> DataFrame:
            return df.join(pick, "component", "left").withColumn(
                col, F.when(F.col(col) == F.col("gone"), F.col("keep")).otherwise(F.col(col))
            ).drop("keep", "gone")

        moved = renamed(renamed(links, "u"), "v").filter("u <> v")
        links = checkpointed(moved.groupBy(
            "component", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
        ).agg(F.sum("w").alias("w")))
        share = checkpointed(renamed(share, "u").groupBy("component", "u").agg(F.sum("a").alias("a")))
        member = checkpointed(renamed(member, "community"))


def _propagate_component(pdf: pd.DataFrame) -> dict[int, int]:
    """Semi-synchronous label propagation of one component."""
    nbrs: dict[int, list[int]] = {}
    for i, j in pdf[["i", "j"]].itertuples(index=False):
        nbrs.setdefault(int(i), []).append(int(j))
        nbrs.setdefault(int(j), []).append(int(i))
    colour: dict[int, int] = {}
    for v in sorted(nbrs, key=lambda k: (-len(nbrs[k]), k)):
        used = {colour[u] for u in nbrs[v] if u in colour}
        colour[v] = next(c for c in range(len(used) + 1) if c not in used)
    shades = [[v for v in nbrs if colour[v] == c] for c in range(max(colour.values()) + 1)]
    label = {v: v for v in nbrs}
    moved = True
    while moved:
        moved = False
        for shade in shades:
            for v in shade:  # no two nodes of a shade are neighbours
                seen, votes = np.unique([label[u] for u in nbrs[v]], return_counts=True)
                best = seen[votes == votes.max()]
                if label[v] not in best:
                    label[v], moved = int(best.max()), True
    first: dict[int, int] = {}
    for v in sorted(label):
        first.setdefault(label[v], v)
    return {v: first[c] for v, c in label.items()}


def label_propagation(edges: DataFrame, p: int) -> DataFrame:
    """``node, community`` by semi-synchronous label propagation (Cordasco and Gargano 2010).

    Nodes are coloured so that neighbours differ; the nodes of one colour
    update together. A node keeps its label if it is among the most frequent
    of its neighbours, otherwise it takes the largest of those.
    """
    return _by_component(edges, p, _propagate_component, _propagate_by_joins)


def _propagate_by_joins(edges: DataFrame) -> DataFrame:
    """The same updates for large components: every step is a join and two aggregations."""
    links = checkpointed(symmetrise(edges.select("i", "j"), []))
    degrees = links.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    colour = checkpointed(_greedy_colours(links, degrees))
    label = checkpointed(colour.select("node", F.col("node").alias("label")))
    shades = [r[0] for r in colour.select("colour").distinct().orderBy("colour").collect()]
    while True:
        changed = 0
        for shade in shades:
            mine = colour.filter(F.col("colour") == shade).select("node")
            votes = (
                links.join(mine, "node")
                .join(label.select(F.col("node").alias("nbr"), F.col("label").alias("l")), "nbr")
                .groupBy("node", "l").agg(F.count(F.lit(1)).alias("c"))
            )
            best = votes.groupBy("node").agg(
                F.max(F.struct("c", "l")).alias("top"), F.max("c").alias("cmax"))
            own = votes.select("node", F.col("l").alias("label"), F.col("c").alias("own"))
            step = (
                label.join(best, "node", "left").join(own, ["node", "label"], "left")
                .withColumn("new", F.when(
                    F.col("top").isNull() | (F.col("own") == F.col("cmax")), F.col("label")
                ).otherwise(F.col("top.l")))
            )
            step = checkpointed(step.select("node", "new", (F.col("new") != F.col("label")).cast("int").alias("moved")))
            changed += step.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]
            label = step.select("node", F.col("new").alias("label"))
        if changed == 0:
            break
    first = label.groupBy("label").agg(F.min("node").alias("community"))
    return label.join(first, "label").select("node", "community")


def _greedy_colours(links: DataFrame, degrees: DataFrame) -> DataFrame:
    """Greedy colouring, largest degree first, by rounds of independent nodes.

    A node is coloured once every neighbour that precedes it (higher degree,
    then lower id) is; the result is that of the sequential order.
    """
    order = F.struct(F.col("degree"), -F.col("node"))
    d = degrees.select("node", order.alias("o"))
    before = checkpointed(
        links.join(d, "node").join(d.select(F.col("node").alias("nbr"), F.col("o").alias("on")), "nbr")
        .filter(F.col("on") > F.col("o")).select("node", "nbr"))
    done = None
    todo = d.select("node")
    while True:
        open_edges = before if done is None else before.join(
            done.select(F.col("node").alias("nbr")), "nbr", "left_anti")
        ready = todo.join(open_edges.select("node").distinct(), "node", "left_anti")
        if done is None:
            now = ready.withColumn("colour", F.lit(0))
        else:
            taken = before.join(done.select(F.col("node").alias("nbr"), "colour"), "nbr").groupBy(
                "node").agg(F.array_sort(F.collect_set("colour")).alias("used"))
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))
            now = ready.join(taken, "node", "left").select(
                "node", F.coalesce(free, F.lit(0)).cast("int").alias("colour"))
        now = checkpointed(now)
        if now.isEmpty():
            return done
        done = now if done is None else checkpointed(done.unionByName(now))
        todo = checkpointed(todo.join(now, "node", "left_anti"))


def detect(edges: DataFrame, p: int, algorithm: str = "greedy_modularity") -> DataFrame:
    if algorithm == "greedy_modularity":
        return greedy_modularity(edges, p)
    if algorithm == "label_propagation":
        return label_propagation(edges, p)
    raise ValueError(f"algorithm must be one of {ALGORITHMS}; got {algorithm!r}")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Newman modularity of a partition, one row."""
    ci = membership.select(F.col("node").alias("i"), F.col("community").alias("ci"))
    cj = membership.select(F.col("node").alias("j"), F.col("community").alias("cj"))
    both = edges.select("i", "j").join(ci, "i").join(cj, "j")
    m = both.agg(F.count(F.lit(1)).cast("double")).scalar()
    inside = both.filter("ci = cj").groupBy(F.col("ci").alias("c")).agg(F.count(F.lit(1)).alias("l"))
    deg = both.select(F.explode(F.array("ci", "cj")).alias("c")).groupBy("c").agg(
        F.count(F.lit(1)).alias("k"))
    return deg.join(inside, "c", "left").agg(
        F.sum(F.coalesce("l", F.lit(0)) / m - (F.col("k") / (2.0 * m)) * (F.col("k") / (2.0 * m))
              ).alias("modularity"))


def community_gene_sets(membership: DataFrame, variables: DataFrame, min_size: int = 2) -> DataFrame:
    """``set_name, gene``: communities by size (``community_0`` largest); small ones
    are pooled in ``community_other``."""
    sizes = membership.groupBy("community").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    large = sizes.filter(F.col("size") >= min_size)
    # one row per community of at least min_size nodes
    order = Window.orderBy(F.desc("size"), "first")
    names = large.select("community", F.concat(
        F.lit("community_"), F.row_number().over(order) - 1).alias("set_name"))
    return (
        membership.join(names, "community", "left")
        .join(variables.select(F.col("var_id").alias("node"), F.col("var_name").alias("gene")), "node")
        .select(F.coalesce("set_name", F.lit("community_other")).alias("set_name"), "gene")
    )
