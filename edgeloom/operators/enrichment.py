"""Gene sets from a network and their statistical enrichment.

The statistics run over gene-set tables supplied by the user
(``db, term_id, term_name, gene``); no web service is called. A table of
database names per level documents which collections a level stands for.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.centrality import hub_genes
from edgeloom.operators.communities import community_gene_sets, detect
from edgeloom.operators.graph import degree
from edgeloom.operators.inference import fdr_adjust_within
from edgeloom.operators.matrix import symmetrise
from edgeloom.operators.prefix import running
from edgeloom.session import checkpointed, spread

LEVELS = ("rna", "post_transcriptional", "protein", "all")
EXTRACTIONS = ("hub", "prerank", "community")
RANK_METHODS = ("min_pvalue", "degree", "fisher_combined")

# Database names per backend and level
DATABASES = {
    "gprofiler": {
        "rna": ["GO:BP", "GO:MF", "GO:CC", "KEGG", "REAC", "WP", "HP"],
        "post_transcriptional": ["MIRNA", "TF", "MSIGDB:C3"],
        "protein": ["CORUM", "HPA", "MSIGDB:C4"],
    },
    "gseapy": {
        "rna": [
            "GO_Biological_Process_2023", "GO_Molecular_Function_2023",
            "GO_Cellular_Component_2023", "KEGG_2021_Human", "Reactome_2022",
            "WikiPathways_2023_Human", "MSigDB_Hallmark_2020",
        ],
        "post_transcriptional": [
            "miRTarBase_2017", "TargetScan_microRNA_2017",
            "ENCODE_and_ChEA_Consensus_TFs_from_ChIP-X",
            "RNA-Seq_Disease_Gene_and_Drug_Signatures_from_GEO",
        ],
        "protein": [
            "CORUM", "PPI_Hub_Proteins", "InterPro_Domains_2019",
            "Human_Proteome_Map_Gene_Expression_Profiles_in_Normal_Tissues",
            "DIP_Kinase_Substrates_from_PhosphoSitePlus",
        ],
    },
}


def get_databases(level: str, backend: str) -> list[str]:
    """Database names of a level; ``all`` is the ordered union of the levels."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}; got {level!r}")
    if backend not in DATABASES:
        raise ValueError(f"backend must be 'gprofiler' or 'gseapy'; got {backend!r}")
    chosen = DATABASES[backend]
    names = chosen[level] if level != "all" else [n for part in chosen.values() for n in part]
    return list(dict.fromkeys(names))


def databases_table(spark) -> DataFrame:
    rows = [
        (b, lv, pos, db) for b in DATABASES for lv in LEVELS
        for pos, db in enumerate(get_databases(lv, b))
    ]
    return spark.createDataFrame(rows, "backend STRING, level STRING, pos INT, db STRING")


def node_scores(edges: DataFrame, p: int, method: str = "min_pvalue", floor: float = 1e-300) -> DataFrame:
    """``node, score`` from the significant edges ``i, j, p_value``.

    p-values below ``floor`` count as ``floor``. With 0 none is raised, and a
    p-value of 0 scores infinity.
    """
    if method not in RANK_METHODS:
        raise ValueError(f"method must be one of {RANK_METHODS}; got {method!r}")
    deg = degree(edges, p)
    if method == "degree":
        return deg.select("node", F.col("degree").cast("double").alias("score"))
    both = symmetrise(edges.select("i", "j", "p_value"), ["p_value"])
    pv = F.greatest(F.col("p_value"), F.lit(floor))
    logs = lambda f, x: F.when(x > 0, f(x)).when(x == 0, F.lit(float("-inf")))
    if method == "min_pvalue":
        score = -logs(F.log10, F.greatest(F.min("p_value"), F.lit(floor)))
    else:
        score = -2.0 * F.sum(logs(F.log, F.least(pv, F.lit(1.0))))
    got = both.groupBy("node").agg(score.alias("s"))
    return deg.join(got, "node", "left").select("node", F.coalesce("s", F.lit(0.0)).alias("score"))


def ranked_genes(edges: DataFrame, variables: DataFrame, p: int, method: str = "min_pvalue") -> DataFrame:
    names = variables.select(F.col("var_id").alias("node"), F.col("var_name").alias("gene"))
    return node_scores(edges, p, method).join(names, "node").select("gene", "score")


def _log_factorial(n: Column) -> Column:
    """``ln n!`` by Stirling's series, 12 steps up the recurrence where it is exact to 13 digits."""
    x = n.cast("double") + 1.0
    y = x + 12.0
    steps = x
    for k in range(1, 12):
        steps = steps * (x + float(k))
    series = 1.0 / (12.0 * y) - 1.0 / (360.0 * F.pow(y, 3)) + 1.0 / (1260.0 * F.pow(y, 5)) - 1.0 / (1680.0 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2.0 * math.pi)) + series - F.log(steps)


def hypergeometric_tail(n_all: Column, n_term: Column, n_query: Column, k: Column) -> Column:
    """``P(X >= k)``: the first term from log-factorials, the rest by ratios."""
    N, K, n, k = (c.cast("bigint") for c in (n_all, n_term, n_query, k))
    parts = F.array(K, N - K, n, N - n, k, K - k, n - k, N - K - n + k, N)
    signs = F.array(*[F.lit(x) for x in (1.0, 1.0, 1.0, 1.0, -1.0, -1.0, -1.0, -1.0, -1.0)])
    first = F.exp(F.aggregate(F.zip_with(parts, signs, lambda v, s: s * _log_factorial(v)), F.lit(0.0), lambda t, v: t + v))
    last = F.least(K, n)
    steps = F.when(last > k, F.sequence(k, last - 1)).otherwise(F.array().cast("array<bigint>"))
    init = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc: Column, x: Column) -> Column:
        t = acc["t"] * ((K - x) * (n - x)) / ((x + 1) * (N - K - n + x + 1)).cast("double")
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    tail = first * F.aggregate(steps, init, add, lambda acc: acc["s"])
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def ora(gene_sets: DataFrame, terms: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """Over-representation of each term in each gene set (hypergeometric, BH per set).

    Only overlapping (set, term) pairs are tested. ``background`` (``gene``)
    defaults to every annotated gene. The adjustment counts the tested pairs.
    """
    universe = (terms if background is None else background).select("gene").distinct()
    members = terms.select("db", "term_id", "term_name", "gene").distinct().join(universe, "gene")
    query = gene_sets.select("set_name", "gene").distinct().join(universe, "gene")
    n_all = universe.agg(F.count(F.lit(1))).scalar()
    term_size = members.groupBy("db", "term_id", "term_name").agg(F.count(F.lit(1)).alias("term_size"))
    query_size = query.groupBy("set_name").agg(F.count(F.lit(1)).alias("query_size"))
    hits = query.join(members, "gene").groupBy("set_name", "db", "term_id", "term_name").agg(
        F.count(F.lit(1)).alias("intersection_size"),
        F.array_sort(F.collect_list("gene")).alias("intersections"),
    )
    full = hits.join(term_size, ["db", "term_id", "term_name"]).join(query_size, "set_name").withColumn(
        "background_size", n_all)
    k, K, n, N = (F.col(c) for c in ("intersection_size", "term_size", "query_size", "background_size"))
    a, b, c, d = k, n - k, K - k, N - K - n + k
    odds = F.when((b * c) > 0, (a * d) / F.nullif((b * c).cast("double"), F.lit(0.0))).otherwise(
        F.lit(float("inf")))
    tested = full.withColumns({"p_value": hypergeometric_tail(N, K, n, k), "odds_ratio": odds})
    out = fdr_adjust_within(tested, ["set_name"])
    return out.withColumn("combined_score", -F.log(F.greatest("p_value", F.lit(1e-300))) * F.col("odds_ratio"))


def enrichment_scores(ranked: DataFrame, terms: DataFrame, rows: int = 0) -> DataFrame:
    """Weighted running-sum score of every term: ``db, term_id, term_name, hits, es``.

    The running sum only turns at hits, so only hits are kept: their overall
    positions come from one ranking of the genes, and each term needs the
    running total of its own hits.
    """
    placed = _positions(ranked, rows)
    n_all = placed.agg(F.count(F.lit(1)).cast("double")).scalar()
    hits = terms.select("db", "term_id", "term_name", "gene").distinct().join(placed, "gene")
    keys = ["db", "term_id", "term_name"]
    term = Window.partitionBy(*keys)  # a term's genes
    upto = term.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    w = F.abs("score")
    total = F.sum(w).over(term)
    size = F.count(F.lit(1)).over(term)
    share = F.when(total > 0, F.sum(w).over(upto) / total).otherwise(F.row_number().over(
        term.orderBy("pos")) / size)
    own = F.when(total > 0, w / total).otherwise(1.0 / size)
    k = F.row_number().over(term.orderBy("pos"))
    miss = F.try_divide(F.col("pos") - k, F.col("n_all") - size)
    walk = hits.withColumn("n_all", n_all).select(
        *keys, size.alias("hits"), (share - miss).alias("peak"), (share - own - miss).alias("dip"))
    return walk.groupBy(*keys).agg(
        F.max("hits").alias("hits"), F.max("peak").alias("hi"), F.min("dip").alias("lo")
    ).select(*keys, "hits", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(
        F.col("lo")).alias("es"))


def _positions(ranked: DataFrame, rows: int) -> DataFrame:
    """``gene, score, pos`` with 1-based positions by descending score, then name."""
    one = ranked.select("gene", "score").withColumn("_k", F.struct((-F.col("score")).alias("s"), "gene"))
    cum = running(one.withColumn("_1", F.lit(1)), "_k", {"pos": ("_1", "sum")}, rows=rows)
    return cum.select("gene", "score", F.col("pos").cast("bigint").alias("pos"))


def _walk(weight: np.ndarray, pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sum after and before each hit, for rows of hit weights and sorted positions (from 0)."""
    k = pos.shape[1]
    total = weight.sum(axis=1, keepdims=True)
    flat = total <= 0
    weight = np.where(flat, 1.0 / k, weight / np.where(flat, 1.0, total))
    share = np.cumsum(weight, axis=1)
    miss = (pos - np.arange(k)) / max(n - k, 1)
    return share - miss, share - weight - miss


def _extreme(weight: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    """Signed running-sum extreme of each row."""
    after, before = _walk(weight, pos, n)
    hi, lo = after.max(axis=1), before.min(axis=1)
    return np.where(hi >= -lo, hi, lo)


MAX_RANKED_GENES = 2_000_000  # 16 MB of scores are broadcast to the permutation tasks; more are looked up by a join


def _null_scores(placed: DataFrame, sizes: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """``k, b, es``: the score of a random set of ``k`` genes, for every size and permutation.

    A permutation of gene labels moves a term to random places, whatever the
    term is, so terms of a size share their null scores. Draws are seeded by
    size and permutation: a retried task repeats them.
    """
    spark = placed.sparkSession
    draws = spread(sizes.select("k", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("b")), "k", "b")

    def places(k: int, b: int) -> np.ndarray:
        return np.sort(np.random.default_rng([seed, k, b]).choice(n, k, replace=False))

    if n <= MAX_RANKED_GENES:
        scores = np.abs(placed.orderBy("pos").select("score").toPandas()["score"].to_numpy(float))
        shared = spark.sparkContext.broadcast(scores)

        def run(batches):
            w = shared.value
            for pdf in batches:
                rows = [places(int(k), int(b)) for k, b in zip(pdf["k"], pdf["b"])]
                yield pdf.assign(es=[float(_extreme(w[None, p], p[None, :], n)[0]) for p in rows])

        return draws.mapInPandas(run, "k INT, b INT, es DOUBLE")

    def spots(batches):
        for pdf in batches:
            for k, b in zip(pdf["k"], pdf["b"]):
                yield pd.DataFrame({"k": k, "b": b, "pos": places(int(k), int(b)) + 1})

    hits = draws.mapInPandas(spots, "k INT, b INT, pos BIGINT").join(placed.select("pos", F.abs("score").alias("w")), "pos")
    sets = hits.groupBy("k", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("h")).select(
        "k", "b", F.col("h.pos").alias("pos"), F.col("h.w").alias("w"))  # a set of k genes a row

    def walked(batches):
        for pdf in batches:
            es = [float(_extreme(np.asarray(w)[None, :], np.asarray(pos)[None, :] - 1, n)[0]) for pos, w in zip(pdf["pos"], pdf["w"])]
            yield pd.DataFrame({"k": pdf["k"], "b": pdf["b"], "es": es})

    return sets.mapInPandas(walked, "k INT, b INT, es DOUBLE")


def prerank(ranked: DataFrame, terms: DataFrame, permutations: int = 1000, min_size: int = 5,
            max_size: int = 500, seed: int = 42) -> DataFrame:
    """Pre-ranked enrichment: ``term_name, ES, NES, p_value, adjusted_p_value, lead_genes``.

    Gene labels are permuted; null scores are drawn for each size of a term
    (``_null_scores``), so they number ``(max_size - min_size + 1) * permutations`` at most, whatever
    the number of terms. A score is normalised by the mean null score of its
    sign and size. The FDR is the share of normalised null scores (each size as
    often as terms have it) at least as extreme over the share of observed
    ones, by exact counts.
    """
    spark = ranked.sparkSession
    n = ranked.count()
    placed = checkpointed(_positions(ranked, n))
    keys = ["db", "term_id", "term_name"]
    hit = F.struct("pos", "gene", F.abs("score").alias("w"))
    sets = checkpointed(
        terms.select(*keys, "gene").distinct().join(placed, "gene")
        .groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
        .filter(F.size("hits").between(min_size, max_size)).withColumn("k", F.size("hits"))
    )  # at most max_size genes per row
    sizes = sets.groupBy("k").agg(F.count(F.lit(1)).alias("terms"))
    null = checkpointed(_null_scores(placed, sizes, n, permutations, seed))
    up, down = F.col("es") >= 0, F.col("es") < 0
    by_size = null.groupBy("k").agg(
        F.avg(F.when(up, F.col("es"))).alias("up"), F.avg(F.when(down, F.col("es"))).alias("down"),
        F.sort_array(F.collect_list("es")).alias("null")).join(sizes, "k")  # a row a size, ``permutations`` numbers each

    def score(batches):
        for pdf in batches:
            out = []
            for db, term_id, name, hits, up, down, null in pdf[[*keys, "hits", "up", "down", "null"]].itertuples(index=False):
                pos, w = np.array([h["pos"] for h in hits]) - 1, np.array([h["w"] for h in hits])
                after, before = (x[0] for x in _walk(w[None, :], pos[None, :], n))
                es = float(_extreme(w[None, :], pos[None, :], n)[0])
                null = np.asarray(null)
                side = null[null >= 0] if es >= 0 else null[null < 0]
                mean = up if es >= 0 else down
                nes = es / abs(mean) if side.size and mean == mean and mean != 0 else 0.0
                more = (side >= es).sum() if es >= 0 else (side <= es).sum()
                lead = hits[: int(np.argmax(after)) + 1] if es >= 0 else hits[int(np.argmin(before)):]
                out.append((db, term_id, name, es, nes, float(more / side.size) if side.size else 1.0, ";".join(h["gene"] for h in lead)))
            yield pd.DataFrame(out, columns=[*keys, "ES", "NES", "p_value", "lead_genes"])

    scored = checkpointed(spread(sets.join(F.broadcast(by_size.drop("terms")), "k"), *keys).mapInPandas(
        score, "db STRING, term_id STRING, term_name STRING, ES DOUBLE, NES DOUBLE, p_value DOUBLE, lead_genes STRING"))
    mean = F.when(up, F.when(F.col("up") > 0, F.col("up"))).otherwise(-F.col("down"))
    normal = null.join(F.broadcast(by_size.drop("null")), "k").select(
        F.coalesce(F.col("es") / mean, F.col("es")).alias("nes"), "terms")
    pooled = normal.groupBy(F.when(F.col("nes") >= 0, 1).otherwise(-1).alias("sign"), F.abs("nes").alias("size")).agg(
        F.sum("terms").alias("c")).toPandas()  # bounded by the sizes and permutations
    tails = {}
    for sign in (1, -1):
        side = pooled[pooled["sign"] == sign].sort_values("size")
        c = side["c"].to_numpy(float)
        tails[sign] = (side["size"].to_numpy(float), np.append(np.cumsum(c[::-1])[::-1], 0.0) / max(c.sum(), 1.0))
    shared = spark.sparkContext.broadcast(tails)

    def beyond(batches):
        for pdf in batches:
            share = [float(shared.value[s][1][np.searchsorted(shared.value[s][0], v, side="left")]) for s, v in zip(pdf["sign"], pdf["size"])]
            yield pdf.assign(null_share=share)

    signed = scored.withColumns({"sign": F.when(F.col("NES") >= 0, 1).otherwise(-1), "size": F.abs("NES")})
    counts = signed.groupBy("sign", "size").agg(F.count(F.lit(1)).alias("c"))
    total = signed.groupBy("sign").agg(F.count(F.lit(1)).alias("all_"))
    at_least = running(counts, "size", {"ge": ("c", "sum")}, part=["sign"], descending=True)
    shares = at_least.join(F.broadcast(total), "sign").mapInPandas(  # two rows
        beyond, "sign INT, size DOUBLE, c BIGINT, ge BIGINT, all_ BIGINT, null_share DOUBLE")
    adjusted = F.least(F.lit(1.0), F.col("null_share") / (F.col("ge") / F.col("all_")))
    return signed.join(shares.select("sign", "size", adjusted.alias("adjusted_p_value")), ["sign", "size"]).select(
        *keys, "ES", "NES", "p_value", "adjusted_p_value", "lead_genes")


@dataclass(frozen=True)
class EnrichmentResult:
    """Results for one gene set with the settings that produced them."""

    gene_set_name: str
    level: str
    backend: str
    method: str
    results: DataFrame
    gene_list: DataFrame
    background: DataFrame | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def is_empty(self) -> bool:
        return self.results.isEmpty()

    def significant(self, alpha: float = 0.05) -> DataFrame:
        if "adjusted_p_value" not in self.results.columns:
            warnings.warn("no adjusted_p_value column: returning all rows", stacklevel=2)
            return self.results
        return self.results.filter(F.col("adjusted_p_value") <= alpha)


def from_adjacency(edges: DataFrame, variables: DataFrame, terms: DataFrame, p: int,
                   level: str = "all", method: str = "ora", backend: str = "gprofiler",
                   extraction: str = "hub", centrality: str = "degree", hub_quantile: float = 0.9,
                   rank_method: str = "min_pvalue", community_algorithm: str = "greedy_modularity",
                   background: DataFrame | None = None) -> list[EnrichmentResult]:
    """Enrichment of hubs, communities or the ranked genes of a network.

    ``edges`` are the network's edges, with ``p_value`` for pre-ranking.
    ``terms`` is restricted to the databases of the level where its ``db``
    values are among them. ``extraction='prerank'`` gives a pre-ranked test with
    the ``gseapy`` backend and over-representation of above-median hubs with
    ``gprofiler``, which has no pre-ranked form.
    """
    wanted = get_databases(level, backend)
    if extraction not in EXTRACTIONS:
        raise ValueError(f"extraction must be one of {EXTRACTIONS}; got {extraction!r}")
    if method not in ("ora", "prerank"):
        raise ValueError(f"method must be 'ora' or 'prerank'; got {method!r}")
    if method == "prerank" and extraction != "prerank":
        raise ValueError("method='prerank' needs extraction='prerank'")
    known = {n for b in DATABASES.values() for part in b.values() for n in part}
    used = terms.filter(F.col("db").isin(wanted) | ~F.col("db").isin(sorted(known)))
    meta = {"extraction": extraction, "centrality": centrality, "hub_quantile": str(hub_quantile),
            "community_algorithm": community_algorithm, "rank_method": rank_method}

    if extraction == "prerank" and backend == "gseapy":
        if rank_method != "degree" and "p_value" not in edges.columns:
            raise ValueError(f"rank_method={rank_method!r} needs a p_value column")
        ranked = ranked_genes(edges, variables, p, rank_method)
        return [EnrichmentResult("ranked_genes", level, backend, "prerank", prerank(ranked, used),
                                 ranked.select("gene"), None, meta)]

    def labelled(hubs: DataFrame, name: str) -> DataFrame:
        # scores are never negative; a plain literal would fold the join keys away
        return hubs.select(F.when(F.col("score") >= 0, name).alias("set_name"), "gene")

    if extraction == "community":
        sets = community_gene_sets(detect(edges, p, community_algorithm), variables)
    elif extraction == "prerank":
        sets = labelled(hub_genes(edges, variables, p, "degree", 0.5), "hub_genes_fallback")
    else:
        sets = labelled(hub_genes(edges, variables, p, centrality, hub_quantile), "hub_genes")
    tested = ora(sets, used, background)
    names = sorted(r[0] for r in sets.select("set_name").distinct().collect()) or ["hub_genes"]
    return [
        EnrichmentResult(
            s, level, backend, "ora", tested.filter(F.col("set_name") == s).drop("set_name"),
            sets.filter(F.col("set_name") == s).select("gene"), background, meta)
        for s in names
    ]


def from_result(result, variables: DataFrame, terms: DataFrame, **options) -> list[EnrichmentResult]:
    """The same from a fitted result whose adjacency has been computed."""
    if result.adj_fdr is None:
        raise ValueError("adj_fdr is None: call get_adjacency() first")
    edges = result.adj_fdr.filter(F.col("is_edge") == 1).select("i", "j", "p_value")
    return from_adjacency(edges, variables, terms, result.p, **options)


def enrichment_table(hits: list[EnrichmentResult]) -> DataFrame | None:
    """Non-empty results as one table with four leading label columns."""
    frames = [
        h.results.select(
            F.lit(h.gene_set_name).alias("gene_set_name"), F.lit(h.level).alias("level"),
            F.lit(h.backend).alias("backend"), F.lit(h.method).alias("method"), "*")
        for h in hits if not h.is_empty()
    ]
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


