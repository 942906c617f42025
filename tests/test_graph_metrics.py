import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import two_sided_p
from edgeloom.operators import centrality, communities, diffusion, enrichment, graph, metrics
from edgeloom.operators.communities import _merge_component
from edgeloom.plans import tasks


@pytest.fixture(scope="module")
def make(spark):
    def edges(pairs, w=None):
        rows = [(min(p), max(p), float(k + 1) if w is None else w[k]) for k, p in enumerate(pairs)]
        return spark.createDataFrame(rows, "i INT, j INT, w DOUBLE")

    return edges


def test_confusion_and_curve_fixtures(spark):
    true = {(0, 1), (0, 2), (0, 3)}
    pred = {(0, 1), (0, 2), (1, 2)}
    rows = [(i, j, int((i, j) in pred), int((i, j) in true), float((i, j) in pred)) for i in range(5) for j in range(i + 1, 5)]
    m = metrics.evaluate(spark.createDataFrame(rows, "i INT, j INT, pred INT, truth INT, score DOUBLE")).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.shd) == (2, 1, 1, 6, 2)
    assert m.precision == m.recall == pytest.approx(2 / 3) and m.f1 == pytest.approx(2 / 3)
    assert m.mcc == pytest.approx(11 / 21)
    labels = [1, 1, 0, 1, 0, 0, 0, 0, 0, 0]
    scores = [0.9, 0.8, 0.8, 0.4, 0.3, 0.2, 0.2, 0.1, 0.1, 0.0]
    df = spark.createDataFrame([(0, k, 0, t, s) for k, (t, s) in enumerate(zip(labels, scores))],
                               "i INT, j INT, pred INT, truth INT, score DOUBLE")
    for rows_hint, per in ((0, 10**6), (10, 3)):
        c = metrics.evaluate(df, rows=rows_hint, rows_per_slice=per).first()
        assert c.aupr == pytest.approx(0.805556, abs=1e-6)
        assert c.auroc == pytest.approx(0.928571, abs=1e-6)
        assert c.f1_opt == pytest.approx(0.857143, abs=1e-6)


def test_undefined_metrics_are_nan(spark):
    schema = "i INT, j INT, pred INT, truth INT, score DOUBLE"
    none = metrics.evaluate(spark.createDataFrame([(0, 1, 1, 0, 0.5), (0, 2, 0, 0, 0.1)], schema)).first()
    assert math.isnan(none.aupr) and math.isnan(none.auroc) and math.isnan(none.f1_opt) and none.f1 == 0.0
    full = metrics.evaluate(spark.createDataFrame([(0, 1, 1, 1, 0.5), (0, 2, 0, 1, 0.1)], schema)).first()
    assert math.isnan(full.auroc) and full.aupr == pytest.approx(1.0)


def test_star_graph(make):
    g = make([(0, k) for k in range(1, 5)])
    lap = np.zeros((5, 5))
    for r in graph.laplacian(g, 5).collect():
        lap[r.i, r.j] = r.l
    assert np.allclose(np.linalg.eigvalsh(lap), [0, 1, 1, 1, 5])
    s = diffusion.diffuse(g.selectExpr("'g' as graph", "i", "j"), 5, diffusion.make_delta(g, 5, "hub"), [0.5]).orderBy("node")
    assert [r.s for r in s.collect()] == pytest.approx([0.265668] + [0.183583] * 4, abs=1e-6)
    hubs = graph.above_quantile(centrality.centrality_scores(g, 5), 0.9).collect()
    assert [r.node for r in hubs] == [0]
    b = {r.node: r.score for r in centrality.betweenness(g, 5).collect()}
    assert b[0] == pytest.approx(1.0) and b[1] == 0.0
    e = {r.node: r.score for r in centrality.eigenvector(g, 5).collect()}
    assert e[0] == pytest.approx(1 / math.sqrt(2), abs=1e-4)
    with pytest.raises(ValueError):
        centrality.centrality_scores(g, 5, "closeness")


def test_join_paths_for_large_graphs_agree(make, monkeypatch):
    g = make([(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (6, 7)])
    rows = lambda df: sorted(map(tuple, df.collect()))
    b = rows(centrality.betweenness(g, 9))
    cnm, lpa = rows(communities.greedy_modularity(g, 9)), rows(communities.label_propagation(g, 9))
    monkeypatch.setattr(centrality, "MAX_BROADCAST_EDGES", 3)
    monkeypatch.setattr(communities, "MAX_COMPONENT_EDGES", 3)
    assert rows(centrality.betweenness(g, 9)) == b
    assert rows(communities.greedy_modularity(g, 9)) == cnm
    assert rows(communities.label_propagation(g, 9)) == lpa
    assert {c for n, c in cnm if n < 3} == {0} and {c for n, c in cnm if 3 <= n < 6} == {3}


def test_components_and_tiers(make):
    g = make([(5, 3), (3, 1), (2, 4), (4, 6), (6, 8)])
    comp = {r.node: r.component for r in graph.components(g, 10).collect()}
    assert comp == {0: 0, 1: 1, 3: 1, 5: 1, 2: 2, 4: 2, 6: 2, 8: 2, 7: 7, 9: 9}
    empty = make([(0, 1)]).filter("i = 9")
    assert [r.component for r in graph.components(empty, 3).orderBy("node").collect()] == [0, 1, 2]
    tiers = {r.node: r.tier for r in graph.degree_tiers(make([(0, k) for k in range(1, 12)]), 12).collect()}
    assert tiers[0] == "hub" and set(list(tiers.values())[1:]) <= {"peripheral", "connected", "hub"}


def test_knockouts(make):
    path = make([(k, k + 1) for k in range(7)])
    delta = diffusion.make_delta(path, 8, "random", 3)
    m = diffusion.evaluate_knockouts(path, path, 8, delta, [0.1, 0.5]).first()
    assert m.knockout_spearman == pytest.approx(1.0) and m.knockout_top10_recall == 1.0
    d = diffusion.evaluate_diffusion(path, path, 8, delta, [0.1, 0.5]).first()
    assert d.diffusion_spearman_mean >= 0.99 and d.n_components_pred == 1
    with pytest.raises(ValueError):
        diffusion.make_delta(path, 8, "point")
    assert graph.erdos_renyi_matching(path, 8, 1).count() == 7


def test_series_equals_decomposition(make):
    g = make([(0, 1), (1, 2)])
    one = g.selectExpr("'a' as graph", "i", "j")
    d = np.array([1.0, 0.0, 0.0])
    a = diffusion.diffuse(one, 3, d, [0.05]).orderBy("node").collect()
    b = diffusion._diffuse_by_joins(g, 3, d, np.array([0.05]), False).orderBy("node").collect()
    assert [r.s for r in a] == pytest.approx([r.s for r in b], abs=1e-12)


def test_greedy_modularity_small():
    import pandas as pd

    two = pd.DataFrame({"i": [0, 0, 1, 3, 3, 4, 2], "j": [1, 2, 2, 4, 5, 5, 3]})
    got = _merge_component(two, 7.0)
    assert {got[0], got[1], got[2]} == {0} and {got[3], got[4], got[5]} == {3}


def test_community_sets_edge_cases(spark):
    names = spark.createDataFrame([(k, f"g{k}") for k in range(3)], "var_id INT, var_name STRING")
    alone = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "node INT, community INT")
    assert {r.set_name for r in communities.community_gene_sets(alone, names).collect()} == {"community_other"}
    with pytest.raises(ValueError):
        communities.detect(alone, 3, "louvain")


def test_ranked_scores_fixture(spark):
    e = spark.createDataFrame([(0, 1, 0.001), (0, 2, 0.02)], "i INT, j INT, p_value DOUBLE")
    s = lambda m: {r.node: r.score for r in enrichment.node_scores(e, 4, m).collect()}
    assert s("min_pvalue")[0] == pytest.approx(3.0) and s("min_pvalue")[3] == 0.0
    assert s("fisher_combined")[0] == pytest.approx(21.639557, abs=1e-6)
    assert s("degree") == {0: 2.0, 1: 1.0, 2: 1.0, 3: 0.0}


def test_ranked_scores_without_a_floor(spark):
    e = spark.createDataFrame([(0, 1, 0.0), (1, 2, 1e-310)], "i INT, j INT, p_value DOUBLE")
    s = lambda m, **k: {r.node: r.score for r in enrichment.node_scores(e, 4, m, **k).collect()}
    assert s("min_pvalue")[2] == 300.0 and s("min_pvalue", floor=0.0)[2] == pytest.approx(310.0)
    assert s("min_pvalue", floor=0.0)[0] == s("fisher_combined", floor=0.0)[1] == math.inf
    assert s("fisher_combined", floor=0.0)[3] == s("min_pvalue", floor=0.0)[3] == 0.0


def test_p_values_of_few_digits(spark):
    z = [37.6, -38.0, 38.3, 38.5, 39.0, math.inf]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z DOUBLE").select(two_sided_p(F.col("z"))).collect()]

    def tail(a):
        f = a
        for k in range(120, 0, -1):
            f = a + k / f
        return 2 * math.exp(-0.5 * a * a) / math.sqrt(2 * math.pi) / f
    assert got == pytest.approx([tail(abs(v)) for v in z], rel=1e-12, abs=0.0)


def test_enrichment(spark):
    genes = [f"g{k:02d}" for k in range(20)]
    terms = spark.createDataFrame(
        [("t", "A", "A", g) for g in genes[:5]] + [("t", "B", "B", g) for g in genes[5:]],
        "db STRING, term_id STRING, term_name STRING, gene STRING")
    sets = spark.createDataFrame([("s", g) for g in [*genes[:3], genes[10]]], "set_name STRING, gene STRING")
    a = enrichment.ora(sets, terms).filter("term_id = 'A'").first()
    assert a.p_value == pytest.approx(0.031992, abs=1e-6) and a.intersection_size == 3
    ranked = spark.createDataFrame([(g, float(20 - k)) for k, g in enumerate(genes)], "gene STRING, score DOUBLE")
    es = {r.term_id: r.es for r in enrichment.enrichment_scores(ranked, terms).collect()}
    assert es["A"] == pytest.approx(1.0) and es["B"] == pytest.approx(-1.0)
    pr = {r.term_id: r for r in enrichment.prerank(ranked, terms, 200).collect()}
    assert pr["A"].ES == pytest.approx(1.0) and pr["A"].p_value < 0.02 and pr["A"].NES > 1.5
    assert pr["A"].lead_genes == ";".join(genes[:5])
    assert enrichment.ora(sets.filter("set_name = 'none'"), terms).count() == 0
    assert len(enrichment.get_databases("all", "gprofiler")) == 13
    with pytest.raises(ValueError):
        enrichment.get_databases("dna", "gprofiler")


def test_percentiles_sliced_and_plain(spark):
    v = np.random.default_rng(1).integers(0, 30, 101).astype(float)
    df = spark.createDataFrame([(0, float(x)) for x in v], "k INT, v DOUBLE")
    for per in (10**6, 8):
        r = metrics.exact_percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.33}, per).first()
        assert (r.a, r.b) == pytest.approx((np.quantile(v, 0.25), np.quantile(v, 0.33)))


def test_runner_keeps_failures_as_rows(spark):
    from edgeloom.operators import estimators, simulate

    class Broken:
        def fit(self, x):
            raise RuntimeError("no")

    data = simulate.generate(spark, 200, 10, "hub", seed=2)
    out = tasks.run_benchmark([(estimators.DesparifiedGGM, {}, "a"), (Broken, {}, "b")], data.samples, data.true_edges)
    rows = {r.method: r for r in out.collect()}
    assert rows["a"].error is None and rows["a"].aupr > 0.5 and rows["a"].wall_seconds >= 0
    assert "no" in rows["b"].error and rows["b"].aupr is None
    assert tasks.task_grid(spark, topology=["a", "b"], rep=[1, 2, 3]).count() == 6


def test_assess_takes_truth_in_any_order(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 0, 0.1), (1, 2, 1, 0.8)], "i int, j int, is_edge int, score double")
    truth = spark.createDataFrame([(1, 0), (0, 1), (2, 1)], "i int, j int")
    row = metrics.assess(pairs, truth, 3).first()
    assert (row.tp, row.fp, row.tn, row.fn) == (2, 0, 1, 0)


def test_prerank_by_joins_and_exact_tails(spark, monkeypatch):
    rng = np.random.default_rng(3)
    genes = [f"g{k:02d}" for k in range(60)]
    score = np.round(np.sort(rng.standard_normal(60))[::-1], 6)
    ranked = spark.createDataFrame([(g, float(s)) for g, s in zip(genes, score)], "gene STRING, score DOUBLE")
    members = {f"T{t}": sorted(rng.choice(60, 5 + t % 3, replace=False)) for t in range(14)}
    members["T14"] = [0, 1, 2, 3, 5, 8]
    terms = spark.createDataFrame([("d", t, t, genes[k]) for t, ks in members.items() for k in ks], "db STRING, term_id STRING, term_name STRING, gene STRING")
    one = {r.term_id: r for r in enrichment.prerank(ranked, terms, 80).collect()}
    monkeypatch.setattr(enrichment, "MAX_RANKED_GENES", 0)
    two = {r.term_id: r for r in enrichment.prerank(ranked, terms, 80).collect()}
    assert one.keys() == two.keys() == members.keys()
    for t in one:
        assert one[t].ES == pytest.approx(two[t].ES) and one[t].adjusted_p_value == pytest.approx(two[t].adjusted_p_value)

    def walk(positions):  # the running sum, gene by gene
        total, at, best = sum(abs(score[k]) for k in positions), 0.0, 0.0
        for k in range(60):
            at += abs(score[k]) / total if k in positions else -1.0 / (60 - len(positions))
            best = at if abs(at) > abs(best) + 1e-12 else best
        return best

    null = {k: [walk(set(np.random.default_rng([42, k, b]).choice(60, k, replace=False))) for b in range(80)] for k in (5, 6, 7)}
    side = lambda k, s: [x for x in null[k] if (x >= 0) == (s > 0)]
    norm = {t: walk(set(ks)) / abs(np.mean(side(len(ks), walk(set(ks)) + 1e-15))) for t, ks in members.items()}
    pool = [x / abs(np.mean(side(len(ks), x + 1e-15))) for ks in members.values() for x in null[len(ks)]]
    for t, ks in members.items():
        es = walk(set(ks))
        assert one[t].ES == pytest.approx(es) and one[t].NES == pytest.approx(norm[t])
        same = side(len(ks), es)
        assert one[t].p_value == pytest.approx(sum(abs(x) >= abs(es) - 1e-12 for x in same) / len(same))
        near, far = [x for x in pool if x * es > 0], [x for x in norm.values() if x * es > 0]
        share = lambda xs: sum(abs(x) >= abs(norm[t]) - 1e-12 for x in xs) / len(xs)
        assert one[t].adjusted_p_value == pytest.approx(min(1.0, share(near) / share(far)), abs=1e-9)
