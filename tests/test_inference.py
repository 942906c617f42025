import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import estimators as es
from edgeloom.operators import inference as inf
from edgeloom.operators import kernels, priors, simulate, stars
from edgeloom.operators.gram import collect_stats
from edgeloom.operators.wide import fit_nodes_by_active_set

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def hub(spark):
    data = simulate.generate(spark, 300, 20, "hub", seed=1)
    return data, data.samples.persist()


def test_penalty_fixtures():
    assert inf.penalty(500, 64) == pytest.approx(0.064856, abs=1e-6)
    assert inf.penalty(2000, 64) == pytest.approx(0.018932, abs=1e-6)
    assert inf.penalty(100, 50) == pytest.approx(0.179412, abs=1e-6)
    assert inf.penalty(500, 16) == pytest.approx(0.105311, abs=1e-6)
    assert inf.penalty(256, 16) == pytest.approx(0.147176, abs=1e-6)
    assert inf.penalty(500, 9, method="relaxed") == pytest.approx(0.044721, abs=1e-6)
    with pytest.raises(ValueError):
        es.DesparifiedGGM(lambda_method="other")


def test_two_variable_fixture(spark):
    nodes = es.fit_nodes(spark, np.array([[1.0, 0.5], [0.5, 1.0]]), 0.2, 1000, 1e-12).persist()
    assert sorted(es.beta_table(nodes).select("beta").collect())[0].beta == pytest.approx(0.3)
    e = inf.precision_edges(inf.floor_residuals(nodes.select("i", "tau2", "nnz")), es.beta_table(nodes), 100, 2).first()
    assert e.omega == pytest.approx(-0.379746835, abs=1e-9)
    assert e.z == pytest.approx(-4.806921968, abs=1e-8)
    assert e.p_value == pytest.approx(1.532718e-6, rel=1e-5)


def test_lasso_optimality(hub):
    g = collect_stats(hub[1]).correlation()
    lam = 0.08
    beta = kernels.lasso_nodes(g, lam, np.arange(20))
    grad = g - beta @ g
    np.fill_diagonal(grad, 0.0)
    assert np.all(np.abs(grad) <= lam + 1e-9)
    on = beta != 0
    assert np.allclose(grad[on], lam * np.sign(beta[on]), atol=1e-9)


def test_active_set_path_equals_broadcast_path(spark, hub):
    est = es.DesparifiedGGM().fit(hub[1])
    want = {(r.i, r.j): r.beta for r in est.beta_.collect()}
    raw, n = fit_nodes_by_active_set(hub[1], 20, lambda n: inf.penalty(n, 20), True, 10000, 1e-12)
    got = {(r.i, r.j): r.beta for r in es.beta_table(raw).collect()}
    assert n == 300 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_fit_recovers_hub_and_intervals_cover(hub):
    data, x = hub
    est = es.DesparifiedGGM().fit(x)
    adj = est.get_adjacency(0.05)
    true = {(r.i, r.j) for r in data.true_edges.collect()}
    found = {(r.i, r.j) for r in adj.filter("is_edge = 1").collect()}
    assert adj.count() == 190 and true <= found
    assert est.result_.adj_fdr is not None and est.degenerate_nodes_ == []
    bad = est.confidence_intervals().filter("lower > upper or omega < lower or omega > upper").count()
    assert bad == 0
    with pytest.raises(ValueError):
        est.confidence_intervals(method="ensemble")


def test_duplicate_column_is_flagged_and_finite(wide):
    x = RNG.standard_normal((100, 6))
    x[:, 3] = x[:, 0]
    est = es.DesparifiedGGM(lambda_scale=1e-4).fit(wide(x))
    assert {0, 3} <= set(est.degenerate_nodes_)
    assert est.result_.edges.filter("isnan(z) or isnan(p_value) or abs(omega) = double('inf')").count() == 0


def test_fdr_fixtures(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06]
    df = spark.createDataFrame([(0, k + 1, v) for k, v in enumerate(p)], "i INT, j INT, p_value DOUBLE")
    bh = [r.q_value for r in inf.fdr_control(df).orderBy("j").collect()]
    by = [r.q_value for r in inf.fdr_control(df, method="by").orderBy("j").collect()]
    assert bh == pytest.approx([0.006, 0.024, 0.0504, 0.0504, 0.0504, 0.06])
    assert by == pytest.approx([0.0147, 0.0588, 0.12348, 0.12348, 0.12348, 0.147])
    sliced = inf.fdr_adjust(df, rows_per_slice=2).orderBy("j").collect()
    assert [r.q_value for r in sliced] == pytest.approx(bh)
    zero = df.withColumn("p_value", F.lit(0.0))
    assert inf.fdr_control(zero).filter("is_edge = 0").count() == 0
    with pytest.raises(ValueError):
        inf.fdr_control(df, method="holm")


def test_ensemble_ci(hub):
    a = inf.ensemble_ci(hub[1], n_splits=8, seed=3).orderBy("i", "j").collect()
    b = inf.ensemble_ci(hub[1].repartition(5), n_splits=8, seed=3).orderBy("i", "j").collect()
    assert len(a) == 190 and all(r.lower <= r.omega <= r.upper for r in a)
    assert [r.omega for r in a] == pytest.approx([r.omega for r in b], abs=1e-9)
    for bad in ({"n_splits": 1}, {"subsample_frac": 1.0}):
        with pytest.raises(ValueError):
            inf.ensemble_ci(hub[1], **bad)


def test_instability_fixtures(spark):
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    for f, want in (([1.0] * 6, 0.0), ([0.5] * 6, 1.0), ([0.5] * 3 + [0.0] * 3, 0.5)):
        df = spark.createDataFrame([(0, *p, v) for p, v in zip(pairs, f) if v], "k INT, i INT, j INT, freq DOUBLE")
        assert stars.instability(df, 6, ["k"]).first().d == pytest.approx(want)


def test_stars_select(hub):
    adj, theta = stars.stars_select(hub[1], es.DesparifiedGGM(), n_subsamples=6, direction="smallest")
    assert any(theta == pytest.approx(t) for t in stars.default_grid()) and adj.count() == 190
    for bad in ({"beta": 0.0}, {"subsample_frac": 1.0}, {"n_jobs": 0}, {"threshold_grid": []}):
        with pytest.raises(ValueError):
            stars.stars_select(hub[1], es.DesparifiedGGM(), **bad)


def _check_glasso(s, theta, lam):
    w = np.linalg.inv(theta)
    off = ~np.eye(len(s), dtype=bool)
    gap = s - w
    assert np.abs(gap[off]).max() <= lam + 1e-5 and np.abs(np.diag(gap)).max() < 1e-5
    on = off & (np.abs(theta) > 1e-6)
    assert np.allclose(gap[on], -lam * np.sign(theta[on]), atol=1e-5)


def test_glasso_optimality_and_estimators(hub):
    data, x = hub
    st = collect_stats(x)
    est = es.GGLassoEstimator(0.1).fit(x)
    _check_glasso(st.covariance(1), est.precision_matrix, 0.1)
    assert est.get_adjacency().filter("is_edge = 1").count() > 0
    cv = es.SklearnGLasso(cv=3, n_refinements=2).fit(x)
    _check_glasso(st.covariance(), cv.precision_matrix, cv.alpha_)
    with pytest.raises(RuntimeError):
        es.GGLassoEstimator().get_adjacency()


def test_stability_selection(hub):
    data, x = hub
    prior = priors.noisy_oracle_prior(data.true_edges, 20, 0.0)
    est = es.PIGLassoEstimator(Q=8, n_lambda=4, pi_thr="adaptive").fit(x, prior)
    rows = est.stability_.collect()
    assert len(rows) == 190 and all(0 <= r.stability <= 1 for r in rows)
    assert 0.501 <= est.pi_thr_adaptive_ <= 0.9
    true = {(r.i, r.j) for r in data.true_edges.collect()}
    assert true <= {(r.i, r.j) for r in est.get_adjacency().filter("is_edge = 1").collect()}
    for bad in ({"pi_thr": "x"}, {"pi_thr": 0.4}, {"v_target": 0}):
        with pytest.raises(ValueError):
            es.PIGLassoEstimator(**bad)
    with pytest.raises(ValueError):
        es.PIGLassoEstimator(b_perc=1.0).fit(x)


def test_priors(spark, hub):
    data, x = hub
    corr = priors.corr_prior(x, gamma=2.0).collect()
    assert len(corr) == 190 and all(0 <= r.prior <= 1 for r in corr)
    same = priors.noisy_oracle_prior(data.true_edges, 20, 0.0).filter("prior = 1").count()
    assert same == data.true_edges.count()
    flipped = priors.noisy_oracle_prior(data.true_edges, 20, 0.2, 4).join(
        data.true_edges, ["i", "j"], "left").filter("(prior = 1) <> (label is not null)").count()
    assert flipped == round(0.2 * 190)
    names = spark.createDataFrame([(0, "a"), (1, "b")], "var_id INT, var_name STRING")
    other = spark.createDataFrame([(0, "c")], "var_id INT, var_name STRING")
    with pytest.raises(ValueError):
        priors.reindex_prior(priors.corr_prior(x), names, other)


def test_null_data_is_calibrated(wide):
    est = es.DesparifiedGGM().fit(wide(RNG.standard_normal((200, 30))))
    assert est.result_.edges.agg(F.avg((F.col("p_value") < 0.05).cast("double"))).first()[0] < 0.10


@pytest.mark.parametrize("topology", simulate.TOPOLOGIES[:4])
def test_generator(spark, topology):
    a = simulate.generate(spark, 60, 15, topology, seed=42)
    b = simulate.generate(spark, 60, 15, topology, seed=42)
    assert a.samples.count() == 60
    assert sorted(map(str, a.samples.collect())) == sorted(map(str, b.samples.collect()))
    theta = np.eye(15) * a.theta_diagonal
    for r in a.theta_edges.collect():
        theta[r.i, r.j] = theta[r.j, r.i] = r.theta
    assert np.linalg.eigvalsh(theta)[0] >= 0.1
    with pytest.raises(ValueError):
        simulate.generate(spark, 10, 5, "ring")


def test_harmonic_series_continues_smoothly():
    m = 10_000_000
    assert inf.harmonic(m + 1) - inf.harmonic(m) == pytest.approx(1 / (m + 1), abs=1e-9)
    assert inf.harmonic(6) == pytest.approx(2.45)
    assert math.isfinite(inf.harmonic(10**12))
