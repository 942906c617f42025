import pytest

from edgeloom.operators import simulate
from edgeloom.plans import tasks
from edgeloom.sources.readers import variables_table


@pytest.fixture(scope="module")
def small(spark):
    data = simulate.generate(spark, 150, 12, "hub", seed=4)
    return data, variables_table(spark, [f"g{k}" for k in range(12)])


def test_expression_task_selects_and_renumbers(small):
    data, names = small
    row = tasks.expression_task(data.samples, names, data.true_edges, "desparsified", top=8).first()
    assert row.p == 8 and row.tp + row.fp + row.tn + row.fn == 28 and row.method == "desparsified"


def test_coverage_study(spark):
    rows = {r.kind: r for r in tasks.coverage_study(spark, "null", 120, 5, 2, n_splits=4).collect()}
    assert set(rows) == {"asymptotic", "ensemble"}
    assert rows["asymptotic"].coverage_null > 0.8 and rows["asymptotic"].mean_width > 0


def test_network_at_several_levels(small):
    data, names = small
    edges, summary = tasks.burn_network(data.samples, names)
    s = {r.alpha: r.edges for r in summary.collect()}
    assert set(s) == {0.05, 0.10} and s[0.05] <= s[0.10]
    assert {"name_i", "name_j", "q_value"} <= set(edges.columns) and edges.count() == 66


def test_method_names(small):
    data, _ = small
    for m in ("desparsified", "glasso", "gglasso", "piglasso", "piglasso_adaptive", "piglasso_corr", "piglasso_oracle_n04"):
        est, prior = tasks.make_estimator(m, data.true_edges, 12, data.samples)
        assert (prior is not None) == (m in ("piglasso_corr", "piglasso_oracle_n04"))
    with pytest.raises(ValueError):
        tasks.make_estimator("other")
    seeds = {tasks.replicate_seed(t, r, o) for t in tasks.TOPOLOGIES for r in range(5) for o in range(3)}
    assert len(seeds) == 60


def test_prior_weight_reaches_the_estimator(small, monkeypatch):
    data, names = small
    prior = data.true_edges.selectExpr("i", "j", "1.0D as prior")
    seen = {}

    def fit(self, samples, prior=None):
        seen.update(weight=self.prior_weight, thr=self.pi_thr, prior=prior)
        raise RuntimeError("seen")

    monkeypatch.setattr(tasks.estimators.PIGLassoEstimator, "fit", fit)
    for method, given in (("piglasso_string", prior), ("piglasso_corr", None), ("piglasso_adaptive", prior)):
        with pytest.raises(RuntimeError, match="seen"):
            tasks.expression_task(data.samples, names, data.true_edges, method, prior=given, prior_weight=0.8)
        assert seen["weight"] == 0.8 and seen["prior"] is not None and (seen["thr"] == "adaptive") == (method == "piglasso_adaptive")
    with pytest.raises(ValueError, match="takes no prior"):
        tasks.expression_task(data.samples, names, data.true_edges, "glasso", prior=prior)


def test_diffusion_records_have_every_column(small, monkeypatch):
    data, _ = small
    truth = data.true_edges.select("i", "j")
    grids = []
    whole = tasks.diffusion.diffusion_task

    def short(predicted, truth, p, m, times, *rest):
        grids.append(times)
        return whole(predicted, truth, p, m, times[::40], *rest)

    monkeypatch.setattr(tasks.diffusion, "diffusion_task", short)
    rows = tasks.diffusion_records(truth, truth, 12, 150, "hub", "n150p12", "desparsified", 3, delta="hub").collect()
    assert rows[0].asDict().keys() == dict.fromkeys(tasks.DIFFUSION_COLUMNS).keys() and len(rows) == 1
    assert rows[0].diffusion_spearman_mean == pytest.approx(1.0) and rows[0].wall_seconds > 0 and rows[0].rep == 3
    assert len(grids[0]) == 80 and (grids[0][0], grids[0][-1]) == (1e-4, 3.0)
    pig = tasks.diffusion_records(truth, truth, 12, 150, "hub", "n150p12", "piglasso", 0, mode="diffusion").collect()
    assert [r.delta_mode for r in pig] == ["random"] and pig[0].knockout_spearman != pig[0].knockout_spearman
