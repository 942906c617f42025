"""Forms for wide tables, many groups and large graphs, against plain dense computation."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import diffusion, gram, graph, sampling, screened, sparse
from edgeloom.operators.estimators import GGLassoEstimator, SklearnGLasso
from edgeloom.operators.kernels import admm_glasso, gaussian_score, glasso
from edgeloom.operators.matrix import pair_grid
from edgeloom.operators.sampling import with_folds, with_subsets
from edgeloom.sources import readers


def test_units_stay_below_the_stated_limit():
    for p, keys in ((20_000, 1), (4096, 50), (20_000, 3), (64, 1000), (5, 1)):
        step, cells = gram._chunk_rows(p), {}
        for u in gram.units(p, keys):
            rows = min(u.hi * step, p) - u.lo * step
            assert (u.last - u.first) * rows * p <= gram._MAX_HELD_CELLS
            for k in range(u.first, u.last):
                cells[k] = cells.get(k, 0) + rows * p
        assert cells == {k: p * p for k in range(keys)}
    assert all((u.hi - u.lo) * gram._chunk_rows(20_000) * 20_000 <= gram._MAX_HELD_CELLS for u in gram.units(20_000, None))


@pytest.mark.parametrize(("p", "limit"), [(40, 400), (40, 3000), (7, 10)])
def test_a_task_never_holds_more(monkeypatch, p, limit):
    monkeypatch.setattr(gram, "_CELLS_PER_BLOCK", 2 * p)
    most, bands = 0, []

    class Counted(gram._Band):
        def __init__(self, *args):
            super().__init__(*args)
            bands.append(self)

    monkeypatch.setattr(gram, "_Band", Counted)
    rng = np.random.default_rng(p)
    x, keys = rng.standard_normal((60, p)), rng.integers(0, 5, 60)
    batches = [pa.RecordBatch.from_pydict({
        "x": pa.array(list(x[k:k + 20])), "keys": pa.array([[int(v)] for v in keys[k:k + 20]], pa.list_(pa.int32()))}) for k in (0, 20, 40)]
    total = {}
    for u in gram.units(p, None, limit):
        bands.clear()
        for b in gram._fold(p, gram._key_groups, u, limit)(iter(batches)):
            key, c, n = b["key"][0].as_py(), b["chunk"][0].as_py(), b["n"][0].as_py()
            total.setdefault((key, c), []).append((n, np.array(b["mean"][0].as_py()), np.array(b["m2"][0].as_py()).reshape(-1, p)))
        most = max(most, max(b.m2.size for b in bands))
    assert most <= max(limit, 2 * p)
    for key in range(5):
        own = x[keys == key]
        for c in range(-(-p // 2)):
            parts = total[key, c]
            mean = sum(n * m for n, m, _ in parts) / sum(n for n, _, _ in parts)
            assert sum(n for n, _, _ in parts) == len(own) and np.allclose(mean, own.mean(axis=0))
            rows = slice(2 * c, 2 * c + 2)
            got = sum(m2 + n * np.outer((m - mean)[rows], m - mean) for n, m, m2 in parts)
            d = own - own.mean(axis=0)
            assert np.allclose(got, d[:, rows].T @ d)


def test_bands_and_keys_through_spark(spark, wide, monkeypatch):
    monkeypatch.setattr(gram, "_MAX_HELD_CELLS", 70_000)
    x = np.random.default_rng(1).standard_normal((50, 300)) + 5
    assert len(gram.units(300)) == 2 and len(gram.units(300, 4)) == 8
    df = wide(x)
    st = gram.collect_stats(df)
    d = x - x.mean(axis=0)
    assert st.n == 50 and np.allclose(st.m2, d.T @ d) and np.allclose(st.mean, x.mean(axis=0))
    subsets = with_subsets(df, 50, 20, 4, 1)
    blocks = gram.stat_blocks(subsets, 300, keyed=True).toPandas()
    for key, g in blocks.groupby("key"):
        inside = next(idx for k, idx in subsets.rule.groups(np.arange(50)) if k == key)
        e = x[inside] - x[inside].mean(axis=0)
        assert np.allclose(gram.assemble(g).m2, e.T @ e)
    assert set(blocks["key"]) == {0, 1, 2, 3}


@pytest.fixture(scope="module")
def blocky():
    """Samples of three independent groups of variables and two loners."""
    rng = np.random.default_rng(4)
    out = []
    for size in (5, 4, 3):
        base = rng.standard_normal((300, 1))
        out.append(base + 0.7 * rng.standard_normal((300, size)))
    return np.hstack([*out, rng.standard_normal((300, 2))])[:, rng.permutation(14)]


@pytest.mark.parametrize("dense_limit", [4096, 0])
@pytest.mark.parametrize("masked", [False, True])
def test_blocks_equal_the_dense_solve(spark, wide, blocky, dense_limit, masked):
    p = blocky.shape[1]
    mask = None
    if masked:
        mask = np.random.default_rng(2).uniform(0.3, 1.0, (p, p))
        mask = (mask + mask.T) / 2
    cov = np.cov(blocky.T, ddof=1)
    rows = screened.covariance_rows(wide(blocky), p, ddof=1)
    problems = spark.createDataFrame([(0, 0.35), (0, 0.6), (0, 5.0)], "key INT, lam DOUBLE")
    solved = screened.solve_blocks(rows, problems, p, mask, dense_limit=dense_limit).persist()
    for lam in (0.35, 0.6, 5.0):
        want = admm_glasso(cov, lam, mask, None, 5000, 1e-10, 1e-10)[0]
        one = solved.filter(F.col("lam") == lam)
        assert np.allclose(screened.dense_precision(one, p), want, atol=1e-5)
        assert one.filter("not ok").count() == 0
        assert one.agg(F.sum("logdet")).first()[0] == pytest.approx(np.linalg.slogdet(want)[1], abs=1e-5)
        if lam == 5.0:
            assert one.count() == p and screened.solved_edges(one).count() == 0
    assert solved.filter("lam = 0.6").count() > 1
    solved.unpersist()


def test_cross_validation_scores_are_those_of_whole_matrices(spark, wide, blocky):
    x = blocky[:60]
    df = wide(x)
    est = SklearnGLasso(cv=3, n_alphas=3, n_refinements=2).fit(df)
    assert not hasattr(est, "result_") and est.unconverged_ >= 0
    for alpha, got in est.cv_scores_.items():
        want = []
        for f in range(3):
            test, train = x[20 * f:20 * f + 20], np.vstack([x[:20 * f], x[20 * f + 20:]])
            want.append(gaussian_score(np.cov(test.T, ddof=0), glasso(np.cov(train.T, ddof=0), alpha, max_iter=200)[0]))
        assert got == pytest.approx(np.mean(want), abs=1e-6)
    assert np.allclose(est.precision_matrix, glasso(np.cov(x.T, ddof=0), est.alpha_, max_iter=200)[0], atol=1e-6)
    edges = est.precision_.toPandas()
    assert len(edges) == 14 * 13 // 2 and np.allclose(edges["omega"], est.precision_matrix[edges["i"], edges["j"]])
    est.release()


def test_groups_are_solved_apart(spark, wide, blocky):
    df = wide(blocky)
    subsets = with_subsets(df, 300, 150, 3, 0)
    got = GGLassoEstimator(0.4).keyed_values(subsets, 14).toPandas()
    assert len(got) == 3 * 14 * 13 // 2
    for key, idx in subsets.rule.groups(np.arange(300)):
        want = np.abs(glasso(np.cov(blocky[idx].T, ddof=1), 0.4)[0])
        g = got[got["key"] == key]
        assert np.allclose(g["value"], want[g["i"], g["j"]], atol=1e-6)


def test_folds_merge_to_training_covariances(spark, wide, blocky):
    rows = screened.fold_rows(with_folds(wide(blocky), 300, 4), 14, 4).toPandas()
    for f in range(4):
        held = np.arange(300) // 75 == f
        g = rows[rows["key"] == f].sort_values("i")
        assert np.allclose(np.stack(g["s"]), np.cov(blocky[~held].T, ddof=0)) and np.allclose(np.stack(g["t"]), np.cov(blocky[held].T, ddof=0))
    whole = rows[rows["key"] == -1].sort_values("i")
    assert np.allclose(np.stack(whole["s"]), np.cov(blocky.T, ddof=0)) and (whole["n"] == 300).all()


def random_graph(spark, p, m, seed, chain=True):
    rng = np.random.default_rng(seed)
    pairs = {(k, k + 1) for k in range(p - 1)} if chain else set()
    pairs |= {(int(min(e)), int(max(e))) for e in rng.integers(0, p, (m, 2)) if e[0] != e[1]}
    pairs = sorted(pairs)
    a = np.zeros((p, p)) if p <= 500 else None
    if a is not None:
        for i, j in pairs:
            a[i, j] = a[j, i] = 1.0
    return spark.createDataFrame(pairs, "i INT, j INT"), a, pairs


@pytest.mark.parametrize("normalised", [False, True])
def test_series_in_tasks_and_by_joins_equal_the_decomposition(spark, monkeypatch, normalised):
    p, times = 40, np.array([0.0, 1e-4, 0.2, 3.0])
    edges, a, _ = random_graph(spark, p, 60, 1, chain=False)
    delta = np.random.default_rng(0).standard_normal(p)
    want = diffusion.heat(diffusion.dense_laplacian(a, normalised), delta, times)
    graphs = edges.withColumn("graph", F.lit("g"))
    monkeypatch.setattr(diffusion, "MAX_DENSE_P", 10)
    monkeypatch.setattr(diffusion, "MAX_CELLS", 3 * p)
    one = diffusion.diffuse(graphs, p, delta, times, normalised).toPandas()
    assert np.allclose(want[one["node"], one["t_idx"]], one["s"], atol=1e-12) and len(one) == p * 4
    assert np.allclose(times[one["t_idx"]], one["t"])
    monkeypatch.setattr(diffusion, "edge_arrays", lambda e: None)
    two = diffusion.diffuse(graphs, p, delta, times, normalised).toPandas()
    assert np.allclose(want[two["node"], two["t_idx"]], two["s"], atol=1e-12) and len(two) == p * 4


def test_terms_grow_with_the_root_of_time():
    few, many = (len(sparse.chebyshev_weights(np.array([t]), 40.0)) for t in (10.0, 1000.0))
    assert many < 12 * few and many < 1500


def test_sparse_knockouts_equal_decompositions(spark, monkeypatch):
    p, times = 30, np.linspace(1e-4, 3.0, 7)
    edges, _, _ = random_graph(spark, p, 40, 2, chain=False)
    delta = np.random.default_rng(1).standard_normal(p)
    want = {r.node: r.impact for r in diffusion.knockout_impacts(edges, p, delta, times).collect()}
    monkeypatch.setattr(diffusion, "DENSE_NODES", 5)
    for cells in (10_000_000, 2 * p * 3):
        monkeypatch.setattr(diffusion, "MAX_CELLS", cells)
        got = {r.node: r.impact for r in diffusion.knockout_impacts(edges, p, delta, times).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_knockouts_of_five_thousand_nodes(spark):
    edges, _, pairs = random_graph(spark, 5000, 4000, 3)
    delta = np.zeros(5000)
    delta[7] = 1.0
    got = {r.node: r.impact for r in diffusion.knockout_impacts(edges, 5000, delta, [0.5]).collect()}
    assert len(got) == 5000
    i, j = map(np.array, zip(*pairs, strict=True))
    base = sparse.Laplacian(5000, i, j, np.ones(len(i)))
    for node in (7, 8, 2500):
        w = np.where((i == node) | (j == node), 0.3, 1.0)
        weak = sparse.Laplacian(5000, i, j, w)
        a, b = (sparse.heat_series(lambda x, m=m: m @ x, base.top, delta, np.array([0.5]))[0] for m in (base, weak))
        assert got[node] == pytest.approx(np.linalg.norm(a - b), abs=1e-12)


def test_fiedler_vector_of_a_large_graph(spark, monkeypatch):
    edges, a, _ = random_graph(spark, 300, 200, 4)
    lam, v = np.linalg.eigh(diffusion.dense_laplacian(a))
    got = diffusion.make_delta(edges, 300, "fiedler")
    assert abs(got @ v[:, 1]) == pytest.approx(1.0, abs=1e-9) and np.linalg.norm(got) == pytest.approx(1.0)
    small, a, _ = random_graph(spark, 12, 6, 4)
    product = diffusion.distributed_product(small, 12)
    x = np.random.default_rng(0).standard_normal(12)
    assert np.allclose(product(x), diffusion.dense_laplacian(a) @ x)
    edges, _, pairs = random_graph(spark, 10_000, 6000, 5)
    f = diffusion.make_delta(edges, 10_000, "fiedler")
    i, j = map(np.array, zip(*pairs, strict=True))
    lap = sparse.Laplacian(10_000, i, j, np.ones(len(i)))
    value = f @ (lap @ f)
    assert np.linalg.norm(lap @ f - value * f) < 1e-8 * lap.top and abs(f.sum()) < 1e-9 and value > 0
    with pytest.warns(UserWarning, match="disconnected"):
        diffusion.make_delta(edges.filter("i <> 5000 and j <> 5000"), 10_000, "fiedler")


def test_smallest_keys_without_a_sort(spark):
    grid = pair_grid(spark, 60)
    for key in (F.xxhash64("i", "j").bitwiseAND(F.lit(2**62 - 1)), (F.col("i") % 7).cast("bigint"), F.lit(5).cast("bigint")):
        for m in (0, 1, 300, 1770, 5000):
            want = {tuple(r) for r in grid.orderBy(key, "i", "j").limit(m).collect()}
            assert {tuple(r) for r in sampling.smallest(grid, key, m, ["i", "j"]).collect()} == want
    plan = graph.erdos_renyi_matching(grid.limit(100), 60, 1)._jdf.queryExecution().toString()
    assert plan.count("TakeOrdered") <= 2  # ties alone (and the hundred edges of this test) are taken in order


def test_row_ids_are_places_in_files(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    rows = [(f"s{k % 9}", float(k % 5), float(k)) for k in range(4000)]
    df = spark.createDataFrame(rows + rows[:50], "label STRING, a DOUBLE, b DOUBLE").repartition(3)
    df.write.option("header", True).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        samples, variables = readers.read_expression_csv(spark, path)
        one, two = samples.collect(), samples.collect()
        assert len({r.row_id for r in one}) == 4050 and min(r.row_id for r in one) >= 0
        assert {(r.row_id, *r.x) for r in one} == {(r.row_id, *r.x) for r in two}
        assert sorted(tuple(r.x) for r in one) == sorted((a, b) for _, a, b in rows + rows[:50])
        assert "Exchange" not in samples._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_expression_rows_are_counted_without_moving_each(spark, tmp_path):
    from edgeloom.plans.queries import QUERIES
    rows = [(k, 1.0, float(k), 0.0, 0.0) for k in range(20_000)]
    spark.createDataFrame(rows, "l_orderkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE").coalesce(
        1).write.parquet(str(tmp_path / "lineitem.parquet"))
    q = QUERIES["expression_csv"](spark, str(tmp_path))
    got = {r.var_name: (r.samples, r.n, r.total) for r in q.collect()}
    assert got["l_extendedprice"] == (40_000, 40_000, 399_980_000.0) and len(got) == 4
    assert "count(distinct" not in q._jdf.queryExecution().optimizedPlan().toString()
