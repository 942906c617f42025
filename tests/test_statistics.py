import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import erfc, mix31, mix31_int, norm_ppf
from edgeloom.functions.hashing import rank_hash, rank_hash_array, set_salts
from edgeloom.operators import preprocess as pp
from edgeloom.operators.gram import collect_keyed_stats, collect_stats
from edgeloom.operators.matrix import edges_to_square_rows, to_long, to_wide, validate
from edgeloom.operators.prefix import average_rank, running
from edgeloom.operators.sampling import with_folds, with_subsets

RNG = np.random.default_rng(5)


def test_normal_functions(spark):
    xs = [0.0, 0.3, 0.47, 1.5, 3.9, 4.1, 9.0, 25.0, -2.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select("x", erfc(F.col("x")).alias("e")).collect()
    for r in rows:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-13)
    us = [1e-10, 0.02, 0.074, 0.5, 0.8, 0.9999]
    rows = spark.createDataFrame([(u,) for u in us], "u DOUBLE").select("u", norm_ppf(F.col("u")).alias("z")).collect()
    for r in rows:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.u), abs=1e-12)


def test_hash_is_the_same_in_column_scalar_and_array_form(spark):
    hi, lo = set_salts(3, 2)
    ids = np.array([0, 1, 7, 2**31, 2**40 + 3, 10**15])
    df = spark.createDataFrame([(int(i),) for i in ids], "id BIGINT")
    rows = df.select("id", mix31(F.col("id"), hi).alias("m"), rank_hash(F.col("id"), 3, 2).alias("h")).collect()
    got = dict(zip(ids.tolist(), rank_hash_array(ids, hi, lo).tolist()))
    for r in rows:
        assert r.m == mix31_int(r.id, hi) and r.h == got[r.id]


def test_statistics_match_numpy_for_any_partitioning(spark, wide):
    x = RNG.standard_normal((57, 5)) + 1e6
    for parts in (1, 7):
        st = collect_stats(wide(x).repartition(parts))
        assert st.n == 57
        assert np.allclose(st.mean, x.mean(0))
        assert np.allclose(st.covariance(1), np.cov(x.T), atol=1e-8)


def test_constant_column_has_zero_correlations(wide):
    x = RNG.standard_normal((20, 3))
    x[:, 1] = 2.0
    c = collect_stats(wide(x)).correlation()
    assert np.all(c[1] == 0) and c[0, 0] == pytest.approx(1.0)
    z = np.array([r.x for r in pp.standardise(wide(x)).collect()])
    assert np.allclose(z[:, 1], 0)
    assert np.allclose(z.std(axis=0)[[0, 2]], 1)


def test_running_sliced_equals_plain(spark):
    rows = [(g, float(v), int(v) % 7) for g in range(2) for v in RNG.permutation(200)]
    df = spark.createDataFrame(rows, "g INT, v DOUBLE, c INT")
    spec = {"s": ("c", "sum"), "lo": ("c", "min"), "hi": ("c", "max")}
    for desc in (False, True):
        a = running(df, "v", spec, ["g"], 200, desc).collect()
        b = running(df, "v", spec, ["g"], 200, desc, rows_per_slice=40).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_average_rank_with_a_hot_value(spark, wide):
    x = np.concatenate([np.zeros(40), RNG.integers(0, 9, 80)])[:, None]
    long = to_long(wide(x))
    a = average_rank(long, "value", ["var_id"], 120)
    b = average_rank(long, "value", ["var_id"], 120, rows_per_slice=25)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_npn_fixture(wide):
    out = pp.npn_shrinkage(wide([[v] for v in (1, 1, 2, 3, 3, 4)])).orderBy("row_id").collect()
    want = [-0.791638608, -0.791638608, -0.180012370, 0.366106357, 0.366106357, 1.067570524]
    assert [r.x[0] for r in out] == pytest.approx(want, abs=1e-8)
    assert pp.truncation_level(6) == pytest.approx(0.067326712, abs=1e-9)


def test_kendall_fixture_and_binned_path(spark, wide):
    tau = pp.kendall_edges(wide([[1, 1], [2, 3], [2, 2], [3, 4]])).first().tau
    assert tau == pytest.approx(0.912871, abs=1e-6)
    assert math.sin(math.pi / 2 * tau) == pytest.approx(0.990649, abs=1e-6)
    x = RNG.integers(0, 12, (150, 3)).astype(float)
    x[:60, 0] = 3.0  # one value holds 40 % of a column
    a = sorted(map(tuple, pp.kendall_edges(wide(x)).collect()))
    b = sorted(map(tuple, pp.kendall_edges(wide(x), rows_per_task=30).collect()))
    assert [r[:2] for r in a] == [r[:2] for r in b]
    assert [r[2] for r in a] == pytest.approx([r[2] for r in b], abs=1e-12)


def test_skeptic_keeps_shape_and_scale(wide):
    x = np.exp(RNG.standard_normal((60, 4)))
    x[:, 1] = 0.9 * x[:, 0] + 0.1 * x[:, 1]
    out = np.array([r.x for r in pp.npn_transform(wide(x), "skeptic").collect()])
    assert out.shape == (60, 4) and np.corrcoef(out.T)[0, 1] > 0.5
    with pytest.raises(ValueError):
        pp.npn_transform(wide(x), "other")
    with pytest.raises(ValueError):
        pp.skeptic_correlation(wide(x), "pearson")


def test_partial_correlations_match_inverse(wide):
    x = RNG.standard_normal((80, 4)) @ RNG.standard_normal((4, 4))
    prec = np.linalg.inv(np.corrcoef(x.T))
    for r in pp.partial_correlations(wide(x)).collect():
        want = -prec[r.i, r.j] / math.sqrt(prec[r.i, r.i] * prec[r.j, r.j])
        assert r.pcorr == pytest.approx(want, abs=1e-9)


def test_subsets_are_exact_and_repeatable(spark, wide):
    df = wide(RNG.standard_normal((100, 2)))
    got = {k: s.n for k, s in collect_keyed_stats(with_subsets(df, 100, 37, 6, 1), 2, 6).items()}
    assert got == {k: 37 for k in range(6)}
    a = with_subsets(df, 100, 37, 6, 1).rule
    assert a == with_subsets(df.repartition(5), 100, 37, 6, 1).rule
    assert a != with_subsets(df, 100, 37, 6, 2).rule
    twice = df.unionByName(df)
    with pytest.raises(ValueError, match="not unique"):
        with_subsets(twice, 200, 37, 2, 1)


def test_folds_with_gaps_in_the_ids(spark, wide):
    df = wide(RNG.standard_normal((53, 2))).withColumn("row_id", F.col("row_id") * 1000 + F.col("row_id") % 7)
    got = collect_keyed_stats(with_folds(df, 53, 5), 2, 5)
    assert [got[k].n for k in range(5)] == [11, 11, 11, 10, 10]


def test_shapes_round_trip_and_validation(spark, wide):
    x = RNG.standard_normal((6, 3))
    back = sorted((r.row_id, r.x) for r in to_wide(to_long(wide(x))).collect())
    assert np.allclose([r[1] for r in back], x)
    with pytest.raises(Exception, match="NULL, NaN or wrong width"):
        validate(wide([[1.0, float("nan")]]), 2).collect()
    edges = spark.createDataFrame([(0, 2, 5.0)], "i INT, j INT, v DOUBLE")
    m = np.array([r.x for r in edges_to_square_rows(edges, "v", 3, 1.0).orderBy("i").collect()])
    assert np.array_equal(m, [[1, 0, 5], [0, 1, 0], [5, 0, 1]])


def test_wide_tables_are_standardised_without_a_square_matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, (6, 4100))
    x[:, 7] = 1.0
    rows = [(k, [float(v) for v in r], "x") for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id BIGINT, x ARRAY<DOUBLE>, tag STRING")
    got = pp.standardise(df).orderBy("row_id").collect()
    sd = np.where(x.std(0) > 0, x.std(0), 1.0)
    assert np.allclose(np.array([r.x for r in got]), (x - x.mean(0)) / sd) and got[0].tag == "x"


def test_samples_of_another_width_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], "row_id BIGINT, x ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="does not have 2 values"):
        collect_stats(df)


def test_ranks_of_many_groups_use_slices_of_the_whole_table(spark):
    rows = [(v, k, float(k % 7)) for v in range(6) for k in range(50)]
    df = spark.createDataFrame(rows, "var_id int, row_id long, value double")
    got = average_rank(df, "value", ["var_id"], 50, rows_per_slice=10).collect()
    one = [r[2] for r in rows[:50]]
    want = [sum(y < x for y in one) + (sum(y == x for y in one) + 1) / 2 for x in one]
    assert {(r.var_id, r.row_id): r["rank"] for r in got} == {(v, k): want[k] for v, k, _ in rows}
