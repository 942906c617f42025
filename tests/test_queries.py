"""Every registered SQL twin against its query, on the smallest tables."""

import inspect
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from edgeloom.functions import mix31, mix31_int
from edgeloom.plans import inputs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(rows):
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = _norm([r[c] for c in cols] for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got, "the query is vacuous"
    assert got == _norm([r[k] for k in at] for r in rel.fetchall())


@pytest.mark.parametrize("name", ["npn_skeptic", "grouped_fits", "ggl_edges", "communities_modularity",
                                  "communities_label_propagation", "gsea_prerank", "knockout_metrics"])
def test_queries_without_sql_return_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() >= 63


def test_queries_without_sql_do_the_full_work(spark, monkeypatch):
    from edgeloom.operators import diffusion, enrichment, estimators, stars
    from edgeloom.plans import queries

    class Called(Exception):
        pass

    def arguments(module, name, query):
        whole = inspect.signature(getattr(module, name))

        def note(*args, **options):
            bound = whole.bind(*args, **options)
            bound.apply_defaults()
            raise Called(bound.arguments)

        with monkeypatch.context() as m, pytest.raises(Called) as caught:
            m.setattr(module, name, note)
            QUERIES[query](spark, SF)
        return caught.value.args[0]

    for query in ("stability_selection", "adaptive_threshold"):
        est = arguments(estimators.PIGLassoEstimator, "fit", query)["self"]
        assert (est.Q, est.n_lambda) == (50, 20)
    assert arguments(stars, "stars_select", "stars_desparsified")["n_subsamples"] == 20
    assert arguments(enrichment, "prerank", "gsea_prerank")["permutations"] == 1000
    for name, query in (("evaluate_knockouts", "knockout_metrics"), ("diffusion_task", "diffusion_task")):
        times = arguments(diffusion, name, query)["t_grid"]
        assert len(times) == 80 and (times[0], times[-1]) == (1e-4, 3.0)
    rows = QUERIES["grouped_fits"](spark, SF)
    labels = spark.read.parquet(f"{SF}/embeddings.parquet").select("label").distinct().count()
    assert rows.count() == labels * queries.P * (queries.P - 1) // 2 and {"key", "i", "j", "z"} <= set(rows.columns)


def test_line_ids_beyond_63_bits(spark, tmp_path):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    far = li.withColumn("l_orderkey", F.col("l_orderkey") + 9_000_000).withColumn("l_partkey", F.col("l_partkey") + 2_000_000)
    li.unionByName(far).write.parquet(str(tmp_path / "lineitem.parquet"))
    ids = [r.row_id for r in inputs.line_matrix(spark, str(tmp_path)).collect()]
    exact = {r.row_id for r in li.select(F.expr(inputs.LINE_ID).alias("row_id")).collect()}
    assert len(set(ids)) == len(ids) == 2 * li.count() and min(ids) >= 0 and exact <= set(ids)
    assert QUERIES["standardized_lines"](spark, str(tmp_path)).count() == len(ids)
    assert QUERIES["ensemble_ci"](spark, str(tmp_path)).count() == 6


def test_hash_of_large_ids_is_exact(spark):
    ids = [2**31 * k - d for k in (2**23, 2**31 + 5, 2**32) for d in (1, 2)]
    df = spark.createDataFrame([(x,) for x in ids], "x BIGINT")
    assert [r[0] for r in df.select(mix31(F.col("x"), 5)).collect()] == [mix31_int(x, 5) for x in ids]
