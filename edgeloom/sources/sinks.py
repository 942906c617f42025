"""Writers. Parquet edge tables are the native form; CSV is an export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.matrix import check_dense, edges_to_square_rows, named
from edgeloom.sources.readers import exists


def write_edges(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    edges.write.mode(mode).parquet(path)


def write_square_csv(edges: DataFrame, value: str, p: int, path: str, diagonal: float = 0.0) -> None:
    """A dense square CSV with a header row and no index (size checked)."""
    check_dense(p, "a square CSV")
    rows = edges_to_square_rows(edges, value, p, diagonal)
    cols = [F.col("x")[k].alias(str(k)) for k in range(p)]
    rows.orderBy("i").select(*cols).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_run(edges: DataFrame, p: int, out_dir: str, stem: str, inference: bool = True) -> list[str]:
    """``{stem}_pvalues``, ``_zscores`` and ``_adjacency`` (adjacency only for point estimators)."""
    outputs = [("adjacency", "is_edge", 0.0)]
    if inference:
        outputs = [("pvalues", "p_value", 1.0), ("zscores", "z", 0.0), *outputs]
    paths = []
    for name, value, diagonal in outputs:
        path = f"{out_dir}/{stem}_{name}.csv"
        table = edges.withColumn(value, F.col(value).cast("double"))
        write_square_csv(table, value, p, path, diagonal)
        paths.append(path)
    return paths


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_named_matrix(edges: DataFrame, variables: DataFrame, path: str) -> None:
    """Long labelled matrix ``name_i, name_j, ...``."""
    named(edges, variables).drop("i", "j").write.mode("overwrite").csv(path, header=True)


def write_replicate(data, path: str) -> None:
    """One simulated replicate below ``path/topology=/seed=``."""
    base = f"{path}/topology={data.topology}/n={data.n}/p={data.p}/seed={data.seed}"
    data.samples.write.mode("overwrite").parquet(f"{base}/samples")
    data.true_edges.write.mode("overwrite").parquet(f"{base}/true_edges")
    data.theta_edges.write.mode("overwrite").parquet(f"{base}/theta_edges")


def write_prior(prior: DataFrame, variables: DataFrame, path: str) -> None:
    prior.write.mode("overwrite").parquet(f"{path}/prior")
    variables.write.mode("overwrite").parquet(f"{path}/variables")


def append_missing(results: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append only the rows whose key is not stored yet; returns what was appended.

    Spark's commit protocol publishes files only when the job succeeds, so an
    interrupted run leaves no partial result.
    """
    spark = results.sparkSession
    new = results
    if exists(spark, path):
        new = missing_tasks(results, spark.read.parquet(path), keys)
    new.write.mode("append").parquet(path)
    return new


def append_csv(rows: DataFrame, path: str) -> None:
    """Append to a table of CSV files. Every file has the header, so a reader of the folder sees it as one."""
    rows.write.mode("append").option("header", True).csv(path)


def missing_tasks(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a stored result (keys compared null-safely)."""
    have = done.select(*[F.col(k).alias(f"_d_{k}") for k in keys]).distinct()
    cond = [grid[k].eqNullSafe(have[f"_d_{k}"]) for k in keys]
    return grid.join(have, cond, "left_anti")


def rebuild_summary(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Existing rows not covered by the new keys, followed by the new rows."""
    if existing is None:
        return new
    keys = ["benchmark", "method", "config", "seed_offset"]
    if "seed_offset" not in existing.columns:
        existing = existing.withColumn("seed_offset", F.lit(0))
    usable = [k for k in keys if k in new.columns and k in existing.columns]
    if not {"method", "seed_offset"} <= set(usable):
        usable = ["benchmark"]
    return missing_tasks(existing, new, usable).unionByName(new, allowMissingColumns=True)
