"""Shapes of a samples x variables matrix and of symmetric matrices.

wide   ``row_id BIGINT, x ARRAY<DOUBLE>``       one row per sample
long   ``row_id BIGINT, var_id INT, value``     one row per entry
edges  ``i INT, j INT, ...`` with ``i < j``     upper triangle of a p x p matrix
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DENSE_P = 4096  # p x p doubles of at most 134 MB may reach the driver or a task


def check_dense(p: int, what: str) -> None:
    if p > MAX_DENSE_P:
        raise ValueError(f"{what} needs a dense {p} x {p} matrix; the limit is {MAX_DENSE_P}")


def width(samples: DataFrame) -> int:
    """Number of variables, read from one row."""
    row = samples.select(F.size("x").alias("p")).first()
    if row is None:
        raise ValueError("the sample table is empty")
    return int(row["p"])


def validate(samples: DataFrame, p: int) -> DataFrame:
    """Fail the query when a sample has the wrong width or a missing value."""
    bad = F.col("x").isNull() | (F.size("x") != p) | F.exists(
        "x", lambda v: v.isNull() | F.isnan(v)
    )
    return samples.withColumn(
        "x",
        F.when(bad, F.raise_error(F.lit("a sample has a NULL, NaN or wrong width")).cast("array<double>"))
        .otherwise(F.col("x")),
    )


def from_columns(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Wide form from ordinary numeric columns."""
    return df.select(
        F.col(row_id).cast("bigint").alias("row_id"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
    )


def to_long(samples: DataFrame) -> DataFrame:
    return samples.select("row_id", F.posexplode("x").alias("var_id", "value"))


def to_wide(long: DataFrame) -> DataFrame:
    """Wide form; one group is one sample, so it holds p entries."""
    entries = F.array_sort(F.collect_list(F.struct("var_id", "value")))
    return (
        long.groupBy("row_id")
        .agg(entries.alias("_e"))
        .select("row_id", F.transform("_e", lambda e: e["value"]).alias("x"))
    )


def transpose(long: DataFrame) -> DataFrame:
    """Swap samples and variables."""
    return long.select(
        F.col("var_id").cast("bigint").alias("row_id"),
        F.col("row_id").cast("int").alias("var_id"),
        "value",
    )


def pair_grid(spark: SparkSession, p: int) -> DataFrame:
    """All pairs ``i < j`` of ``p`` variables, generated where they are used."""
    i = F.col("id").cast("int")
    return (
        spark.range(0, max(p - 1, 0))
        .select(i.alias("i"), F.explode(F.sequence(i + 1, F.lit(p - 1))).alias("j"))
    )


def symmetrise(edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Both directions of every edge, as ``node, nbr``."""
    rest = keep if keep is not None else [c for c in edges.columns if c not in ("i", "j")]
    ends = F.array(F.struct(F.col("i").alias("node"), F.col("j").alias("nbr")),
                   F.struct(F.col("j").alias("node"), F.col("i").alias("nbr")))
    return edges.select(F.explode(ends).alias("_e"), *rest).select("_e.node", "_e.nbr", *rest)


def square_rows_to_edges(rows: DataFrame, value: str = "value") -> DataFrame:
    """Upper triangle of a square matrix held as ``i, x ARRAY``."""
    return rows.select("i", F.posexplode("x").alias("j", value)).filter(F.col("i") < F.col("j"))


def edges_to_square_rows(edges: DataFrame, value: str, p: int, diagonal: float) -> DataFrame:
    """Rows ``i, x ARRAY`` of the full symmetric matrix; missing pairs are 0."""
    both = symmetrise(edges.select("i", "j", value), [value])
    entries = F.map_from_entries(F.collect_list(F.struct("nbr", value)))
    spark = edges.sparkSession
    rows = both.groupBy("node").agg(entries.alias("_m"))
    cell = lambda k: F.when(k == F.col("i"), F.lit(float(diagonal))).otherwise(
        F.coalesce(F.try_element_at(F.col("_m"), k), F.lit(0.0))
    )
    return (
        spark.range(p).select(F.col("id").cast("int").alias("i"))
        .join(rows, F.col("i") == F.col("node"), "left")
        .select("i", F.transform(F.sequence(F.lit(0), F.lit(p - 1)), cell).alias("x"))
    )


def named(edges: DataFrame, variables: DataFrame) -> DataFrame:
    """Attach variable names to both ends (``name_i``, ``name_j``)."""
    left = variables.select(F.col("var_id").alias("i"), F.col("var_name").alias("name_i"))
    right = variables.select(F.col("var_id").alias("j"), F.col("var_name").alias("name_j"))
    return edges.join(left, "i").join(right, "j")
