"""Matrices and graphs that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.gram import correlation_edges
from edgeloom.operators.matrix import from_columns

RHO = 0.8  # chain coefficient of the derived matrices
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_SCALE = [14.4, 26000.0, 0.032, 0.026]  # makes the four measures comparable
LINE_ID = (
    "(((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey) * 64"
    " + cast(l_quantity as bigint)"
)
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chain(samples: DataFrame) -> DataFrame:
    """``y_0 = x_0; y_j = 0.8 y_(j-1) + x_j``: dependence along a chain.

    For independent inputs the precision matrix of the result is tridiagonal,
    so the true graph is known: pairs with ``j = i + 1``.
    """
    zero = F.array().cast("array<double>")
    step = lambda acc, v: F.array_append(
        acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) * RHO + v
    )
    return samples.withColumn("x", F.aggregate("x", zero, step))


def embeddings_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x")
    )


def chain_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(embeddings_matrix(spark, sf_dir))


def labelled_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return chain(
        e.select(
            F.col("vec_id").alias("row_id"),
            F.col("embedding").cast("array<double>").alias("x"),
            F.array(F.col("label").cast("int")).alias("keys"),
        )
    )


def line_id() -> Column:
    """``LINE_ID``; where it leaves 63 bits (order keys from about 1.8 million on), a hash of the same keys.

    Both are non-negative. Two of n hashed rows share an id with a chance of
    about n^2 / 2^64: 7e-5 for 36 million rows.
    """
    order, line, part, supplier = (F.col(c).cast("bigint") for c in LINE_KEYS[:4])
    exact = F.try_add(F.try_multiply(order, F.lit(8)), line)
    for scale, key in ((1_000_000, part), (10_000, supplier), (64, F.col("l_quantity").cast("bigint"))):
        exact = F.try_add(F.try_multiply(exact, F.lit(scale)), key)
    hashed = F.xxhash64(*LINE_KEYS).bitwiseAND(F.lit(2**63 - 1))
    known = F.lit(True)
    for c in LINE_KEYS:
        known = known & F.col(c).isNotNull()
    # most that do not fit are known by their order key: an overflow that is caught costs far more than a comparison
    beyond = (order >= 1_802_000) & (line >= 0) & (part >= 0) & (supplier >= 0) & (F.col("l_quantity") >= 0)
    return F.when(known, F.when(beyond, hashed).otherwise(F.coalesce(exact, hashed)))


def line_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four measures of every line item.

    The generated ``(order, line)`` repeats, so part, supplier and quantity
    complete the row id.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        line_id().alias("row_id"),
        F.array(*[F.col(c).cast("double") / s for c, s in zip(LINE_MEASURES, LINE_SCALE)]).alias("x"),
    )


def line_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over the four measures, as plain column arithmetic."""
    df = line_matrix(spark, sf_dir).select("row_id", F.col("x")[0].alias("y0"), "x")
    for k in range(1, 4):
        df = df.withColumn(f"y{k}", F.col(f"y{k-1}") * RHO + F.col("x")[k])
    return df.select("row_id", F.array("y0", "y1", "y2", "y3").alias("x"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users x event types: an integer matrix with many ties."""
    counts = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(*[F.count(F.when(F.col("event_type") == t, 1)).alias(t) for t in EVENT_TYPES])
    )
    return from_columns(counts, EVENT_TYPES, "user_id")


def correlation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of chain variables: ``i, j, corr``."""
    return correlation_edges(chain_matrix(spark, sf_dir), 64)


def threshold_graph(spark: SparkSession, sf_dir: str, cut: float = 0.5) -> DataFrame:
    """Edges ``i, j, w`` with ``w = |corr| > cut``."""
    return correlation_graph(spark, sf_dir).select(
        "i", "j", F.abs("corr").alias("w")
    ).filter(F.col("w") > cut)


def variables(spark: SparkSession, p: int) -> DataFrame:
    return spark.range(p).select(
        F.col("id").cast("int").alias("var_id"), F.concat(F.lit("d"), F.col("id")).alias("var_name")
    )
