"""Ordered running aggregates that do not need one task per group.

A plain window over a group sorts the whole group in one task. The helpers
here switch to a two-level scheme when the group is larger than a task should
hold: rows are range-partitioned, each slice is aggregated, the slice totals
(one row per slice) are accumulated, and the running value inside a slice is
offset by what came before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.session import checkpointed

ROWS_PER_SLICE = 1_000_000
HOT_SHARE = 1000  # a value above 1/HOT_SHARE of all rows is looked up by broadcast

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, offset: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.coalesce(offset, F.lit(0)) + inside
    chosen = F.least if kind == "min" else F.greatest
    return chosen(F.coalesce(offset, inside), inside)


def running(
    df: DataFrame,
    order: str,
    columns: dict[str, tuple[str, str]],
    part: list[str] | None = None,
    rows: int | None = None,
    descending: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add inclusive running aggregates.

    ``columns`` maps a new column to ``(source column, 'sum'|'min'|'max')``.
    ``df`` must hold one row per ``part + order`` (pre-aggregate ties first).
    ``rows`` is an upper bound on the row count of the whole table, counted if
    it is not given; above ``rows_per_slice`` the sliced form is used.
    """
    part = part or []
    rows = df.count() if rows is None else rows
    sort = F.col(order).desc() if descending else F.col(order).asc()
    slices = max(1, math.ceil(rows / rows_per_slice))
    if slices == 1:
        w = Window.partitionBy(*part).orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*", *[_AGG[kind](src).over(w).alias(new) for new, (src, kind) in columns.items()]
        )

    # The slice id must be the same for both uses below, also after a lost
    # executor: it is fixed in reliable storage.
    tagged = checkpointed(
        df.repartitionByRange(slices, *[F.col(c) for c in part], sort).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    before = (
        Window.partitionBy(*part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        tagged.groupBy(*part, "_slice")
        .agg(*[_AGG[kind](src).alias(f"_t_{new}") for new, (src, kind) in columns.items()])
        .select(
            *part,
            "_slice",
            *[
                _AGG[kind](f"_t_{new}").over(before).alias(f"_o_{new}")
                for new, (_, kind) in columns.items()
            ],
        )
    )
    inside = (
        Window.partitionBy(*part, "_slice")
        .orderBy(sort)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = tagged.join(offsets, [*part, "_slice"])
    return joined.select(
        *df.columns,
        *[
            _merge(kind, F.col(f"_o_{new}"), _AGG[kind](src).over(inside)).alias(new)
            for new, (src, kind) in columns.items()
        ],
    )


def lookup(
    left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join ``left`` to its per-value table ``right`` without a hot partition.

    ``right`` has one row per key and ``weight``, the number of left rows with
    that key; ``rows`` is the number of all left rows. Keys heavier than
    ``rows / HOT_SHARE`` number fewer than ``HOT_SHARE``, so that part of the
    table is broadcast; the rest joins by shuffle, where no key is heavy.
    """
    keep = right.drop(weight)
    if rows <= rows_per_slice:
        return left.join(keep, keys)
    heavy_limit = rows / HOT_SHARE
    heavy = right.filter(F.col(weight) > heavy_limit).drop(weight)
    light = right.filter(F.col(weight) <= heavy_limit).drop(weight)
    hot = left.join(F.broadcast(heavy), keys)
    cold = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return hot.unionByName(cold)


def average_rank(
    df: DataFrame,
    value: str,
    part: list[str],
    rows: int,
    out: str = "rank",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Average rank of ``value`` within ``part`` (ties share their mean rank).

    ``rows`` bounds the size of the largest group. Up to one slice a single
    window suffices; beyond it ties are counted first, so a value repeated in a
    third of the rows travels as one row.
    """
    if rows <= rows_per_slice:
        group = Window.partitionBy(*part).orderBy(value)
        ties = Window.partitionBy(*part, value)
        return df.withColumn(
            out,
            F.rank().over(group) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0),
        )
    counts = df.groupBy(*part, value).agg(F.count(F.lit(1)).alias("_c"))
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_c"), F.lit(0))).first()
    cumulative = running(
        counts, value, {"_cum": ("_c", "sum")}, part, distinct, rows_per_slice=rows_per_slice
    )
    ranks = cumulative.select(
        *part, value, "_c", (F.col("_cum") - (F.col("_c") - 1) / F.lit(2.0)).alias(out)
    )
    return lookup(df, ranks, [*part, value], "_c", total, rows_per_slice)
