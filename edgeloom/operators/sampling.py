"""Exact random subsets and folds of the samples, without moving the samples.

A subset is the ``k`` rows with the smallest hash of their id. Hashes are
uniform, so the k-th smallest lies in a narrow known band: one pass counts the
rows below the band and keeps only the rows inside it, whose order then gives
the exact threshold. Membership is a comparison made where the rows lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.hashing import rank_hash_array, set_salts

_HASHES = 2**62


@dataclass(frozen=True)
class Subsets:
    """Membership of row ids in hash-defined subsets."""

    salts: tuple[tuple[int, int], ...]
    last: tuple[tuple[int, int], ...]  # (hash, row_id) of the last member

    @property
    def n_groups(self) -> int:
        return len(self.salts)

    def groups(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for s, ((hi, lo), (h_last, id_last)) in enumerate(zip(self.salts, self.last)):
            h = rank_hash_array(ids, hi, lo)
            idx = np.flatnonzero((h < h_last) | ((h == h_last) & (ids <= id_last)))
            if idx.size:
                yield s, idx


@dataclass(frozen=True)
class Folds:
    """Contiguous folds by row id; ``edges`` are the last ids of all but the last fold."""

    edges: tuple[int, ...]

    @property
    def n_groups(self) -> int:
        return len(self.edges) + 1

    def groups(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        fold = np.searchsorted(np.asarray(self.edges), ids, side="left")
        for f in np.unique(fold):
            yield int(f), np.flatnonzero(fold == f)


@dataclass(frozen=True)
class Grouped:
    """Samples with a rule that assigns each row to any number of groups."""

    samples: DataFrame
    rule: Subsets | Folds


def draw_subsets(samples: DataFrame, n: int, size: int, n_sets: int, seed: int = 0) -> Subsets:
    """``n_sets`` random subsets of exactly ``size`` of the ``n`` rows."""
    if not 0 < size <= n:
        raise ValueError(f"subset size must be in 1..{n}; got {size}")
    salts = tuple(set_salts(seed, s) for s in range(n_sets))
    sigmas = 8.0
    while True:
        share = size / n
        slack = sigmas * math.sqrt(n * share * (1.0 - share)) + 8.0
        low = max(0, int((size - slack) / n * _HASHES))
        high = min(_HASHES, int((size + slack) / n * _HASHES) + 1)
        last = _order_within(samples, salts, size, low, high)
        if len(last) == n_sets:
            return Subsets(salts, tuple(last[s] for s in range(n_sets)))
        if low == 0 and high == _HASHES:
            raise ValueError("row_id is not unique: an exact subset size cannot be drawn")
        sigmas *= 8.0  # a subset's threshold fell outside the band: widen it


def _order_within(samples: DataFrame, salts, size: int, low: int, high: int):
    def scan(batches):
        below = np.zeros(len(salts), dtype=np.int64)
        for batch in batches:
            ids = batch.column("row_id").to_numpy(zero_copy_only=False)
            for s, (hi, lo) in enumerate(salts):
                h = rank_hash_array(ids, hi, lo)
                below[s] += int((h < low).sum())
                idx = np.flatnonzero((h >= low) & (h < high))
                if idx.size:
                    yield pa.RecordBatch.from_pydict(
                        {"s": pa.array(np.full(idx.size, s, np.int32)), "h": pa.array(h[idx]),
                         "row_id": pa.array(ids[idx]), "below": pa.nulls(idx.size, pa.int64())}
                    )
        k = len(salts)
        yield pa.RecordBatch.from_pydict(
            {"s": pa.array(np.arange(k, dtype=np.int32)), "h": pa.array(np.full(k, -1)),
             "row_id": pa.nulls(k, pa.int64()), "below": pa.array(below)}
        )

    scanned = samples.select(F.col("row_id").cast("bigint").alias("row_id")).mapInArrow(
        scan, "s INT, h BIGINT, row_id BIGINT, below BIGINT"
    )
    # inside the band: about 16 standard deviations of a binomial count per subset
    w = Window.partitionBy("s").orderBy("h", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    per_id = scanned.groupBy("s", "h", "row_id").agg(
        F.sum(F.coalesce("below", F.lit(0))).alias("below"),
        F.count("row_id").alias("c"),
    )
    ranked = per_id.withColumn("at", F.sum(F.col("below") + F.col("c")).over(w))
    rows = ranked.filter((F.col("h") >= 0) & (F.col("at") == size)).collect()  # n_sets rows
    return {int(r["s"]): (int(r["h"]), int(r["row_id"])) for r in rows}


def with_subsets(samples: DataFrame, n: int, size: int, n_sets: int, seed: int = 0) -> Grouped:
    return Grouped(samples, draw_subsets(samples, n, size, n_sets, seed))


def with_folds(samples: DataFrame, n: int, folds: int) -> Grouped:
    """Contiguous folds of (nearly) equal size by ``row_id`` order."""
    sizes = [n // folds + (1 if f < n % folds else 0) for f in range(folds)]
    cuts = list(np.cumsum(sizes)[:-1])
    lo, hi = samples.agg(F.min("row_id"), F.max("row_id")).first()
    if hi - lo + 1 == n:  # dense ids: the edges follow by arithmetic
        return Grouped(samples, Folds(tuple(int(lo + c - 1) for c in cuts)))
    return Grouped(samples, Folds(tuple(_id_at_rank(samples, int(c), lo, hi, n) for c in cuts)))


def _id_at_rank(samples: DataFrame, rank: int, lo: int, hi: int, n: int) -> int:
    """The ``rank``-th smallest id, by narrowing a histogram of the id range."""
    bins = 4096
    while True:
        step = max(1, -(-(hi - lo + 1) // bins))
        inside = samples.filter(F.col("row_id").between(lo, hi))
        counts = (
            inside.groupBy(F.expr(f"(row_id - {lo}) div {step}").alias("b"))
            .agg(F.count(F.lit(1)).alias("c")).orderBy("b").collect()
        )  # at most `bins` rows
        for r in counts:
            if rank <= r["c"]:
                lo, hi = lo + r["b"] * step, min(hi, lo + (r["b"] + 1) * step - 1)
                break
            rank -= r["c"]
        if step == 1:
            return int(lo)


def smallest(df: DataFrame, key: Column, m: int, order: list[str]) -> DataFrame:
    """The ``m`` rows of smallest ``key`` (0 .. 2**62 - 1), ties by ``order``, without sorting the table.

    The m-th smallest key is found by histograms of its bits, twelve at a time
    (4,096 counts a pass); the rest is a comparison. Only rows that tie there are sorted.
    """
    if m <= 0:
        return df.limit(0)
    keyed, lo, bits, below = df.withColumn("_key", key), 0, 62, 0
    k = F.col("_key")
    while bits:
        step = max(0, bits - 12)
        part = F.expr(f"shiftright(_key - {lo}, {step})").alias("b")
        counts = keyed.filter((k >= lo) & (k <= lo + 2**bits - 1)).groupBy(part).agg(F.count(F.lit(1)).alias("c")).orderBy("b").collect()
        for r in counts:
            if below + r["c"] >= m:
                break
            below += r["c"]
        else:
            return df  # no more than m rows
        lo, bits = lo + (r["b"] << step), step
        if below + r["c"] == m:
            return keyed.filter(k <= lo + 2**bits - 1).drop("_key")
    ties = keyed.filter(k == lo).orderBy(*order).limit(m - below)
    return keyed.filter(k < lo).unionByName(ties).drop("_key")
