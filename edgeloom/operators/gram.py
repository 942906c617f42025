"""Sufficient statistics: count, mean vector and centred cross-product matrix.

Every estimator reads the samples only through these. Each task folds its rows
into one block per key with BLAS, blocks are merged with the pairwise update of
Chan, Golub and LeVeque (1979), which does not cancel when means are large, and
no sample is ever shuffled. A key that holds most of the rows is therefore
combined on the map side like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.matrix import check_dense, width
from edgeloom.operators.sampling import Grouped

_CELLS_PER_BLOCK = 65_536
_MAX_HELD_CELLS = 32_000_000  # 256 MB of doubles: the most that a task accumulates at once
_TEMP_CELLS = 2_000_000  # of one product inside a task
_FAN_IN = 64
_TREE_LEVELS = 6  # more than any scan needs; sizes of joins may be overstated without bound

_BLOCK_SCHEMA = (
    "key INT, chunk INT, src INT, n BIGINT, mean ARRAY<DOUBLE>, m2 ARRAY<DOUBLE>"
)


@dataclass(frozen=True)
class Stats:
    """``m2`` is the sum of centred cross products (not divided by ``n``)."""

    n: int
    mean: np.ndarray
    m2: np.ndarray

    @property
    def p(self) -> int:
        return len(self.mean)

    def covariance(self, ddof: int = 0) -> np.ndarray:
        return self.m2 / (self.n - ddof)

    def second_moment(self) -> np.ndarray:
        return self.m2 / self.n + np.outer(self.mean, self.mean)

    def correlation(self) -> np.ndarray:
        """Correlations; a constant variable has zeros in its row and column."""
        scale = np.sqrt(np.diag(self.m2))
        safe = np.where(scale > 0, scale, 1.0)
        return self.m2 / np.outer(safe, safe)


def merge(a: Stats | None, b: Stats) -> Stats:
    if a is None:
        return b
    n = a.n + b.n
    d = b.mean - a.mean
    return Stats(n, a.mean + d * (b.n / n), a.m2 + b.m2 + np.outer(d, d) * (a.n * b.n / n))


def _chunk_rows(p: int) -> int:
    return max(1, _CELLS_PER_BLOCK // max(p, 1))


def _key_groups(batch: pa.RecordBatch):
    """Row indices of every key in a batch with a ``keys ARRAY<INT>`` column."""
    keys = batch.column("keys")
    flat = keys.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))
    order = np.argsort(flat, kind="stable")
    present, starts = np.unique(flat[order], return_index=True)
    return zip(present, np.split(owner[order], starts[1:]))


@dataclass(frozen=True)
class Unit:
    """What one scan accumulates: chunks ``lo .. hi - 1`` of keys ``first .. last - 1`` (all keys if ``last`` is None)."""

    lo: int
    hi: int
    first: int = 0
    last: int | None = None


def units(p: int, keys: int | None = 1, limit: int | None = None) -> list[Unit]:
    """The p x p blocks of ``keys`` groups, cut so that a scan holds ``limit`` cells at most.

    Whole keys go together while they fit; a matrix above the limit is cut into
    bands of rows. ``keys=None``: their number is not known beforehand, so a
    band is what a single key may hold, and tasks pass blocks on before a
    further key would not fit.
    """
    limit = _MAX_HELD_CELLS if limit is None else limit
    step = _chunk_rows(p)
    chunks = -(-p // step)
    whole = limit // (p * p)
    if whole >= 1:
        if keys is None:
            return [Unit(0, chunks)]
        return [Unit(0, chunks, k, min(k + whole, keys)) for k in range(0, keys, whole)]
    band = max(1, limit // (step * p))
    ranges = [(lo, min(lo + band, chunks)) for lo in range(0, chunks, band)]
    if keys is None:
        return [Unit(lo, hi) for lo, hi in ranges]
    return [Unit(lo, hi, k, k + 1) for k in range(keys) for lo, hi in ranges]


class _Band:
    """Count, means and some rows of the centred cross products of one key, updated in place."""

    def __init__(self, p: int, lo: int, hi: int):
        self.n, self.mean, self.lo = 0, np.zeros(p), lo
        self.m2 = np.zeros((hi - lo, p))

    def add(self, rows: np.ndarray) -> None:
        k = len(rows)
        mean = rows.mean(axis=0)
        c = rows - mean
        d = mean - self.mean
        weight = self.n * k / (self.n + k)
        some = max(1, _TEMP_CELLS // len(self.mean))
        for at in range(0, len(self.m2), some):  # what BLAS returns is a temporary of bounded size
            own = slice(self.lo + at, self.lo + min(at + some, len(self.m2)))
            here = self.m2[at:at + some]
            here += c[:, own].T @ c
            if weight:
                here += np.outer(d[own] * weight, d)
        self.n += k
        self.mean += d * (k / self.n)


def _fold(p: int, groups_of, unit: Unit, limit: int | None = None):
    """A task that folds samples into blocks of ``unit``; it never holds more than ``limit`` cells of them."""
    step = _chunk_rows(p)
    limit = _MAX_HELD_CELLS if limit is None else limit
    lo, hi = unit.lo * step, min(unit.hi * step, p)

    def blocks(held: dict[int, _Band], src: int):
        for key, band in held.items():
            for c in range(unit.lo, unit.hi):
                rows = band.m2[c * step - lo:(c + 1) * step - lo]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([key], pa.int32()),
                        "chunk": pa.array([c], pa.int32()),
                        "src": pa.array([src], pa.int32()),
                        "n": pa.array([band.n], pa.int64()),
                        "mean": pa.array([band.mean], pa.list_(pa.float64())),
                        "m2": pa.array([rows.ravel()], pa.list_(pa.float64())),
                    }
                )

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        src = ctx.partitionId() if ctx else 0
        held: dict[int, _Band] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            widths = pc.list_value_length(batch.column("x"))
            if pc.any(pc.not_equal(widths, p)).as_py() or batch.column("x").null_count:
                raise ValueError(f"a sample does not have {p} values")
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for key, idx in groups_of(batch):
                key = int(key)
                if unit.last is not None and not unit.first <= key < unit.last:
                    continue
                if key not in held and held and (len(held) + 1) * (hi - lo) * p > limit:
                    yield from blocks(held, src)
                    held = {}
                held.setdefault(key, _Band(p, lo, hi)).add(x if idx is None else x[idx])
        yield from blocks(held, src)

    return run


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    n = pdf["n"].to_numpy(dtype=float)
    means = np.stack(pdf["mean"].to_numpy())
    total = n.sum()
    mean = n @ means / total
    p = means.shape[1]
    d = means - mean
    chunk = int(pdf["chunk"].iloc[0])
    first = chunk * _chunk_rows(p)
    rows = len(pdf["m2"].iloc[0]) // p
    m2 = np.sum(np.stack(pdf["m2"].to_numpy()), axis=0).reshape(rows, p)
    m2 = m2 + (d[:, first : first + rows] * n[:, None]).T @ d
    return pd.DataFrame(
        {
            "key": [int(pdf["key"].iloc[0])],
            "chunk": [chunk],
            "src": [int(pdf["src"].iloc[0]) // _FAN_IN],
            "n": [int(total)],
            "mean": [mean],
            "m2": [m2.ravel()],
        }
    )


def scan_tasks(df: DataFrame) -> int:
    """About how many tasks read ``df``: its size as the optimizer knows it, in scan splits, or the cores if there are more."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // split))


def stat_blocks(samples: DataFrame | Grouped, p: int, keyed: bool = False) -> DataFrame:
    """Merged blocks ``key, chunk, n, mean, m2``.

    Groups come from a ``keys ARRAY<INT>`` column (``keyed=True``) or from the
    rule of a ``Grouped`` table; a row may belong to several. The merge is a
    tree as deep as the number of scan tasks asks for, so that one merge group
    reads ``_FAN_IN`` blocks at most however many tasks ran.

    Blocks above ``_MAX_HELD_CELLS`` in all (wide tables, many groups) are cut
    into units, each accumulated by a scan of its own: the samples are read once
    a unit and still never shuffled, and a task's memory depends on neither the
    width nor the number of groups.
    """
    x = F.col("x").cast("array<double>").alias("x")
    keys: int | None = 1
    if isinstance(samples, Grouped):
        rule, samples = samples.rule, samples.samples
        keys = rule.n_groups
        cols = [x, F.col("row_id").cast("bigint").alias("row_id")]
        groups_of = lambda b: rule.groups(b.column("row_id").to_numpy(zero_copy_only=False))
    elif keyed:
        cols = [x, F.col("keys").cast("array<int>").alias("keys")]
        groups_of, keys = _key_groups, None
    else:
        cols = [x]
        groups_of = lambda b: [(0, None)]
    scans = [samples.select(*cols).mapInArrow(_fold(p, groups_of, u), _BLOCK_SCHEMA) for u in units(p, keys)]
    partial = scans[0]
    for scan in scans[1:]:
        partial = partial.unionByName(scan)
    return merge_blocks(partial, scan_tasks(samples))


def merge_blocks(partial: DataFrame, tasks: int) -> DataFrame:
    """One block per key and chunk; ``tasks`` is how many blocks of one there may be, which the tree's depth follows."""
    levels = 0
    while tasks > _FAN_IN ** (levels + 1) and levels < _TREE_LEVELS:
        levels += 1
    for _ in range(levels):
        partial = (
            partial.withColumn("_b", F.floor(F.col("src") / _FAN_IN))
            .groupBy("key", "chunk", "_b")
            .applyInPandas(_combine, _BLOCK_SCHEMA)
        )
    return partial.groupBy("key", "chunk").applyInPandas(_combine, _BLOCK_SCHEMA)


def assemble(pdf: pd.DataFrame) -> Stats:
    """One key's blocks to dense statistics."""
    pdf = pdf.sort_values("chunk")
    mean = np.asarray(pdf["mean"].iloc[0], dtype=float)
    m2 = np.concatenate([np.asarray(m, dtype=float) for m in pdf["m2"]]).reshape(len(mean), -1)
    return Stats(int(pdf["n"].iloc[0]), mean, (m2 + m2.T) / 2.0)


def collect_stats(samples: DataFrame, p: int | None = None) -> Stats:
    """Statistics of the whole table on the driver (p x p doubles, size checked)."""
    p = p or width(samples)
    check_dense(p, "the driver-side cross-product matrix")
    pdf = stat_blocks(samples, p).toPandas()
    if pdf.empty:
        raise ValueError("the sample table is empty")
    return assemble(pdf)


def collect_keyed_stats(samples: DataFrame, p: int, max_keys: int) -> dict[int, Stats]:
    """Statistics per key on the driver; ``max_keys * p * p`` doubles are bounded."""
    check_dense(int(p * max_keys**0.5) + 1, "driver-side statistics per key")
    pdf = stat_blocks(samples, p, keyed=True).toPandas()
    return {int(k): assemble(g) for k, g in pdf.groupby("key")}


def gram_rows(samples: DataFrame, p: int, keyed: bool = False) -> DataFrame:
    """Distributed rows ``key, i, n, mean, x``: row ``i`` of the centred cross products."""
    step = _chunk_rows(p)
    row = F.col("pos") + F.col("chunk") * step
    cut = F.transform(
        F.sequence(F.lit(0), (F.size("m2") / p).cast("int") - 1),
        lambda r: F.slice("m2", r * p + 1, p),
    )
    return (
        stat_blocks(samples, p, keyed)
        .select("key", "chunk", "n", "mean", F.posexplode(cut).alias("pos", "x"))
        .select("key", row.cast("int").alias("i"), "n", "mean", "x")
    )


def pair_moments(samples: DataFrame, p: int, keyed: bool = False) -> DataFrame:
    """Edge table of cross-products: ``[key,] i, j, n, cij, cii, cjj`` for ``i < j``.

    Works for any p: the diagonal (p rows) is joined to the rows, nothing is
    collected.
    """
    rows = gram_rows(samples, p, keyed)
    diag = rows.select(
        "key", F.col("i").alias("j"), F.element_at("x", F.col("i") + 1).alias("cjj")
    )
    flat = rows.select(
        "key", "i", "n", F.element_at("x", F.col("i") + 1).alias("cii"),
        F.posexplode("x").alias("j", "cij"),
    ).filter(F.col("i") < F.col("j"))
    out = flat.join(diag, ["key", "j"]).select("key", "i", "j", "n", "cij", "cii", "cjj")
    return out if keyed else out.drop("key")


def correlation_edges(samples: DataFrame, p: int | None = None) -> DataFrame:
    """Pearson correlation of every pair (``corr``; NULL when a side is constant)."""
    p = p or width(samples)
    m = pair_moments(samples, p)
    return m.select(
        "i", "j", F.try_divide(F.col("cij"), F.sqrt(F.col("cii") * F.col("cjj"))).alias("corr")
    )


def covariance_edges(samples: DataFrame, p: int | None = None, ddof: int = 1) -> DataFrame:
    """Covariance of every pair with divisor ``n - ddof``."""
    p = p or width(samples)
    return pair_moments(samples, p).select(
        "i", "j", (F.col("cij") / (F.col("n") - ddof)).alias("cov")
    )


def matrix_edges(spark, matrix: np.ndarray, value: str) -> DataFrame:
    """Edge table of a dense symmetric matrix already on the driver (size checked)."""
    p = matrix.shape[0]
    check_dense(p, "an edge table built on the driver")
    i, j = np.triu_indices(p, k=1)
    table = pa.table(
        {
            "i": pa.array(i, pa.int32()),
            "j": pa.array(j, pa.int32()),
            value: pa.array(np.ascontiguousarray(matrix[i, j], dtype=float), pa.float64()),
        }
    )
    return spark.createDataFrame(table)
