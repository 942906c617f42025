"""Approximate nearest neighbours: inverted multi-index with exact reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.storage import stored, table

SAMPLE = 20_000  # documented bound: vectors that the codebooks are fitted on, taken by hash of vec_id
ROUNDS = 12
ROWS_PER_CELL = 4
MAX_CENTROIDS = 256  # of each half, so there are 65,536 cells at most
VISIT = 0.55  # share of all vectors that a query's cells must hold
K = 10


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (double) of the rows that take part.

    Left out: null ids, null or zero vectors, vectors with null or non-finite
    components, and those of another length than most.
    """
    v = F.col("embedding").cast("array<double>")
    named = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0))
    widths = named.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return named.filter(F.size("v") == F.lit(widths["w"] if widths else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm from spread-out rows (``x`` in a fixed order); empty cells take the farthest rows."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = (c ** 2).sum(1) - 2 * x @ c.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = np.argsort(-(d[np.arange(len(x)), at] + (x ** 2).sum(1)), kind="stable")
            c[empty] = x[far[:len(empty)]]
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def codebooks(vectors: DataFrame, rows: int, centroids: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves, each fitted in a task of its own on a bounded sample."""
    share = min(1.0, SAMPLE / max(rows, 1))
    half = F.size("v") / 2
    taken = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(2 ** 30)) < F.lit(int(share * 2 ** 30)))
    parts = taken.select("v", F.floor(half).cast("int").alias("m"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    parts = parts.select("half", F.when(F.col("half") == 0, F.slice("v", 1, F.col("m"))).otherwise(
        F.slice("v", F.col("m") + 1, F.size("v") - F.col("m"))).alias("x"))

    def fit(part: pa.Table) -> pa.Table:
        c = kmeans(_matrix(part["x"].combine_chunks()), centroids)
        return pa.table({"half": pa.array([part["half"][0].as_py()] * len(c), pa.int32()),
                         "x": pa.array([*c], pa.list_(pa.float64()))})

    got = parts.groupBy("half").applyInArrow(fit, "half int, x array<double>").toArrow().to_pylist()
    return tuple(np.array(sorted(r["x"] for r in got if r["half"] == h)) for h in (0, 1))


def nearest_cells(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells in order of the sum of the two halves' distances, until they hold ``want`` vectors.

    A heap holds the frontier of centroid pairs: a pair enters once both its
    predecessors (one step nearer in either half) have left.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out, have, width = [(s1[0] + s2[0], 0, 0)], [], 0, len(s2)
    reached = [0] * len(s1)  # pairs of each row that have left the heap
    while heap and have < want:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        cell = int(o1[i]) * width + int(o2[j])
        if counts[cell]:
            out.append(cell)
            have += int(counts[cell])
        if i + 1 < len(s1) and reached[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ c.T + (c ** 2).sum(1), 0)


def _assign(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1, c2 = books.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            m = x.shape[1] // 2
            cell = _distances(x[:, :m], c1).argmin(1) * len(c2) + _distances(x[:, m:], c2).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["vec_id", "v", "cell"])
    return run


def _route(books, layout, want: int):
    """Queries with the shards that hold their cells, and the cells as a bit string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1, c2 = books.value
        counts, first, parts = layout.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            m = x.shape[1] // 2
            d1, d2 = _distances(x[:, :m], c1), _distances(x[:, m:], c2)
            shards, bits = [], []
            for k in range(len(x)):
                cells = nearest_cells(d1[k], d2[k], counts, want)
                shards.append(sorted({s for c in cells for s in range(first[c], first[c] + parts[c])}))
                mask = np.zeros(len(counts), dtype=bool)
                mask[cells] = True
                bits.append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shards, pa.list_(pa.int32())), pa.array(bits, pa.binary())],
                names=["vec_id", "v", "shards", "bits"])
    return run


def _search(k: int, cells: int):
    """Rows come sorted by shard, the vectors of a shard before its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, xs, cs, ready = None, [], [], [], None
        for batch in batches:
            at = np.array(batch.column(0))
            is_query = np.array(batch.column(1))
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (is_query[1:] != is_query[:-1])]) if len(at) else []
            for lo, hi in zip(edges, [*edges[1:], len(at)], strict=True):
                part = batch.slice(lo, hi - lo)
                if at[lo] != shard:
                    shard, ids, xs, cs, ready = at[lo], [], [], [], None
                x = _matrix(part.column(3))
                if not is_query[lo]:
                    ids.append(np.array(part.column(2)))
                    xs.append(x)
                    cs.append(np.array(part.column(4)))
                    continue
                if not ids:
                    continue
                if ready is None:
                    ready = np.concatenate(ids), np.concatenate(xs), np.concatenate(cs)
                yield _best(np.array(part.column(2)), x, part.column(5), ready, k, cells)
    return run


def _best(qid: np.ndarray, q: np.ndarray, bits: pa.Array, ready, k: int, cells: int) -> pa.RecordBatch:
    ids, x, cell = ready
    out = []
    near = _distances(q, x)
    slack = 1e-9 * (1 + (q ** 2).sum(1) + (x ** 2).sum(1).max())
    for n in range(len(q)):
        seen = np.unpackbits(np.frombuffer(bits[n].as_py(), np.uint8), count=cells).astype(bool)
        ok = np.flatnonzero(seen[cell] & (ids != qid[n]))
        if not len(ok):
            continue
        d = near[n, ok]
        if len(ok) > k:  # rounding may not decide at the edge: all that could belong are measured exactly
            ok = ok[d <= np.partition(d, k - 1)[k - 1] + slack[n]]
        exact = np.sqrt(((x[ok] - q[n]) ** 2).sum(1))
        first = np.lexsort((ids[ok], exact))[:k]
        out += [(qid[n], i, s) for i, s in zip(ids[ok][first], exact[first], strict=True)]
    a = list(zip(*out, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.float64())],
                                      names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = K, visit: float = VISIT) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for each query.

    Both inputs have ``vec_id, embedding``. Each half of the vectors is
    quantised by its own codebook; a cell is a pair of centroids. A query
    visits cells by the sum of the two distances until they hold ``visit`` of
    all vectors, and what they hold is ranked by exact Euclidean distance, ties
    by vec_id. Rows with the query's own vec_id are no candidates.

    Cells are laid out in shards of bounded size in the order of their
    centroids, large cells over several shards, so a common vector fills no
    task. A shard holds its vectors while the queries stream past.
    ``usable`` says which vectors take no part; without any the result is empty.
    """
    spark = vectors.sparkSession
    base = usable(vectors)
    rows = base.count()
    if rows == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    centroids = int(min(MAX_CENTROIDS, max(16, round(math.sqrt(rows / ROWS_PER_CELL)))))
    c1, c2 = codebooks(base, rows, centroids)
    books = spark.sparkContext.broadcast((c1, c2))  # MAX_CENTROIDS rows each
    index = stored(base.mapInArrow(_assign(books), "vec_id bigint, v array<double>, cell int"), "index")
    cells = len(c1) * len(c2)
    counts = np.zeros(cells, dtype=np.int64)
    for r in index.groupBy("cell").count().collect():  # 65,536 rows at most
        counts[r["cell"]] = r["count"]
    per_shard = min(16_384, max(512, rows // 64))
    parts = np.maximum(1, -(-counts // per_shard))
    first, at, room = np.zeros(cells, dtype=np.int64), 0, per_shard
    for c in np.flatnonzero(counts):
        if parts[c] > 1 or counts[c] > room:
            at, room = at + 1, per_shard
        first[c] = at
        room -= counts[c] if parts[c] == 1 else per_shard
        if parts[c] > 1:
            at, room = at + int(parts[c]), per_shard
    layout = spark.sparkContext.broadcast((counts, first.tolist(), parts.tolist()))
    where = spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in np.flatnonzero(counts)], "cell int, first int, parts int")
    placed = index.join(F.broadcast(where), "cell").select(  # 65,536 rows at most
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).alias("shard"), F.lit(False).alias("query"),
        "vec_id", "v", "cell", F.lit(None).cast("binary").alias("bits"))
    asked = usable(queries).filter(F.size("v") == F.lit(c1.shape[1] + c2.shape[1])).mapInArrow(
        _route(books, layout, max(math.ceil(visit * rows), min(rows, 4 * k))), "vec_id bigint, v array<double>, shards array<int>, bits binary")
    sent = asked.select(F.explode("shards").alias("shard"), F.lit(True).alias("query"), "vec_id", "v",
                        F.lit(None).cast("int").alias("cell"), "bits")
    found = (
        placed.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "query")
        .mapInArrow(_search(k, cells), "query_id bigint, vec_id bigint, score double")
    )
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
