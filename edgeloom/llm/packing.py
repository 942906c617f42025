"""Packing token sequences of documents into rows of a fixed length, by exact complements.

Only lengths matter to a packing, and there are at most ``limit`` of them. So
the plan is made from a histogram: patterns of lengths, each used many times.
The pieces themselves are numbered by length where they lie and take the places
that the plan gives their numbers; they are never brought together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm import text as tx
from edgeloom.llm.storage import stored, table
from edgeloom.llm.tokens import encoder

LIMIT = 4096
END = 1


class _Stock:
    """Lengths still available, with the number of pairs of them for each sum."""

    def __init__(self, counts: np.ndarray):
        self.n = len(counts)
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.pairs = np.zeros(2 * self.n, np.int64)  # unordered pairs of available lengths by their sum
        for a in np.flatnonzero(self.left):
            partners = np.flatnonzero(self.left[a:]) + a
            if self.left[a] < 2:
                partners = partners[1:]
            self.pairs[a + partners] += 1

    def take(self, a: int, k: int) -> None:
        before = self.left[a]
        self.left[a] -= k
        if before >= 2 and self.left[a] < 2:
            self.pairs[2 * a] -= 1
        if self.left[a] == 0:
            self.pairs[a + np.flatnonzero(self.left)] -= 1

    def largest(self, gap: int) -> int:
        """The greatest available length that fits, 0 if none does."""
        fits = np.flatnonzero(self.left[:gap + 1])
        return int(fits[-1]) if len(fits) else 0

    def pair(self, total: int) -> list[int]:
        """Two available lengths of that sum, the greater one as great as can be."""
        if total < 2 or total >= len(self.pairs) or not self.pairs[total]:
            return []
        a = np.arange(max(1, total - self.n + 1), total // 2 + 1)
        ok = (self.left[a] > 0) & (self.left[total - a] > 0) & ((2 * a != total) | (self.left[a] > 1))
        a = int(a[ok.argmax()])
        return [total - a, a]

    def exact(self, gap: int) -> list[int]:
        """One, two or three available lengths that fill the gap, if there are such."""
        if gap < self.n and self.left[gap]:
            return [gap]
        two = self.pair(gap)
        if two:
            return two
        c = np.arange(min(gap - 2, self.n - 1), 0, -1)
        c = c[(self.left[c] > 0) & (gap - c < len(self.pairs))]
        for first in c[self.pairs[gap - c] > 0].tolist():
            self.take(first, 1)
            two = self.pair(gap - first)
            self.take_back(first)
            if two:
                return [first, *two]
        return []

    def take_back(self, a: int) -> None:
        if self.left[a] == 0:
            self.pairs[a + np.flatnonzero(self.left)] += 1
        self.left[a] += 1
        if self.left[a] == 2:
            self.pairs[2 * a] += 1


def plan(counts: np.ndarray, limit: int = LIMIT) -> dict[str, np.ndarray]:
    """Where the pieces of each length go; ``counts[x]`` pieces have length x.

    A sequence begins with the greatest length left. As soon as one, two or
    three lengths fill its gap exactly they close it; until then the greatest
    length that fits goes in (what fits best). The pattern that comes out is
    used as often as the counts allow, so each pattern uses up a length, and
    there are a few patterns for each length however many pieces there are.

    A run of the result covers pieces ``rank .. rank + times * each - 1`` of one
    length: ``each`` of them per sequence, in ``times`` sequences from
    ``sequence`` on, from ``offset`` on.
    """
    stock, used, sequence, runs = _Stock(counts), np.zeros(limit + 1, np.int64), 0, []
    top = limit
    while (top := stock.largest(top)):
        gap, picks = limit, {}

        def put(a: int, k: int, picks: dict = picks) -> None:
            stock.take(a, k)
            picks[a] = picks.get(a, 0) + k

        while gap:
            most = stock.largest(gap)
            if not most:
                break
            few = 3 * most < gap  # then no three lengths can fill it
            fill = [] if few else stock.exact(gap)
            if fill:
                for a in fill:
                    put(a, 1)
                break
            k = min(int(stock.left[most]), max(1, (gap - 3 * most) // most)) if few else 1
            put(most, k)
            gap -= k * most
        times = 1 + min(int(stock.left[a]) // k for a, k in picks.items())
        offset = 0
        for a, k in picks.items():
            if times > 1:
                stock.take(a, (times - 1) * k)
            runs.append((a, int(used[a]), k, times, sequence, offset))
            used[a] += k * times
            offset += k * a
        sequence += times
    columns = np.array(runs, np.int64).reshape(-1, 6).T
    names = ("length", "rank", "each", "times", "sequence", "offset")
    order = np.lexsort((columns[1], columns[0]))
    return {n: c[order] for n, c in zip(names, columns, strict=True)}


def pieces(docs: DataFrame, definition: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, shard, nth`` of every piece; with ``ids`` on request.

    ``nth`` numbers the pieces of one length in their shard, the task that made them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(shared.value), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            for row, data, offsets in tx.slices(batch.column(1)):
                ids, first = enc.encode(data, offsets)
                tokens = np.diff(first) + 1
                number = -(-tokens // limit)
                doc = np.repeat(np.arange(len(tokens)), number)
                nth_piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = nth_piece * limit
                length = np.minimum(tokens[doc] - start, limit)
                own = []
                for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                    lo, hi = first[d] + s, min(first[d] + s + n, first[d + 1])
                    x = ids[lo:hi]
                    own.append(x if hi - lo == n else np.append(x, np.uint32(end)))
                order = np.argsort(length, kind="stable")
                sorted_, nth = length[order], np.empty(len(length), np.int64)
                begins = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(begins, len(sorted_)))
                nth[order] = np.arange(len(sorted_)) - np.repeat(begins, sizes) + seen[sorted_]
                seen[sorted_[begins]] += sizes
                out = [batch.column(0).slice(row, len(tokens)).take(pa.array(doc)), pa.array(nth_piece.astype(np.int32)),
                       pa.array(start), pa.array(length),
                       pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                       pa.array(np.full(len(doc), shard, np.int32)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "nth"]
                if keep_ids:
                    out.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, shard int, nth bigint"
        + (", ids array<int>" if keep_ids else ""))


def _places(runs, base):
    """A task that gives each (length, rank) its sequence and offset."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, before = runs.value, base.value
        starts = before[r["length"]] + r["rank"]
        for batch in batches:
            n = batch.num_columns - 1
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            at = before[length] + rank
            k = np.searchsorted(starts, at, side="right") - 1
            q = at - starts[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(r["sequence"][k] + q // r["each"][k]),
                 pa.array(r["offset"][k] + q % r["each"][k] * length)], names=[*batch.schema.names[:n], "sequence_id", "offset"])
    return place


def pack(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece of every document.

    A document is the ids of its whole text and then ``end``; it is cut every
    ``limit`` ids, the last piece may be shorter. Pieces of a sequence fill it
    from offset 0 on without gaps. ``tokenizer_file`` is read on the driver and
    broadcast (its size does not depend on the data); what the driver sees of
    the documents is a count for each length, ``limit`` numbers at most.

    Null or empty text: the one id ``end``. Rows that repeat a doc_id, or have a
    null one, are packed each for itself. Pieces of equal length are ordered by
    where they were read; any order fills as many sequences. No documents give
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    cut = stored(pieces(docs, definition, limit, end, keep_ids), "pieces")
    shards = cut.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(limit + 1, np.int64)
    for r in shards.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``limit`` rows
        counts[r.length] = r.n
    runs = spark.sparkContext.broadcast(plan(counts, limit))
    base = spark.sparkContext.broadcast(np.cumsum(counts) - counts)
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("shard", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rest = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = cut.join(before, ["shard", "length"]).select(*rest, (F.col("before") + F.col("nth")).alias("rank"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(*rest).schema)
    return ranked.mapInArrow(_places(runs, base), f"{kinds}, sequence_id bigint, offset bigint")


def op11_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` of whole ``documents`` into 4,096 ids; nulls, repeated rows and empty tables as stated there."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
