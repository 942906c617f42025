"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import text as tx
from edgeloom.llm.storage import table

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5  # of the score that a verbatim copy of the whole item gets
COMMON = 8  # a seed is rare if at most so many times as many documents hold it as hold the item's rarer seeds
FLOOR = 8
BLOCK_WORDS = 2_000_000  # of benchmark items searched in one pass; the broadcast index then has under 100 MB


class Items:
    """Word hashes and seeds of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int = SEED_WORDS):
        self.n, self.ids, self.words = n, [], []
        seeds, items, places = [], [], []
        for item, text in rows:
            data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            h = tx.word_hashes(data, np.array([0, len(data)]))[0]
            if not len(h):
                continue
            g = tx.gram_hashes(h, n) if len(h) >= n else tx.gram_hashes(h, len(h))
            seeds.append(g)
            items.append(np.full(len(g), len(self.ids)))
            places.append(np.arange(len(g)))
            self.ids.append(item)
            self.words.append(h)
        seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.item = (np.concatenate(items) if seeds else np.zeros(0, int))[order]
        self.place = (np.concatenate(places) if seeds else np.zeros(0, int))[order]
        self.seed, self.first = np.unique(seed[order], return_index=True)
        self.last = np.r_[self.first[1:], len(seed)].astype(int)
        self.short = sorted({len(w) for w in self.words if len(w) < n})
        self.rare = np.ones(len(seed), dtype=bool)
        self.maybe = np.zeros(2 ** 20, dtype=bool)  # a quick look before the search
        self.maybe[(self.seed & np.uint64(2 ** 20 - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a sequence of word hashes at which a seed begins, and which seed."""
        at, which = [], []
        for n in [*self.short, self.n]:
            g = tx.gram_hashes(h, n)
            near = np.flatnonzero(self.maybe[(g & np.uint64(2 ** 20 - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.seed, g[near]), max(len(self.seed) - 1, 0))
            ok = self.seed[k] == g[near] if len(self.seed) else np.zeros(len(near), bool)
            at.append(near[ok])
            which.append(k[ok])
        return np.concatenate(at), np.concatenate(which)

    def mark_rare(self, df: np.ndarray, common: int = COMMON, floor: int = FLOOR) -> None:
        """Seeds stay for an item if few documents hold them, as measured by the item's own rarer seeds.

        The measure is relative, so an item that leaked into a third of the
        corpus keeps its seeds; what is common beside them is left out.
        """
        each = np.repeat(df, self.last - self.first)
        for item in range(len(self.ids)):
            mine = np.flatnonzero(self.item == item) if len(self.ids) < 64 else self._of(item)
            limit = common * np.quantile(each[mine], 0.25, method="lower") + floor
            self.rare[mine] = each[mine] <= limit

    def _of(self, item: int) -> np.ndarray:
        if not hasattr(self, "_order"):
            self._order = np.argsort(self.item, kind="stable")
            self._at = np.searchsorted(self.item[self._order], np.arange(len(self.ids) + 1))
        return self._order[self._at[item]:self._at[item + 1]]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (Smith-Waterman, linear gaps): score, and begin and end in the window."""
    m = len(window)
    slope = GAP * np.arange(m + 1)
    best, end, row = 0, 0, np.zeros(m + 1, dtype=np.int64)
    start = np.arange(m + 1)  # where the best alignment that ends in each cell begins
    best_start = 0
    for w in item:
        sub = np.where(window == w, MATCH, MISMATCH)
        diagonal, up = row[:-1] + sub, row[1:] + GAP
        cell = np.zeros(m + 1, dtype=np.int64)
        cell[1:] = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.arange(m + 1)
        take = (diagonal >= up) & (diagonal > 0)
        origin[1:] = np.where(take, start[:-1], np.where((up > 0), start[1:], origin[1:]))
        lifted = cell - slope  # a gap along the window: running maximum of the cells before, less the way
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(m + 1), 0))
        row = peak + slope
        start = np.where(row > 0, origin[source], np.arange(m + 1))
        k = int(row.argmax())
        if row[k] > best:
            best, end, best_start = int(row[k]), k, int(start[k])
    return best, best_start, end


def find(items: Items, h: np.ndarray, least: float = LEAST) -> list[tuple[int, float, int, int]]:
    """``item, score, begin, end`` for each item of which a text holds a copy (words of the text from begin to end)."""
    at, which = items.hits(h)
    if not len(at):
        return []
    spans = [(np.arange(items.first[k], items.last[k]), a) for a, k in zip(at, which, strict=True)]
    rows = np.concatenate([r for r, _ in spans])
    place = np.repeat(at, [len(r) for r, _ in spans])
    ok = items.rare[rows]
    rows, place = rows[ok], place[ok]
    out = []
    for item in np.unique(items.item[rows]):
        words = items.words[item]
        mine = np.unique((place - items.place[rows])[items.item[rows] == item])  # where the item would begin
        reach = len(words)
        cuts = np.flatnonzero(np.diff(mine) > reach) + 1
        best = (0, 0, 0)
        for group in np.split(mine, cuts):
            lo, hi = max(0, int(group[0]) - reach // 2), min(len(h), int(group[-1]) + reach + reach // 2)
            for begin in range(lo, max(hi - reach, lo + 1), 4 * reach):  # long runs of seeds, piece by piece
                end = min(hi, begin + 6 * reach)
                s, a, b = align(words, h[begin:end])
                if s > best[0]:
                    best = (s, begin + a, begin + b)
        share = best[0] / (MATCH * len(words))
        if share >= least:
            out.append((items.ids[item], share, best[1], best[2]))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of bounded size, so what is broadcast has a bound too."""
    block, words = [], 0
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null").distinct().orderBy("item_id", "text")
    for item, text in items.toLocalIterator():
        block.append((item, text))
        words += len((text or "").split())
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def _documents_with(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        df = np.zeros(len(own.seed), dtype=np.int64)
        for batch in batches:
            for _, data, offsets in tx.slices(batch.column(0)):
                h, _, _, first = tx.word_hashes(data, offsets)
                at, which = own.hits(h)
                doc = np.searchsorted(first, at, side="right") - 1
                # seeds that run over the end of a text are no hits of it; the last words of a text are few
                ok = at + own.n <= first[doc + 1]
                pair = np.unique(doc[ok] * max(len(df), 1) + which[ok])
                np.add.at(df, pair % max(len(df), 1), 1)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(df[used], pa.int64())], names=["seed", "df"])
    return run


def index(docs: DataFrame, rows: list[tuple[int, str | None]]) -> Items:
    """A block of items with its rare seeds; every document counts in how many hold a seed."""
    items = Items(rows)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    counts = docs.select("text").mapInArrow(_documents_with(shared), "seed bigint, df bigint").groupBy("seed").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(items.seed), dtype=np.int64)
    df[counts["seed"].to_numpy()] = counts["df"].to_numpy()
    items.mark_rare(df)
    return items


def _each(items: Items, column: pa.Array, least: float) -> Iterator[tuple[int, list]]:
    for row, data, offsets in tx.slices(column):
        h, _, _, first = tx.word_hashes(data, offsets)
        at, _ = items.hits(h)
        some = np.unique(np.searchsorted(first, at, side="right") - 1)
        for k in some:
            found = find(items, h[first[k]:first[k + 1]], least)
            if found:
                yield row + int(k), found


_OUT = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint"


def _pairs(items, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            out = [(ids[k].as_py(), i, s, a, b) for k, found in _each(items.value, batch.column(1), least) for i, s, a, b in found]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=[x.split()[0] for x in _OUT.split(", ")])
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word`` of every document that holds a copy of an item.

    A document of ``docs`` (doc_id, text) and an item of ``benchmark``
    (item_id, text) meet if they share a rare seed of ``SEED_WORDS`` words
    (an item with fewer words is its own seed). The words around the seeds are
    aligned with the item's; a pair is returned if its local alignment reaches
    ``least`` of a full copy's score. The words of the document from
    ``first_word`` up to but not including ``last_word`` hold the copy.

    Null or empty texts and items share nothing. Items that share an item_id
    are compared one by one and the best alignment is returned; so are
    documents that share a doc_id. Null item_ids are left out.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for rows in _blocks(benchmark):
        items = spark.sparkContext.broadcast(index(docs, rows))  # BLOCK_WORDS bounds it
        part = named.mapInArrow(_pairs(items, least), _OUT)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], _OUT)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "last_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, with all their columns; nothing is shuffled."""
    def drop(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[k for k, _ in _each(items.value, batch.column(batch.schema.get_field_index("text")), least)]] = False
                yield batch.filter(pa.array(keep))
        return run

    for rows in _blocks(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(index(docs, rows))
        docs = docs.mapInArrow(drop(items), docs.schema)
    return docs


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
