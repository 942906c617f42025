"""Near-duplicate documents by MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm import text as tx
from edgeloom.llm.linking import connected, groups, narrowed
from edgeloom.llm.storage import bucketed, discard, packed, stored
from edgeloom.operators.prefix import lookup

STAR_TURNS = 3  # rounds of stars in the buckets of bands; what they leave open goes by rare shingles
PARITY_WORDS = 8  # of 64 bits
DOCS_A_TASK, PAIRS_A_TASK = 5000, 2000  # at least; small tables need few tasks
ROWS, BANDS = 5, 25  # a pair at similarity 0.85 shares no band once in two million, at 0.8 once in 20,000


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of a sorted set of hashes, with optimal densification.

    The range of hash values is cut into ``bins``; each bin takes its smallest
    value. An empty bin probes other bins in an order drawn for it alone, the
    same for every set, and copies the first one that is filled.
    """
    where = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    value = np.zeros(bins, dtype=np.uint64)
    filled = np.zeros(bins, dtype=bool)
    at = where[first].astype(np.int64)
    value[at], filled[at] = hashes[first], True
    out, empty, step = value.copy(), np.flatnonzero(~filled), 0
    while len(empty):
        probe = _probes(bins, step)[:, empty]
        hit = filled[probe]
        found = hit.any(axis=0)
        chosen = probe[hit.argmax(axis=0), np.arange(len(empty))]
        out[empty[found]] = value[chosen[found]]
        empty = empty[~found]
        step += 1
    return out


_PROBES: dict[tuple[int, int], np.ndarray] = {}


def _probes(bins: int, step: int, rows: int = 16) -> np.ndarray:
    if (bins, step) not in _PROBES:
        x = np.arange(step * rows * bins, (step + 1) * rows * bins, dtype=np.uint64)
        _PROBES[bins, step] = (tx.mix(x + np.uint64(0x51ED270B)) % np.uint64(bins)).astype(np.int64).reshape(rows, bins)
    return _PROBES[bins, step]


def _sets(words: int, batches: Iterator[pa.RecordBatch], out: callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for row, data, offsets in tx.slices(batch.column(1)):
            h, _, _, first = tx.word_hashes(data, offsets)
            sets = [tx.shingles(h[first[k]:first[k + 1]], words) for k in range(len(offsets) - 1)]
            yield out(ids.slice(row, len(sets)), sets)


def _parity(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((tx.mix(hashes) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """``doc_id, n, set_id, buckets, parity`` of every document.

    Set size, digest of the set, one bucket a band, and for each of some bits
    whether an odd number of members hash to it.
    """
    def emit(ids, sets):
        keys = []
        for s in sets:
            if not len(s):
                keys.append([])
                continue
            sig = signature(s, rows * bands).reshape(bands, rows)
            key = np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                key = tx.mix(key * np.uint64(0x9DDFEA08EB382D69) + sig[:, r])
            keys.append(key.view(np.int64))
        return pa.RecordBatch.from_arrays([
            ids, pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            pa.array(keys, pa.list_(pa.int64())), pa.array([_parity(s) for s in sets], pa.list_(pa.int64())),
        ], names=["doc_id", "n", "set_id", "buckets", "parity"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        lambda it: _sets(words, it, emit), "doc_id bigint, n bigint, set_id binary, buckets array<bigint>, parity array<bigint>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    def emit(ids, sets):
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=["item", "members"])

    return docs.select("doc_id", "text").mapInArrow(
        lambda it: _sets(words, it, emit), "item bigint, members binary")


def _similar(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
    return check


def _rare_buckets(sets: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """``bucket, item``: a bucket for each of an item's rarest shingles, as many as make sure of every link.

    In one order of all shingles, two sets whose similarity is enough share
    one of the first ``n - ceil(percent n / 100) + 1`` of each. With rare
    shingles first, what edits have made comes first, so these buckets are
    small where those of whole families are large.
    """
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                members = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(members), batch.column(0)[k].as_py())), pa.array(np.full(len(members), len(members))),
                     pa.array(members)], names=["item", "n", "bucket"])

    each = stored(sets.join(items, "item", "left_semi").select("item", "members").mapInArrow(
        tokens, "item bigint, n bigint, bucket bigint"), "shingles")
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"), F.count(F.lit(1)).alias("weight"))
    place = F.row_number().over(Window.partitionBy("item", "n").orderBy("df", "bucket"))
    first = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    # a shingle of a whole family is looked up by broadcast, so no task gets all its rows
    rare = lookup(each, counts, ["bucket"], "weight", each.rows_seen["rows"], 0)
    return rare.withColumn("place", place).filter(F.col("place") <= first).filter("df > 1").select(
        "bucket", "item")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of
    ``words``-word shingles (A-Z lower-cased) is at least ``percent`` / 100.
    Equal sets are one item from the start. Buckets of a banded one-permutation
    MinHash only nominate pairs, in stars; each is confirmed on the full sets.
    Documents of buckets that three rounds of stars do not settle (families in
    which many share a band and few are similar) are compared by the rare
    shingles that similar sets must share, so no link between them is lost.

    Null or empty text: an empty set, linked with nothing. Fewer words than a
    shingle: the whole sequence is the only shingle. Rows that share a doc_id
    are one node of the graph. A null doc_id stays alone: component_id is null
    and the row is kept. No rows give no rows; other columns are ignored.
    """
    seen = stored(sketches(docs, words, rows, bands), "sketches")
    named = seen.filter("doc_id is not null and n > 0")
    classes = stored(packed(
        named.groupBy("set_id").agg(F.min("doc_id").alias("item"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
                                    F.first("buckets").alias("buckets"), F.first("parity").alias("parity")),
        seen.rows_seen["rows"], DOCS_A_TASK), "classes")
    buckets = classes.select("item", F.explode("buckets").alias("bucket"))
    ready: list[DataFrame] = []

    def traits(items: DataFrame) -> DataFrame:
        if not ready:  # full sets of the documents that share any bucket with another one, and of few others
            texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
            ready.append(bucketed(_full_sets(narrowed(texts, F.col("doc_id"), items), words), "item", "sets"))
        return items.join(classes.select("item", "n", "parity"), "item")

    def verify(pairs: DataFrame) -> DataFrame:
        sets = ready[0]
        found = (
            pairs.join(sets.select(F.col("item").alias("a"), F.col("members").alias("x")), "a")
            .join(sets.select(F.col("item").alias("b"), F.col("members").alias("y")), "b")
        )
        return packed(found.select("a", "b", "x", "y"), pairs.rows_seen["rows"], PAIRS_A_TASK).mapInArrow(
            _similar(percent), "a bigint, b bigint")

    def may_link(p: str, q: str):
        sizes = 100 * F.least(f"{p}n", f"{q}n") >= percent * F.greatest(f"{p}n", f"{q}n")
        # bits of odd count that differ are no more than the members that only one of the sets has
        apart = sum((F.bit_count(F.col(f"{p}parity")[k].bitwiseXOR(F.col(f"{q}parity")[k])) for k in range(PARITY_WORDS)), F.lit(0))
        return sizes & ((100 - percent) * (F.col(f"{p}n") + F.col(f"{q}n")) >= (100 + percent) * apart)

    roots, unsettled = groups(buckets, verify, traits, may_link, turns=STAR_TURNS, most=seen.rows_seen["rows"] * bands)
    if unsettled.rows_seen["rows"]:
        rest = _rare_buckets(ready[0], unsettled.select("item").distinct(), percent)
        roots, _ = groups(rest, verify, traits, may_link, roots=roots)
    # equal sets follow their representative; rows that share an id join what each of them joins
    reps = lookup(named.select("doc_id", "set_id"), classes.select("set_id", "item", "copies"), ["set_id"], "copies",
                  seen.rows_seen["rows"], 0).select(F.col("doc_id").alias("a"), F.col("item").alias("b")).distinct()
    nodes = stored(packed(
        reps.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("b2")), seen.rows_seen["rows"], DOCS_A_TASK), "nodes")
    answer = stored(packed(_answer(seen, reps, nodes, roots), seen.rows_seen["rows"], DOCS_A_TASK), "answer")
    discard(seen, classes, roots, unsettled, nodes, *ready)
    return answer


def _answer(seen: DataFrame, reps: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    whole = nodes.join(roots.withColumnRenamed("item", "b"), "b", "left").select(
        "a", F.coalesce("root", "b").alias("root"))
    if not nodes.filter("b <> b2").isEmpty():  # a doc_id with several texts: one more pass over stars
        stars = reps.unionByName(roots.select(F.col("item").alias("a"), F.col("root").alias("b")))
        whole = connected(stars).withColumnRenamed("node", "a")
    return seen.join(whole.select(F.col("a").alias("doc_id"), "root"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("root", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"),
    )
