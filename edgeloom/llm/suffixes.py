"""Repeated byte strings by a distributed suffix order (difference cover).

``suffix_order`` is the difference-cover algorithm on strings of letters: name
the sampled triples by their order, recurse on the names, merge the remaining
suffixes. ``repeats`` removes what occurs twice in a corpus. Three things keep
its work in proportion to what repeats, not to the corpus:

* Every window of ``LENGTH`` bytes has an anchor, the place of its smallest
  hash of ``GRAM`` bytes. Equal windows have equal anchors, so windows whose
  anchor occurs once are unique. A run is the windows in a row that share an
  anchor; its context is the bytes they cover.
* Equal contexts are one text with a count. A context that occurs twice is
  repeated throughout.
* What is left are different contexts around equal anchors. They are cut into
  blocks that are aligned to the anchor, so equal windows meet the same block
  borders, and the blocks are the letters of the suffix order. Contexts in
  which nothing long enough occurs twice are left out of it. Neighbours in the
  order are compared on the prefixes that decide all windows between two
  borders at once; where these disagree, shorter pieces and then single windows
  are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm import text as tx
from edgeloom.llm.storage import discard, stored, table
from edgeloom.operators.prefix import lookup, running

LENGTH = 400
BLOCK = 100  # divides LENGTH; the longest prefix compared, LENGTH + BLOCK, is 5 letters: two recursions
GRAM = 96
PIECES = (10, 1)  # windows in a row that are compared together where blocks do not settle them; they divide BLOCK
SLICE_ROWS = 100_000
_END = -1  # comes before every letter

# --- the suffix order of strings of letters ---


def _names(rows: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """One row per distinct ``keys`` with, for each new column, how many rows of smaller keys count in ``sums``."""
    ties = stored(
        rows.groupBy(*keys).agg(*[F.sum(F.expr(what).cast("bigint")).alias(new) for new, what in sums.items()])
        .withColumn("key", F.struct(*keys)), "ties")
    summed = running(ties, "key", {f"to_{new}": (new, "sum") for new in sums}, rows=ties.count(), rows_per_slice=SLICE_ROWS)
    return summed.select(*keys, *[(F.col(f"to_{new}") - F.col(new)).alias(new) for new in sums])


def suffix_order(letters: DataFrame, levels: int) -> DataFrame:
    """``seq, pos, rank`` for ``letters`` (seq bigint, pos int from 0, letter bigint >= 0).

    ``rank`` orders suffixes by their first ``3 ** levels`` letters at least:
    it counts the suffixes that come before, and of those that agree so far
    none, some or all. So equal prefixes of that length or less stand together.
    A string that ends sorts before its continuations. One string has to fit in a task; there may be
    any number of them, and any number of equal triples: those are combined
    before they are ordered.
    """
    if levels == 0:
        return letters.select("seq", "pos", F.col("letter").alias("rank"))
    at = Window.partitionBy("seq").orderBy("pos")
    follow = stored(letters.select(
        "seq", "pos", "letter", F.lead("letter", 1, _END).over(at).alias("l1"), F.lead("letter", 2, _END).over(at).alias("l2")), "letters")
    triple = ["letter", "l1", "l2"]
    kind = F.col("pos") % 3
    sampled = follow.filter(kind != 0)
    named = sampled.join(_names(sampled, triple, {"name": "1"}), triple)
    inner = suffix_order(
        named.select((F.col("seq") * 2 + kind - 1).alias("seq"), F.floor(F.col("pos") / 3).cast("int").alias("pos"),
                     F.col("name").alias("letter")), levels - 1)
    order = inner.select(
        F.floor(F.col("seq") / 2).cast("bigint").alias("seq"),
        (F.col("pos") * 3 + F.pmod("seq", F.lit(2)) + 1).cast("int").alias("pos"), F.col("rank").alias("r"))
    ranked = follow.join(order, ["seq", "pos"], "left")
    full = stored(ranked.select(
        "*", F.lead("r", 1, _END).over(at).alias("r1"), F.lead("r", 2, _END).over(at).alias("r2"), kind.alias("kind")), "ranked")
    # a remaining suffix meets those of the first kind by (letter, rank of the rest), those of the second by two letters and the rest
    one = _names(full.filter("kind in (0, 1)"), ["letter", "r1"], {"a0": "if(kind = 0, 1, 0)", "a1": "if(kind = 1, 1, 0)"})
    two = _names(full.filter("kind in (0, 2)"), ["letter", "l1", "r2"], {"b0": "if(kind = 0, 1, 0)", "b2": "if(kind = 2, 1, 0)"})
    own = _names(full.filter("kind <> 0"), ["r"], {"own": "1"})
    rest = (
        full.filter("kind = 0").join(one, ["letter", "r1"]).join(two, ["letter", "l1", "r2"])
        .select("seq", "pos", (F.col("a0") + F.col("a1") + F.col("b2")).alias("rank"))
    )
    first = full.filter("kind = 1").join(one, ["letter", "r1"]).join(own, "r").select("seq", "pos", (F.col("own") + F.col("a0")).alias("rank"))
    second = full.filter("kind = 2").join(two, ["letter", "l1", "r2"]).join(own, "r").select("seq", "pos", (F.col("own") + F.col("b0")).alias("rank"))
    return rest.unionByName(first).unionByName(second)


def with_neighbours(rows: DataFrame, columns: list[str], slices: int) -> DataFrame:
    """``rows`` (with ``rank``) and, for each column, whether the row before or after in the order has the same value: ``same_*``.

    Rows are ranged over slices; each slice also sees the last row before it
    and the first row after it.
    """
    by = ["rank", "seq", "pos"]
    placed = stored(
        rows.repartitionByRange(slices, *by).withColumn("slice", F.spark_partition_id()).withColumn("own", F.lit(True)), "placed")
    key = F.struct(*by, *columns)
    ends = placed.groupBy("slice").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))  # a row for each slice
    w = Window.orderBy("slice")
    beside = ends.select("slice", F.lag("hi").over(w).alias("hi"), F.lead("lo").over(w).alias("lo"))
    guests = beside.select("slice", F.explode(F.array("hi", "lo")).alias("g")).filter("g is not null")
    extra = guests.select("slice", "g.*", F.lit(False).alias("own"))
    both = placed.unionByName(extra, allowMissingColumns=True)
    inside = Window.partitionBy("slice").orderBy(*by)
    same = [
        (F.coalesce(F.col(c) == F.lag(c).over(inside), F.lit(False)) | F.coalesce(F.col(c) == F.lead(c).over(inside), F.lit(False)))
        .alias(f"same_{c}") for c in columns]
    return both.select("*", *same).filter("own").drop("own", "slice")


# --- windows, anchors and contexts ---


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each ``width`` neighbours: running minima of blocks from both sides."""
    n = len(h)
    x = np.concatenate([h, np.full(-n % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(prefix: tx.Prefix, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``text, anchor, low, high, key`` of the texts in one buffer: runs of windows that share an anchor, first to last window start."""
    ends = offsets[1:]
    n = int(offsets[-1])
    if n < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    start = np.arange(n - gram + 1)
    h = prefix.of(start, start + gram)
    # 40 bits of hash decide, then the place, of which the remainder is enough; the leftmost wins a tie
    width = length - gram + 1
    low = _lowest((h >> np.uint64(24) << np.uint64(24)) | (start % 2 ** 24).astype(np.uint64), width)
    owner = np.repeat(np.arange(len(ends)), np.diff(offsets))[:len(low)]
    window = np.flatnonzero(np.arange(len(low)) + length <= ends[owner])  # inside one text
    at = (low[window] & np.uint64(2 ** 24 - 1)).astype(np.int64)
    at += (window - at + 2 ** 24 - 1) // 2 ** 24 * 2 ** 24
    if not len(at):
        return anchors(prefix, np.zeros(2, dtype=np.int64))
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[window][1:] != owner[window][:-1])])
    last = np.r_[first[1:] - 1, len(at) - 1]
    return owner[window[first]], at[first], window[first], window[last], h[at[first]]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, data, offsets in tx.slices(batch.column(column)):
        for k in range(len(offsets) - 1):
            yield row + k, data[offsets[k]:offsets[k + 1]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


_RUN = "k1 bigint, k2 bigint, anchor bigint, digest bigint, low bigint, n int, off int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2 = np.array(batch.column(0)), np.array(batch.column(1))
        for row, data, offsets in tx.slices(batch.column(2)):
            p = tx.Prefix(data)
            text, at, low, high, key = anchors(p, offsets)
            digest = p.of(low, high + LENGTH) ^ tx.mix((at - low).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[row + text]), pa.array(k2[row + text]), _signed(key), _signed(digest), pa.array(low - offsets[text]),
                 pa.array((high - low + 1).astype(np.int32)), pa.array((at - low).astype(np.int32))],
                names=[x.split()[0] for x in _RUN.split(", ")])


_CONTEXT = "seq bigint, n int, off int, body binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies of the wanted contexts of each text."""
    for batch in batches:
        out = []
        for row, data in _texts(batch, 0):
            for w in batch.column(1)[row].as_py():
                out.append((w["seq"], w["n"], w["off"], data[w["low"]:w["low"] + w["n"] + LENGTH - 1].tobytes()))
            if len(out) > 2000:
                yield _context_batch(out)
                out = []
        if out:
            yield _context_batch(out)


def _context_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                      names=["seq", "n", "off", "body"])


class _Bodies:
    """The bodies of a batch of contexts in one buffer, a slice at a time: first row, prefix hashes, begin and size of each."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __iter__(self):
        for row, data, offsets in tx.slices(self.column):
            yield row, tx.Prefix(data), offsets[:-1], np.diff(offsets)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``seq, pos, letter`` of the blocks of each context, and digests of the prefixes that are compared."""
    for batch in batches:
        seq, off = np.array(batch.column(0)), np.array(batch.column(2))
        for row, p, begin, size in _Bodies(batch.column(3)):
            first = off[row:row + len(size)] % BLOCK
            count = np.maximum(size - first, 0) // BLOCK
            own = np.repeat(np.arange(len(size)), count)
            pos = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            at, room = begin[own] + first[own] + pos * BLOCK, begin[own] + size[own]
            columns = [pa.array(seq[row + own]), pa.array(pos.astype(np.int32)), pa.array((p.of(at, at + BLOCK) >> np.uint64(1)).astype(np.int64))]
            for length in (LENGTH - BLOCK, LENGTH, LENGTH + BLOCK):
                fits = at + length <= room
                columns.append(pa.array(p.of(at, np.where(fits, at + length, at)).view(np.int64), mask=~fits))
            yield pa.RecordBatch.from_arrays(columns, names=["seq", "pos", "letter", "core", "exact", "whole"])


def _pieces(size: int):
    """``seq, begin, end, core, whole`` of stretches of windows cut into pieces of ``size``.

    Pieces lie on a grid aligned to the anchor. ``core`` is a digest of the
    bytes that all windows of a whole piece share, ``whole`` of those that any
    of them covers (null where the stretch has a part of the piece only).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off, open_ = np.array(batch.column(0)), np.array(batch.column(1)), batch.column(3).to_pylist()
            for row, p, begin, sizes in _Bodies(batch.column(2)):
                parts = [
                    (k, lo, max(lo, r["begin"]), min(lo + size, r["end"]))
                    for k in range(len(sizes)) for r in open_[row + k]
                    for lo in range(r["begin"] - (r["begin"] - int(off[row + k])) % size, r["end"], size)]
                if not parts:
                    continue
                own, grid, lo, hi = np.array(parts).T
                at, full = begin[own] + grid, (lo == grid) & (hi == grid + size)
                whole = p.of(np.where(full, at, 0), np.where(full, at + size - 1 + LENGTH, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seq[row + own]), pa.array(lo), pa.array(hi), _signed(p.of(at + size - 1, at + LENGTH)),
                     pa.array(whole.view(np.int64), mask=~full)], names=["seq", "begin", "end", "core", "whole"])
    return run


def _settle(contexts: DataFrame, open_: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``seq, begin, end`` of pieces found elsewhere as a whole, and of pieces that stay open (with those they may match)."""
    each = open_.groupBy("seq").agg(F.collect_set(F.struct("begin", "end")).alias("open"))
    pieces = stored(contexts.join(each, "seq").select("seq", "off", "body", "open").mapInArrow(
        _pieces(size), "seq bigint, begin bigint, end bigint, core bigint, whole bigint"), "pieces")
    place = F.struct("seq", "begin", "end")
    wholes = pieces.filter("whole is not null").groupBy("core", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("at"))
    found = pieces.join(wholes.filter("c > 1").select("core", "whole"), ["core", "whole"]).select("seq", "begin", "end")
    if size == 1:
        return found, pieces.select("seq", "begin", "end").limit(0)
    # of equal wholes one stands for all; a core that nothing else has settles its piece
    texts = stored(wholes.select("core", "c", "at").unionByName(
        pieces.filter("whole is null").select("core", F.lit(1).cast("bigint").alias("c"), place.alias("at"))), "wholes")
    cores = texts.groupBy("core").agg(F.count(F.lit(1)).alias("texts"), F.min("c").alias("least")).filter("texts > 1 and least = 1")
    return found, texts.join(cores.select("core"), "core").select("at.*")


def _found_in_contexts(contexts: DataFrame) -> DataFrame:
    """``seq, begin, end``: window starts of each context (from its first byte, end excluded) that occur in another context."""
    cut = stored(contexts.mapInArrow(_letters, "seq bigint, pos int, letter bigint, core bigint, exact bigint, whole bigint"), "blocks")
    # contexts none of whose cores occurs in another one have no window that does
    cores = cut.filter("core is not null").groupBy("core").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).filter("lo < hi")
    hopeful = cut.join(cores.select("core"), "core", "left_semi").select("seq").distinct()
    letters = stored(cut.join(hopeful, "seq", "left_semi"), "letters")
    order = suffix_order(letters.select("seq", "pos", "letter"), 2)
    rows = letters.drop("letter").join(order, ["seq", "pos"])
    flags = stored(with_neighbours(rows, ["core", "exact", "whole"], letters.count() // SLICE_ROWS + 1), "flags")
    discard(cut, letters)
    shapes = contexts.select("seq", "n", (F.col("off") % BLOCK).alias("first"))
    # a stretch goes from one border up to the next; what comes before the first border is stretch -1
    after = flags.select("seq", (F.col("pos") - 1).alias("pos"), F.col("core").alias("next_core"), F.col("same_core").alias("next_same"))
    stretches = stored(
        after.filter("next_same").join(flags.select("seq", "pos", "whole", "same_whole"), ["seq", "pos"], "left").join(shapes, "seq")
        .select("seq", "next_core", "whole", F.coalesce("same_whole", F.lit(False)).alias("found"),
                F.when(F.col("pos") < 0, 0).otherwise(F.col("first") + F.col("pos") * BLOCK).cast("bigint").alias("begin"),
                F.least("n", F.col("first") + (F.col("pos") + 1) * BLOCK).cast("bigint").alias("end"))
        .filter("begin < end"), "stretches")
    # where some stretch with this core is not settled as a whole, windows are looked at; equal wholes are measured once
    unsettled = stretches.filter("not found").select("next_core").distinct()
    asked = stretches.join(unsettled, "next_core")
    once = asked.filter("found").groupBy("next_core", "whole").agg(F.min(F.struct("seq", "begin", "end")).alias("at")).select("at.*")
    open_ = stored(asked.filter("not found").select("seq", "begin", "end").unionByName(once), "open")
    border = flags.filter("same_exact").join(shapes, "seq").withColumn("begin", (F.col("first") + F.col("pos") * BLOCK).cast("bigint")).filter(
        "begin < n").select("seq", "begin", (F.col("begin") + 1).alias("end"))
    found = border.unionByName(stretches.filter("found").select("seq", "begin", "end"))
    for size in PIECES:
        whole, rest = _settle(contexts, open_, size)
        found, open_ = found.unionByName(whole), stored(rest, "open")
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        ids = batch.column(0)
        for row, data in _texts(batch, 1):
            gone = np.zeros(len(data) + 1, dtype=np.int64)
            for r in batch.column(2)[row].as_py() or ():
                gone[r["begin"]] += 1
                gone[r["end"] + LENGTH - 1] -= 1
            covered = np.cumsum(gone)[:-1] > 0
            kept = data[~covered].tobytes()
            spans = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
            out.append((ids[row].as_py(), len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes, null is empty. A byte goes if it is covered by a
    string of ``LENGTH`` bytes that also starts anywhere else in the corpus,
    in the same text or another; overlaps count, matches stay inside texts,
    and all are judged on the input. ``kept`` is what is left, in one piece.
    Rows are told apart by doc_id and text, so null and repeated doc_ids are
    rows like others, and a repeated row repeats all its strings. No rows give
    no rows; very long texts are taken whole; other columns are ignored.
    """
    k1 = F.xxhash64("text", F.col("doc_id").cast("bigint")).alias("k1")
    k2 = F.xxhash64(F.lit(1), F.col("doc_id").cast("bigint"), "text").alias("k2")
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", k1, k2)
    runs = stored(named.select("k1", "k2", "text").mapInArrow(_runs, _RUN), "runs")
    # equal contexts travel as one row with a count, however many texts have them; what a third of all rows
    # share (fewer than a thousand anchors or contexts can be that heavy) is looked up by broadcast
    body = ["anchor", "digest", "n", "off"]
    total = runs.count()
    kinds = stored(runs.groupBy(*body).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "low")).alias("at")), "kinds")
    anchors = kinds.groupBy("anchor").agg(
        F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("contexts"), F.count(F.lit(1)).alias("weight")).filter("rows > 1")
    texts = stored(lookup(kinds, anchors, ["anchor"], "weight", kinds.count(), 0), "distinct")
    shared = stored(lookup(runs, texts.select(*body, F.col("copies").alias("weight")), body, "weight", total, 0), "shared")
    discard(runs, kinds)
    mixed = stored(texts.filter("contexts > 1").withColumn("seq", F.monotonically_increasing_id()), "mixed")
    wanted = mixed.select("at.k1", "at.k2", F.struct("seq", "at.low", "n", "off").alias("w")).groupBy("k1", "k2").agg(
        F.collect_list("w").alias("wanted"))
    one_each = named.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    contexts = stored(one_each.select("text", "wanted").mapInArrow(_contexts, _CONTEXT), "contexts")
    found = _found_in_contexts(contexts).join(mixed.filter("copies = 1").select("seq", *body), "seq").groupBy(*body).agg(
        F.collect_list(F.struct("begin", "end")).alias("parts"), F.lit(1).cast("bigint").alias("weight"))
    # a context that occurs twice is found from its first to its last window
    whole = texts.filter("copies > 1").select(
        *body, F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("parts"), F.col("copies").alias("weight"))
    answers = stored(found.unionByName(whole), "answers")
    spans = (
        lookup(shared, answers, body, "weight", shared.count(), 0)
        .select("k1", "k2", "low", F.explode(F.coalesce("parts", F.array(
            F.struct(F.lit(0).cast("bigint").alias("begin"), F.col("n").cast("bigint").alias("end"))))).alias("p"))
        .groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("low") + F.col("p.begin")).alias("begin"), (F.col("low") + F.col("p.end")).alias("end"))).alias("spans"))
    )
    return named.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repeats`` of whole ``documents``, with the remaining bytes as ``kept_text``; odd rows as stated there.

    Where a removal ends inside a character, ``kept_text`` shows U+FFFD there; the digest is of the bytes themselves.
    """
    return repeats(table(spark, sf_dir, "documents")).withColumn("kept_text", F.col("kept").cast("string")).drop("kept")
