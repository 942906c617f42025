"""Spelling variants: words one edit apart, by composing a vocabulary acceptor with a one-edit transducer.

Two words one edit apart agree before or behind the middle of the shorter one.
So each word goes to the partitions that a state names which its first half
reaches from the initial state of the vocabulary's acceptor, or its second half
from that of the reversed one. In a partition the rests of the words make a
minimised acceptor A, and the pairs are what A o T o A accepts, T being the
transducer that changes or inserts one letter. A partition with many words is
divided by the halves of its rests in the same way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.storage import discard, stored, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
CHANGED = 97  # one run of a document in so many, by its hash, lacks a letter
MIN_LETTERS, MIN_COUNT = 5, 3
HELD = 500_000  # distinct words a task counts before it passes its counts on
WORDS = 4096  # of a partition; above the 58 + 58 * 58 rests that a middle of one letter allows
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of every word with enough letters and occurrences in whole texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                low = text.as_buffer().to_pybytes().translate(_LOWER).decode()
                for run in RUN.findall(low):
                    h = zlib.crc32(run.encode(), prefix)
                    if h % CHANGED == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= min_letters:
                        held[run] = held.get(run, 0) + 1
                if len(held) > HELD:
                    yield out()
        yield out()

    counts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of partitions, each divided: the first half of the rest goes to ``head``, or the second to ``tail``.

    ``width`` is the length of the shorter word's rest; a rest longer by one
    belongs to a word with a letter more.
    """
    w, rest = F.col("width"), F.col("rest")
    half = F.floor(w / 2).cast("int")
    cut = F.length(rest) - (w - half)
    front = rows.select(
        F.concat("head", F.substring(rest, F.lit(1), half)).alias("head"), "tail", (w - half).alias("width"),
        F.substring(rest, half + 1, F.length(rest)).alias("rest"), "n")
    back = rows.select(
        "head", F.concat(F.substring(rest, cut + 1, F.length(rest)), "tail").alias("tail"), half.alias("width"),
        F.substring(rest, F.lit(1), cut).alias("rest"), "n")
    return front.unionByName(back)


def partitions(words: DataFrame, most: int = WORDS) -> DataFrame:
    """``head, tail, width, rest, n``: rests of words that may be one edit apart, by the states they start and end in.

    Every pair of words one edit apart is in one partition where the place of
    the edit (the first letter that differs) lies in the rest: before the tail,
    if there is one. Partitions of more than ``most`` words are divided on;
    each turn halves the rests, so there are at most log2 of the longest word.
    """
    letters = F.length("word")
    whole = words.select(
        F.lit("").alias("head"), F.lit("").alias("tail"), F.explode(F.array(letters, letters - 1)).alias("width"),
        F.col("word").alias("rest"), "n")
    rows, turn = _halves(whole), 0
    key = ["head", "tail", "width"]
    done, held = [], []
    while True:
        rows = stored(rows, f"partitions-{turn}")
        held.append(rows)
        big = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size_")).filter((F.col("size_") > most) & (F.col("width") > 1))
        big = stored(big.select(*key), "large")
        if big.isEmpty():
            discard(big)
            done.append(rows)
            break
        # few, for each holds more than ``most`` rows; a partition's rows stay where they are
        done.append(rows.join(big, key, "left_anti"))
        rows, turn = _halves(rows.join(big, key, "left_semi")), turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out._held = held
    return out


class Acceptor:
    """The smallest deterministic acceptor of some words, given in order."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        register: dict[tuple, int] = {}
        path, last = [0], ""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:  # equal states below the common part become one
                state = path.pop()
                kind = (self.final[state], *sorted(self.arcs[state].items()))
                self.arcs[path[-1]][last[len(path) - 1]] = register.setdefault(kind, state)

        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            settle(common)
            for letter in word[common:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        settle(0)


def one_edit(a: Acceptor, width: int, inside: bool) -> Iterator[tuple[str, str]]:
    """``u, v``: pairs that A o T o A accepts, u of ``width`` letters, v with one changed or one more.

    A changed pair comes in both orders. An inserted letter stands at the first
    place where the words differ; ``inside`` leaves out those that only append.
    """
    todo = [(0, 0, "", "", False)]  # state of u, of v, what was read of each, whether the edit is made
    while todo:
        p, q, u, v, edited = todo.pop()
        if edited:
            if a.final[p] and a.final[q] and len(u) == width:
                yield u, v
            few, many = (p, q) if len(a.arcs[p]) <= len(a.arcs[q]) else (q, p)
            for letter in a.arcs[few]:
                if letter in a.arcs[many]:
                    todo.append((a.arcs[p][letter], a.arcs[q][letter], u + letter, v + letter, True))
            continue
        for letter, state in a.arcs[p].items():
            todo.append((state, state, u + letter, u + letter, False))
            for other, far in a.arcs[p].items():
                if other != letter:
                    todo.append((state, far, u + letter, u + other, True))
            if len(u) == width:
                if a.final[p] and not inside and a.final[state]:
                    yield u, u + letter
                continue
            for follow, near in a.arcs[p].items():  # u goes on with another letter than the inserted one
                if follow != letter and follow in a.arcs[state]:
                    todo.append((near, a.arcs[state][follow], u + follow, u + letter + follow, True))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and partition: how many near words it has there, and the best of them."""
    key, rests, out = None, {}, []

    def solve() -> None:
        head, tail, width = key
        if len(rests) < 2 or all(len(r) != width for r in rests):
            return
        found: dict[str, tuple[int, int, str]] = {}

        def meet(u: str, v: str) -> None:
            count, n, best = found.get(u, (0, 0, ""))
            found[u] = (count + 1, *min((n, best), (-rests[v], v)))

        for u, v in one_edit(Acceptor(list(rests)), width, bool(tail)):
            meet(u, v)
            if len(v) > width:
                meet(v, u)
        out.extend((head + u + tail, c, n, head + b + tail) for u, (c, n, b) in found.items())

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "near", "minus_n", "best"])

    for batch in batches:
        for *k, rest, n in zip(*(batch.column(c).to_pylist() for c in ("head", "tail", "width", "rest", "n")), strict=True):
            if k != key:
                solve() if key else None
                key, rests = k, {}
            rests[rest] = n
        if len(out) > 50_000:
            yield packed()
    if key:
        solve()
    yield packed()


def _followed(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word that following forms from each word leads to.

    Each turn doubles the steps that are covered. A form is at least twice as
    frequent as its word, so there are no rings and the turns are few.
    """
    up = stored(forms.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, up = up, stored(up.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not up.filter("moved").isEmpty()
        discard(last)
        up_path, up = up, up.select("word", "root")
        up._scratch = up_path._scratch
        if not moved:
            return up


def spelling_variants(
    docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, most: int = WORDS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word of ``docs`` (doc_id, text).

    A word's form is its most frequent near word (one letter inserted, deleted
    or changed), if that is at least twice as frequent; its root is where forms
    lead. Ties go to the smaller word by code point.

    Null or empty text has no words. A null doc_id is written as nothing before
    the colon of the hash. Rows that repeat count each. Very long texts and
    words are taken whole. No words give no rows; other columns are ignored.
    """
    words = stored(vocabulary(docs, min_letters, min_count), "vocabulary")
    parts = partitions(words, most)
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    key = ["head", "tail", "width"]
    sorted_ = parts.repartition(n, *key).sortWithinPartitions(*key, "rest")
    near = sorted_.mapInArrow(_near, "word string, near bigint, minus_n bigint, best string")
    best = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus_n", "best")).alias("b"))
    forms = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("b.minus_n") >= 2 * F.col("n"), F.col("b.best")).alias("form"),
        F.when(-F.col("b.minus_n") >= 2 * F.col("n"), -F.col("b.minus_n")).alias("form_n")), "near")
    discard(words, *parts._held)
    roots = _followed(forms)
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spelling_variants`` of whole ``documents``; nulls, repeated rows and empty tables as stated there."""
    return spelling_variants(table(spark, sf_dir, "documents"))
