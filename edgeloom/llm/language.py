"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import text as tx
from edgeloom.llm.storage import table

ORDERS = (1, 2, 3)
BUCKETS = 2 ** 16
SMOOTHING = 0.5
MAX_LANGUAGES = 500  # the broadcast matrix then has 131 MB
UNKNOWN = "und"

_BASIC = 0x10000
_SPACE = 32
_TABLE: list[np.ndarray] = []


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points, their offsets per text, and the number of letters of each text.

    Letters are lower-cased; every other character counts as a space.
    """
    if not _TABLE:
        fold = np.full(_BASIC, _SPACE, dtype=np.uint32)
        for c in range(_BASIC):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(fold)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    begins = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    at = begins[offsets]
    out = _TABLE[0][np.minimum(points, _BASIC - 1)]
    rare = np.flatnonzero(points >= _BASIC)
    out[rare] = [c if chr(c).isalpha() else _SPACE for c in points[rare].tolist()]
    letters = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum(out != _SPACE, out=letters[1:])
    return out, at, letters[at[1:]] - letters[at[:-1]]


def _grams(points: np.ndarray, at: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the ``order``-grams that begin at each character, and the text of each (-1: it runs over the end)."""
    m = max(len(points) - order + 1, 0)
    h = np.full(m, order, dtype=np.uint64)
    for k in range(order):
        h = (h + points[k:m + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = owner[:m] == owner[order - 1:m + order - 1]
    return (h % np.uint64(buckets)).astype(np.int64), np.where(inside, owner[:m], -1)


def _count(orders: tuple[int, ...], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at - 1, pa.int64()), pa.array(c[at])],
                    names=["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for row, data, offsets in tx.slices(batch.column(1)):
                points, at, letters = _characters(data, offsets)
                own = langs[row:row + len(letters)]
                kinds = sorted(set(own))
                number = np.array([kinds.index(x) for x in own])
                number[letters == 0] = -1  # such texts tell nothing
                total = np.bincount(number[number >= 0], minlength=len(kinds))
                grid = np.zeros(len(kinds) * buckets, dtype=np.int64)
                for order in orders:
                    h, owner = _grams(points, at, order, buckets)
                    kind = np.where(owner >= 0, number[owner], -1)
                    ok = kind >= 0
                    grid += np.bincount(kind[ok] * buckets + h[ok], minlength=len(grid))
                for k, lang in enumerate(kinds):  # bucket -1 (at 0) counts documents
                    c = counts.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                    c[0] += total[k]
                    c[1:] += grid[k * buckets:(k + 1) * buckets]
                if len(counts) > 64:
                    yield from flush()
        yield from flush()
    return run


def fit(labelled: DataFrame, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``languages, log priors, log probabilities`` learnt from ``labelled`` (lang, text).

    Counts cover every row with a language and a letter. They are summed in
    each task, then by Spark; only the table of languages x buckets, which
    does not grow with the corpus, comes to the driver.
    """
    counted = (
        labelled.filter("lang is not null").select("lang", "text")
        .mapInArrow(_count(orders, buckets), "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    got = counted.toArrow()
    langs, which = np.unique(np.array(got["lang"].to_pylist(), dtype=object), return_inverse=True) if len(got) else ([], [])
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model is meant for {MAX_LANGUAGES} at most")
    full = np.zeros((len(langs), buckets + 1))
    if len(got):
        full[which, got["bucket"].to_numpy() + 1] = got["n"].to_numpy()
    keep = full[:, 0] > 0
    full, langs = full[keep], [x for x, k in zip(langs, keep, strict=True) if k]
    docs, grams = full[:, 0], full[:, 1:] + smoothing
    return langs, np.log(docs / docs.sum()), np.log(grams / grams.sum(axis=1, keepdims=True))


def _score(model, orders: tuple[int, ...], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, table_ = model.value
        names = np.array([*langs, UNKNOWN], dtype=object)
        for batch in batches:
            best, sure = [], []
            for _, data, offsets in tx.slices(batch.column(1)):
                points, at, letters = _characters(data, offsets)
                total = np.tile(prior, (len(letters), 1))
                for order in orders:
                    h, owner = _grams(points, at, order, buckets)
                    ok = owner >= 0
                    h, owner = h[ok], owner[ok]
                    if len(h) and len(langs):
                        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                        total[owner[first]] += np.add.reduceat(table_[h], first, axis=0)
                none = (letters == 0) | (len(langs) == 0)
                if len(langs):
                    top = total.argmax(axis=1)
                    p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                else:
                    top, p = np.zeros(len(letters), int), np.zeros(len(letters))
                best += names[np.where(none, len(langs), top)].tolist()
                sure.append(np.where(none, 0.0, p))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(best, pa.string()),
                 pa.array(np.concatenate(sure) if sure else np.zeros(0), pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, labelled: DataFrame, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (doc_id, held_out, text).

    ``score`` is the posterior probability of the language. A text that is
    null or has no letter, and every text if nothing could be learnt, is
    ``und`` with score 0. Ties go to the language that sorts first.
    """
    spark = docs.sparkSession
    langs, prior, table_ = fit(labelled, orders, buckets)
    # languages x buckets numbers, at most MAX_LANGUAGES x BUCKETS whatever the corpus
    model = spark.sparkContext.broadcast((langs, prior, np.ascontiguousarray(table_.T, dtype=np.float32)))
    return docs.select("doc_id", "text", "held_out").mapInArrow(
        _score(model, orders, buckets), "doc_id bigint, held_out boolean, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return identify(docs.drop("lang"), docs.filter(fold != 0).select("lang", "text"))
