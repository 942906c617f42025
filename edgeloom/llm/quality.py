"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import text as tx
from edgeloom.llm.storage import table

DIMENSIONS = 2 ** 18
TRAIN_ROWS = 16_000  # documented bound: labelled rows that the fit uses, taken by hash of doc_id
SHARDS = 8
SHARD_ROWS = 2_000  # fewer labelled rows take fewer shards
UPDATES = 6_000  # of each shard at least, in so many epochs
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01

_KIND = np.ones(256, dtype=np.uint8)  # 0 space, 1 letters, digits and all above ASCII, 2 punctuation
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_SMALL = np.zeros(256, dtype=np.int64)
_SMALL[97:123] = 1


def features(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first, index, value``: the sparse rows of a run of texts.

    Tokens are runs of one kind of character: words or punctuation. Two views
    are hashed: lower-cased tokens (one and two in a row), and the forms of
    tokens (one to three in a row): upper case, capitalised, other, a word said
    again, or the punctuation itself. Values are logarithms of counts, scaled
    so that each view of a text has length 1. Every text also has a constant.
    """
    n = len(offsets) - 1
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    owner = np.searchsorted(offsets, start, side="right") - 1
    token = tx.Prefix(tx._LOWER[data]).of(start, end)
    ups, downs = np.r_[0, np.cumsum(_UPPER[data])], np.r_[0, np.cumsum(_SMALL[data])]
    up, down = ups[end] - ups[start], downs[end] - downs[start]
    form = np.where(up == 0, 1, np.where((down == 0) & (up > 1), 2, 3)).astype(np.uint64)
    for back in (1, 2):
        same = np.zeros(len(token), dtype=bool)
        same[back:] = (token[back:] == token[:-back]) & (owner[back:] == owner[:-back])
        form[same] += np.uint64(10 * back)
    form = tx.mix(np.where(kind[start] == 2, token, form))
    keys = [np.arange(n, dtype=np.int64) * (2 * dimensions)]
    for view, (stream, most) in enumerate(((token, 2), (form, 3))):
        for k in range(1, most + 1):
            h = tx.gram_hashes(stream, k)
            ok = owner[:len(h)] == owner[k - 1:k - 1 + len(h)]
            h = tx.mix(h + np.uint64(977 * k + view))[ok]
            keys.append(owner[:len(ok)][ok] * (2 * dimensions) + view * dimensions + 1
                        + (h % np.uint64(dimensions // 2 - 1)).astype(np.int64))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row, at = key // (2 * dimensions), key % (2 * dimensions)
    view, column = at // dimensions, at % dimensions
    value = np.log1p(count)
    group = np.where(column > 0, row * 2 + view, 2 * n)
    norm = np.sqrt(np.bincount(group, weights=value ** 2, minlength=2 * n + 1))
    norm[2 * n] = np.log1p(1)
    first = np.searchsorted(row, np.arange(n + 1))
    return first, view * (dimensions // 2) + column, value / norm[group]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int, epochs: int = 3,
         alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights of logistic regression by follow-the-regularised-leader updates, one row at a time."""
    z, n = np.zeros(dimensions), np.zeros(dimensions)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, x, y in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (_sigmoid(w @ x) - y) * x
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    return weights(z, n)


def _train(dimensions: int, epochs: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("quality", "ascending"), ("text", "ascending")])
        labels = part["quality"].to_numpy()
        rows = []
        for row, data, offsets in tx.slices(part["text"]):
            first, at, value = features(data, offsets, dimensions)
            rows += [(at[first[k]:first[k + 1]], value[first[k]:first[k + 1]], int(labels[row + k])) for k in range(len(offsets) - 1)]
        w = ftrl(rows, dimensions, epochs)
        used = np.flatnonzero(w)
        return pa.table({"at": pa.array(used, pa.int64()), "w": pa.array(w[used], pa.float64())})
    return run


def fit(labelled: DataFrame, rows: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Weights learnt from about ``rows`` rows of ``labelled`` (doc_id, text, quality), see ``sample_labels``.

    Each of up to ``SHARDS`` shards is fitted in a task of its own, in an
    order given by a hash of doc_id, and the weights are averaged. Only the
    weights come to the driver, at most ``dimensions`` of them.
    """
    shards = min(SHARDS, -(-rows // SHARD_ROWS) or 1)
    epochs = -(-UPDATES // max(1, rows // shards))
    epochs = min(max(epochs, 2), 40)
    order = F.xxhash64("doc_id", F.lit(11))
    averaged = (
        labelled.select("doc_id", "text", F.col("quality").cast("int").alias("quality"), order.alias("order"),
                        F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)).alias("shard"))
        .groupBy("shard").applyInArrow(_train(dimensions, epochs), "at bigint, w double")
        .groupBy("at").agg(F.sum("w").alias("w")).toArrow()
    )
    out = np.zeros(dimensions)
    out[averaged["at"].to_numpy()] = averaged["w"].to_numpy() / shards
    return out


def sample_labels(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[DataFrame, int]:
    """``doc_id, text, quality``: documents with a 0/1 label, about ``most`` of them; and about how many.

    The sample is a range of a hash of doc_id. Both tables are cut to it before
    they meet, so the join moves little whatever the corpus.
    """
    marked = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct()
    have = marked.count()
    share = min(1.0, most / max(1, have))
    inside = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(3)), F.lit(2 ** 30)) < F.lit(int(share * 2 ** 30))
    taken = docs.filter(inside).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        marked.filter(inside).select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality"), "doc_id")
    return taken, min(have, most)


def _predict(model, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, data, offsets in tx.slices(batch.column(batch.num_columns - 1)):
                first, at, value = features(data, offsets, dimensions)
                scores.append(_sigmoid(np.add.reduceat(w[at] * value, first[:-1])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(scores), pa.float64())],
                names=[*batch.schema.names[:-1], "score"])
    return run


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], out: str) -> DataFrame:
    """``keep`` columns of every row of ``docs``, and ``score`` of its text (null: empty)."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # DIMENSIONS numbers, 2 MB
    return docs.select(*keep, "text").mapInArrow(_predict(model, len(weights)), f"{out}, score double")


def fold(doc_id: str | Column = "doc_id") -> Column:
    """Remainder by 3 of the crc32 of doc_id as text."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 3


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality (0 or 1); rows whose ``fold`` is 1 are
    held out of learning. ``score`` is the probability of quality 1. Null or
    empty texts get the score of the constant alone. A null doc_id is not held
    out and never learnt from. A doc_id with both labels counts as both.
    Without any label every score is 0.5.
    """
    learn, rows = sample_labels(docs.filter(fold() != 1), labels.filter(fold() != 1), most)
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")
    return score(named, fit(learn, rows), ["doc_id", "held_out"], "doc_id bigint, held_out boolean").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text scores 0.5 or more, with all their columns; nothing is shuffled.

    Learning and scores are those of ``classify``, so a null or empty text is
    kept if most labels are good.
    """
    learn, rows = sample_labels(docs.filter(fold() != 1), labels.filter(fold() != 1), most)
    model = docs.sparkSession.sparkContext.broadcast(fit(learn, rows))  # DIMENSIONS numbers, 2 MB
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            good = [np.zeros(0, dtype=bool)]
            for _, data, offsets in tx.slices(batch.column(at)):
                first, index, value = features(data, offsets, len(w))
                good.append(_sigmoid(np.add.reduceat(w[index] * value, first[:-1])) >= 0.5)
            yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
