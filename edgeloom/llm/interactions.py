"""What each of several filters removes in every order of them, by potentials of the removal game.

A coalition is a set of filters; its worth is the number of documents that at
least one of them removes. One pass counts documents by the set of conditions
they fail, so a part of the corpus is 32 counts however large it is. From
these follow the worths of all coalitions, the Hart-Mas-Colell potential of
each by recursion over its size, and every figure of every order as a
difference of coalitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.storage import table

SPACES = r"[\x20\x09-\x0D]+"
COPY = "E"  # the condition that looks at other rows


def row_conditions() -> dict[str, Column]:
    """Conditions of one document on ``text`` and its ``words``; true means that it fails."""
    words, text = F.col("words"), F.col("text")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bit(letters: str, letter: str) -> int:
    return 1 << letters.index(letter)


def failures(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """``doc_id, part, digest, mask, good, toxic``: the row conditions that each document fails, as bits."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"),
        F.array_remove(F.split(text, SPACES), "").alias("words"))
    mask = F.lit(0)
    for letter, fails in row_conditions().items():
        mask = mask + F.when(fails, _bit(letters, letter)).otherwise(0)
    rows = words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return rows.join(marks, "doc_id", "left").withColumns(
        {"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})


def mask_counts(rows: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by the conditions they fail, copies included.

    Equal texts fail the same row conditions, so copies are merged before they
    meet: by document (rows that repeat a doc_id count together), then by text,
    part and labels, keeping the smallest doc_id and its rows. What meets in one
    place for a text is a row for each part and label that has it.
    """
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("low"),
        F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("nameless"))
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    originals = by_text.withColumn("first", first).withColumn(
        "originals", F.col("nameless") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0))
    copy = _bit(letters, COPY)
    split = F.explode(F.array(
        F.struct(F.col("mask"), F.col("originals").alias("n")),
        F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("originals")).alias("n"))))
    each = originals.select("part", "good", "toxic", split.alias("x"))
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic"))


def potentials(worth: list[int], n: int) -> list[int]:
    """n! times the Hart-Mas-Colell potential of each of the 2**n coalitions (bit sets), as exact integers.

    P(S) is the mean over the members i of S of P(S without i), plus worth(S) / |S|.
    """
    scale, out = factorial(n), [0] * (1 << n)
    for s in range(1, 1 << n):  # what lacks a member comes earlier
        members = [i for i in range(n) if s >> i & 1]
        out[s] = (scale * worth[s] + sum(out[s ^ 1 << i] for i in members)) // len(members)
    return out


def _worths(counts: list[int], n: int) -> list[int]:
    """Documents that some filter of a coalition removes: all but those whose failures lie outside it."""
    inside = list(counts)
    for i in range(n):
        for s in range(1 << n):
            if s >> i & 1:
                inside[s] += inside[s ^ 1 << i]
    return [inside[-1] - inside[((1 << n) - 1) ^ s] for s in range(1 << n)]


def orders(letters: str):
    """A task that turns 32 counts of each part into the figures of every order and step."""
    n, full = len(letters), (1 << len(letters)) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, total, *counts in zip(batch["part"], batch["total"], batch["n"], batch["good"], batch["toxic"], strict=True):
                every, good, toxic = (_worths([int(x) for x in c], n) for c in counts)
                pot, out = potentials(every, n), []
                for order in permutations(range(n)):
                    name, before = "".join(letters[i] for i in order), 0
                    for step, i in enumerate(order, 1):
                        after = before | 1 << i
                        removed = every[after] - every[before]
                        out.append((part, name, step, int(total) - every[after], removed, every[1 << i] - removed,
                                    every[full] - every[full ^ 1 << i], good[after] - good[before],
                                    toxic[after] - toxic[before], pot[full] - pot[full ^ 1 << i]))
                        before = after
                yield pd.DataFrame(out, columns=COLUMNS)
    return run


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part (source), order of the filters and step, with what the step's filter does there.

    ``docs`` has doc_id, text, source; ``labels`` doc_id, quality, toxic. Filters:
    A few words, B repetitive, C capitals, D symbols, E copy of a smaller doc_id.
    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (the filter's removals summed over all orders).

    Null text is empty, null source the part ''. Rows that repeat a doc_id count
    each; those with the smallest doc_id of a text are all originals. A null
    doc_id is no copy, makes none, and has no labels. Of several label rows of a
    document one with the mark suffices; null marks are none. Very long texts
    are taken whole. No documents give no rows; other columns are ignored.
    """
    counts = mask_counts(failures(docs, labels, letters), letters)
    mask = F.col("mask")
    arrays = [F.array(*[F.sum(F.when(mask == k, F.col(c)).otherwise(0)) for k in range(1 << len(letters))]).alias(c)
              for c in ("n", "good", "toxic")]
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), *arrays)
    return parts.mapInPandas(
        orders(letters), "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
        "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``audit`` of five filters on whole ``documents``; nulls, repeated rows and empty tables as stated there."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
m AS (SELECT w.doc_id, part,
  CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN low < w.doc_id THEN 16 ELSE 0 END AS mask,
  CASE WHEN quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic
  FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
l(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p AS (SELECT [v.f, w.f, x.f, y.f, z.f] AS fs, [v.b, w.b, x.b, y.b, z.b] AS bs FROM l v, l w, l x, l y, l z
  WHERE v.b | w.b | x.b | y.b | z.b = 31),
s AS (SELECT array_to_string(fs, '') AS filter_order, k::INT AS step, bs[k] AS bit, (list_sum(bs[1:k]) - bs[k])::INT AS before
  FROM p, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
