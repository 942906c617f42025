"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.storage import stored, table
from edgeloom.operators.prefix import lookup, running

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
ROWS_PER_SLICE = 2_000
MAX_SOURCES = 10_000  # that are broadcast
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row a source).

    Sources in code-point order, null last, take the weights in turn and share
    the total size by them. A target stops at ``max_epochs`` times its source;
    what is over goes to the others by weight. With sources ordered by
    ``size / weight``, those that stop come first, so one running sum finds the
    level at which the rest share. Both running sums are cut into slices when
    there are more sources than a task should order.
    """
    count, total = sizes.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    named = sizes.select("*", F.struct(F.col("source").isNull(), "source").alias("at"), F.lit(1).cast("bigint").alias("one"))
    placed = running(named, "at", {"place": ("one", "sum")}, rows=count).drop("at", "one")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = placed.withColumn("weight", w.cast("bigint")).withColumn(
        "ratio", F.struct(F.col("source_size") / F.col("weight"), "place"))
    summed = running(weighted, "ratio", {"size_to": ("source_size", "sum"), "weight_to": ("weight", "sum")}, rows=count)
    all_weight = weighted.agg(F.sum("weight")).first()[0] or 0
    # the level if exactly the sources before this one stop
    rest = F.lit(total or 0) - max_epochs * (F.col("size_to") - F.col("source_size"))
    level = rest / (F.lit(all_weight) - (F.col("weight_to") - F.col("weight")))
    open_ = summed.withColumn("level", level).withColumn(
        "stops", F.col("level") * F.col("weight") > max_epochs * F.col("source_size"))
    first = open_.filter("not stops").agg(F.min(F.struct("ratio", "level")).alias("m")).first()["m"]
    # with no source below its stop, all stop (only if every size is 0)
    share = F.lit(float(first["level"])) if first is not None else F.lit(float("inf"))
    return open_.select(
        "source", "source_size",
        F.when((F.col("source_size") == 0), F.lit(0.0))
        .otherwise(F.least(F.lit(float(max_epochs)) * F.col("source_size"), share * F.col("weight"))).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source, any others) and ``size, source_size, target, taken``.

    ``size`` is the number of words. Every source is put in the order of a
    hash of doc_id, a random order that a rerun repeats. The mix takes whole
    epochs of a source while its target allows, then the first documents in
    that order up to exactly the words that are left (the last of them in
    part). Targets are cut down to whole words.

    The order is cut into slices of the hash, which is uniform, so a slice of
    a source has about ``rows_per_slice`` rows at most, whatever the source's
    share. Sums of slices are accumulated, then the documents of the one slice
    of each source that its target cuts; all other documents stay where they are.

    Null text: size 0, taken 0. A null source is a source. Null doc_ids and
    repeated rows are ordered by size. Columns of ``docs`` with the new names
    are replaced. No rows give no rows.
    """
    new = ("size", "source_size", "target", "taken")
    own = [c for c in docs.columns if c not in new]
    source = F.col("source").cast("string")
    slices = docs.count() // rows_per_slice + 1
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = docs.select(
        *own, F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("_sid"), key.alias("_key"),
        F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * F.lit(slices) / F.lit(2.0 ** 32)).cast("bigint").alias("_piece"))
    size = n_words(F.col("text")).alias("size")
    sums = stored(placed.select("_sid", "_piece", size).groupBy("_sid", "_piece").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "slices")
    per = sums.groupBy("_sid").agg(F.sum("words").alias("source_size")).select(
        F.when(~F.col("_sid.none"), F.col("_sid.name")).alias("source"), "source_size")
    plan = source_targets(per, weights, max_epochs).select(
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("_sid"),
        "source_size", "target")
    words = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    before = running(sums, "_piece", {"upto": ("words", "sum")}, ["_sid"], rows=sums.count()).join(plan, "_sid").select(
        "_sid", "_piece", "words", "rows", "source_size", "target", epochs.alias("_epochs"),
        (words - epochs * F.col("source_size") - (F.col("upto") - F.col("words"))).alias("_rest"))
    # one slice of a source is cut inside; those before it are taken whole, those after it not at all
    inner = F.min(F.when(F.col("_rest") < F.col("words"), F.struct(F.col("_piece").alias("piece"), F.col("_rest").alias("rest"))))
    ends = stored(before.groupBy("_sid", "source_size", "target", "_epochs").agg(inner.alias("_cut"), F.sum("rows").alias("_rows")), "ends")
    if ends.rows_seen["rows"] <= MAX_SOURCES:
        joined = placed.join(F.broadcast(ends.drop("_rows")), "_sid")
    else:
        joined = lookup(placed, ends, ["_sid"], "_rows", docs.count(), 0)
    is_cut = F.col("_piece").eqNullSafe(F.col("_cut.piece"))
    full = F.when(F.col("_cut").isNull() | (F.col("_piece") < F.col("_cut.piece")), F.col("size")).otherwise(F.lit(0).cast("bigint"))
    uncut = joined.filter(~is_cut).select("*", size).withColumn("_more", full)
    inside = Window.partitionBy("_sid", "_piece").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    extra = F.col("_cut.rest") - (F.sum("size").over(inside) - F.col("size"))
    some = joined.filter(is_cut).select("*", size).withColumn("_more", F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), extra)))
    out = [*own, "size", "source_size", "target", (F.col("_epochs") * F.col("size") + F.col("_more")).alias("taken")]
    return uncut.select(*out).unionByName(some.select(*out))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT source, source_size, CAST([1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM per),
-- round by round: whoever would be above the stop is fixed there, the others share what is left
fill AS (
  SELECT 0 AS step, source, source_size, weight, false AS stopped,
         (SELECT sum(source_size) FROM placed)::DOUBLE / (SELECT sum(weight) FROM placed) AS level
  FROM placed
  UNION ALL
  SELECT step + 1, source, source_size, weight, stops,
         (total - sum(CASE WHEN stops THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
           / sum(CASE WHEN stops THEN 0 ELSE weight END) OVER ()
  FROM (SELECT *, stopped OR level * weight > 3 * source_size AS stops,
               sum(source_size) OVER () AS total FROM fill)
  WHERE step < (SELECT count(*) FROM placed)),
targets AS (
  SELECT source, source_size, CASE WHEN stopped THEN 3.0::DOUBLE * source_size ELSE level * weight END AS target
  FROM fill WHERE step = (SELECT count(*) FROM placed)),
cut AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS words,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, words - epochs * source_size - (upto - size))))::BIGINT AS taken
FROM cut
"""
