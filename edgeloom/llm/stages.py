"""The stages of the corpus pipeline.

Each takes ``(spark, docs, sf_dir)`` and decides about every row of ``docs``.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.leaks import without_leaks
from edgeloom.llm.lines import MIN_CHARS, dedup_lines
from edgeloom.llm.mixing import mix
from edgeloom.llm.near_dedup import near_duplicates
from edgeloom.llm.quality import accept
from edgeloom.llm.storage import stored, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return accept(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first in the corpus stays; every document stays, if need be empty.

    ``n_chars``, where there is one, follows the text. Unlike in
    ``op7_line_dedup``, lines below ``MIN_CHARS`` characters stay.
    """
    own = {c: f"_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(own), min_chars=MIN_CHARS)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(own[c]).alias(c) if c in own else F.col(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id.

    Rows with a null doc_id or without words are in no group and stay. Of rows
    that share a doc_id and a text one stays, the smallest in the order of all
    columns; rows that share a doc_id but not the text all stay if the doc_id does.
    """
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    several = stored(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id"), "several")
    if several.isEmpty():
        return left
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    copies = left.join(several, "doc_id", "left_semi").select(*docs.columns).filter(worded)
    one_each = copies.groupBy(F.col("doc_id").alias("_d"), F.col("text").alias("_t")).agg(F.min(F.struct(*docs.columns)).alias("_r")).select("_r.*")
    alone = left.join(several.withColumnRenamed("doc_id", "_d"), (F.col("doc_id") == F.col("_d")) & worded, "left_anti")
    return alone.select(*docs.columns).unionByName(one_each)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document that it takes, with ``size, source_size, target`` and the words ``taken``.

    ``taken`` counts repeats: 5 of a document of 2 words are two copies and
    one word. Columns of these names that ``docs`` has are replaced.
    """
    return mix(docs).filter("taken > 0")
