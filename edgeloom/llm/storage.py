"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{what}-{uuid.uuid4().hex}"


class _Seen:
    """Number of rows and other aggregates of a stored table, computed by one job when first asked for."""

    def __init__(self, df: DataFrame, asked: dict[str, Column]):
        self._df, self._asked, self._values = df, asked, None

    def values(self) -> dict:
        if self._values is None:
            row = self._df.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in self._asked.items()]).first()
            self._values = row.asDict()
        return self._values

    def __getitem__(self, name: str):
        return self.values()[name]


def stored(df: DataFrame, what: str, **asked: Column) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage into storage that outlives executors. ``rows_seen`` of
    the result tells its ``rows`` and any aggregates asked for by name. The
    files are scratch data; what ``discard`` does not take stays until the
    folder is emptied.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return _kept(df.sparkSession.read.schema(df.schema).parquet(path), path, asked)


def packed(df: DataFrame, rows: int | None, each: int) -> DataFrame:
    """``df`` in no more partitions than one for ``each`` of ``rows``, if that number is known.

    All rows stay. A file costs a task, so a few rows are not written as one
    file for each shuffle partition; with many rows nothing changes.
    """
    return df if rows is None else df.coalesce(max(1, -(-rows // each)))


def bucketed(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df`` stored in files dealt by ``key`` and sorted, and known as such: joins on ``key`` do not move it again."""
    spark = df.sparkSession
    n, name, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"scratch_{uuid.uuid4().hex}", shared_path(df.sparkSession, what)
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    out = _kept(spark.table(name), path, {})
    out._table = name
    return out


def _kept(df: DataFrame, path: str, asked: dict[str, Column]) -> DataFrame:
    df._scratch, df.rows_seen = path, _Seen(df, asked)
    return df


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of stored tables that nothing refers to any more."""
    for df in tables:
        if df is None or not hasattr(df, "_scratch"):
            continue
        spark = df.sparkSession
        if hasattr(df, "_table"):
            spark.sql(f"DROP TABLE IF EXISTS {df._table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
