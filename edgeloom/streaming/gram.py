"""Incremental sufficient statistics by Structured Streaming.

Count, mean and centred cross products of two sets of samples follow from
those of each, so a stream keeps them up to date without its old samples.
Every micro-batch becomes the blocks of its own statistics, stored under its
batch id. Spark may run a batch again after a failure; it then replaces what
it stored before, so a replayed batch changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from edgeloom.operators.gram import _BLOCK_SCHEMA, Stats, assemble, merge_blocks, stat_blocks
from edgeloom.operators.matrix import check_dense


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class IncrementalGram:
    """Statistics of all samples (``x ARRAY<DOUBLE>`` of width ``p``) that a stream has brought so far.

    ``path`` is a folder that the driver and all executors share. It holds a
    folder of blocks for each batch, and one for all batches up to some id that
    ``compact`` has merged. The stored state does not grow with the samples.
    A batch without samples stores nothing. A sample that is null, or of another width,
    fails its batch.
    """

    def __init__(self, spark: SparkSession, path: str, p: int) -> None:
        self.spark, self.path, self.p = spark, path.rstrip("/"), p

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Store a batch's blocks in place of those it stored before; batches already merged are left out."""
        upto = self._merged()
        if upto is not None and batch_id <= upto[0]:
            return
        blocks = stat_blocks(batch.select("x"), self.p).withColumn("batch", F.lit(batch_id))
        # written aside and renamed, so a reader sees a batch as a whole or not at all
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        blocks.write.parquet(aside)
        self._rename(aside, f"batch-{batch_id:012d}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Keep the statistics up to date with ``stream``; ``trigger`` as in ``DataStreamWriter.trigger``."""
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def blocks(self) -> DataFrame:
        """Blocks of all batches, merged: ``key, chunk, src, n, mean, m2``."""
        # a batch has one block of each chunk: its id takes the place of the task that made it
        stored = self._stored().withColumn("src", F.pmod("batch", F.lit(2**31 - 1)).cast("int")).drop("batch")
        return merge_blocks(stored, max(1, len(self._folders())))

    def stats(self) -> Stats | None:
        """Statistics on the driver (size checked), None before the first sample."""
        check_dense(self.p, "the driver-side cross-product matrix")
        if not self._folders():
            return None
        rows = self.blocks().toPandas()
        return None if rows.empty else assemble(rows)

    def compact(self) -> None:
        """Merge the stored batches into one folder; a batch that is replayed later is known by its id."""
        last = [name for name in self._folders() if name.startswith("batch-")]
        if not last:
            return
        upto = int(last[-1].removeprefix("batch-"))
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        self.blocks().withColumn("batch", F.lit(upto)).write.parquet(aside)
        self._rename(aside, f"upto-{upto:012d}")
        fs, _ = _fs(self.spark, self.path)
        keep = f"upto-{upto:012d}"
        for name in self._all():
            if name != keep and not name.startswith("_") and int(name.split("-")[1]) <= upto:
                fs.delete(_fs(self.spark, f"{self.path}/{name}")[1], True)

    def _rename(self, aside: str, name: str) -> None:
        fs, src = _fs(self.spark, aside)
        dst = _fs(self.spark, f"{self.path}/{name}")[1]
        if fs.exists(dst):
            fs.delete(dst, True)
        if not fs.rename(src, dst):
            raise OSError(f"could not store {name}")

    def _all(self) -> list[str]:
        fs, p = _fs(self.spark, self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _merged(self) -> tuple[int, str] | None:
        upto = [n for n in self._all() if n.startswith("upto-")]
        return (int(upto[-1].removeprefix("upto-")), upto[-1]) if upto else None

    def _folders(self) -> list[str]:
        """The folders that count: the last merged one and the batches after it."""
        merged = self._merged()
        batches = [n for n in self._all() if n.startswith("batch-") and (
            merged is None or int(n.removeprefix("batch-")) > merged[0])]
        return ([merged[1]] if merged else []) + batches

    def _stored(self) -> DataFrame:
        schema = _BLOCK_SCHEMA + ", batch BIGINT"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in self._folders()])
