"""Statistics kept up to date by a stream: replays, compaction, restarts."""

import numpy as np
import pytest

from edgeloom.operators.gram import collect_stats
from edgeloom.streaming.gram import IncrementalGram


def rows(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in r]) for k, r in enumerate(x)], "row_id BIGINT, x ARRAY<DOUBLE>")


def same(stats, x):
    d = x - x.mean(axis=0)
    assert stats.n == len(x) and np.allclose(stats.mean, x.mean(axis=0)) and np.allclose(stats.m2, d.T @ d)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((90, 6)) * 3 + 100
    g = IncrementalGram(spark, str(tmp_path / "state"), 6)
    assert g.stats() is None
    for k in range(3):
        g.update(rows(spark, x[30 * k:30 * k + 30]), k)
    same(g.stats(), x)
    g.update(rows(spark, x[30:60]), 1)
    same(g.stats(), x)
    g.compact()
    same(g.stats(), x)
    assert len(g._all()) == 1
    g.update(rows(spark, x[60:90]), 2)  # merged before, so it is known
    same(g.stats(), x)
    g.update(rows(spark, x[:10]), 3)
    g.update(rows(spark, x[:0]), 4)
    same(g.stats(), np.vstack([x, x[:10]]))
    g.compact()
    again = IncrementalGram(spark, str(tmp_path / "state"), 6)
    same(again.stats(), np.vstack([x, x[:10]]))
    with pytest.raises(Exception, match="does not have 6 values"):
        g.update(rows(spark, x[:5, :4]), 5)
    same(g.stats(), np.vstack([x, x[:10]]))


def test_stream_equals_the_whole_table(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((80, 5))
    source, state, checkpoint = (str(tmp_path / n) for n in ("source", "state", "checkpoint"))
    g = IncrementalGram(spark, state, 5)
    for k in range(2):  # the second run goes on where the first one stopped
        for part in range(2):
            lo = 40 * k + 20 * part
            rows(spark, x[lo:lo + 20], lo).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("row_id BIGINT, x ARRAY<DOUBLE>").option("maxFilesPerTrigger", 1).parquet(source)
        query = g.start(stream, checkpoint, availableNow=True)
        query.awaitTermination(120)
        same(g.stats(), x[:40 * k + 40])
    whole = collect_stats(spark.read.parquet(source))
    assert np.allclose(whole.m2, g.stats().m2) and len(g._folders()) == 4
