"""The pipeline: every stage against brute force on what the stage before kept, and odd rows."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from test_pairs import brute as near_brute  # noqa: E402

from edgeloom.llm import leaks, lines, quality, stages  # noqa: E402
from edgeloom.llm.mixing import mix  # noqa: E402

SF = "/root/testdata/sf0.001"


def lines_brute(spark, rows):
    """Texts after line dedup; distances by Spark's own function over all pairs of distinct lines."""
    at = {}
    for k, t in rows.items():
        for n, x in enumerate(t.split("\n")):
            if len(x) >= lines.MIN_CHARS:
                at.setdefault(x, []).append((k, n))
    df = spark.createDataFrame([(x, len(x)) for x in at], "x string, n int")
    other = df.select(F.col("x").alias("y"), F.col("n").alias("m"))
    near = df.join(other, (F.abs(F.col("n") - F.col("m")) <= 2) & (F.col("x") < F.col("y"))).filter(
        F.levenshtein("x", "y", 2) >= 0).select("x", "y").collect()
    root = {x: x for x in at}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in near:
        root[find(r.x)] = find(r.y)
    places = {}
    for x, p in at.items():
        places.setdefault(find(x), []).extend(p)
    drop = {p for g in places.values() for p in g if p != min(g)}
    return {k: "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in drop) for k, t in rows.items()}


def test_every_stage_against_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect() or [], stage(spark, docs.limit(0), SF).schema)
        after = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality":
            good = quality.classify(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r.doc_id for r in good.collect() if r.predicted == 1} and after == {k: before[k] for k in after}
        elif name == "line_dedup":
            want = lines_brute(spark, {k: r.text for k, r in before.items()})
            assert {k: r.text for k, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for k, r in after.items() if r.text != before[k].text)
        elif name == "near_dedup":
            want = {k for k, _, _, kept in near_brute([(k, r.text) for k, r in before.items()], 5, 80) if kept}
            assert set(after) == want and after == {k: before[k] for k in after}
        elif name == "decontamination":
            hit = {r.doc_id for r in leaks.leaks(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - hit
        else:
            want = {r.doc_id: r.taken for r in mix(spark.createDataFrame(list(before.values()))).collect() if r.taken > 0}
            assert {k: r.taken for k, r in after.items()} == want
        seen.append((name, len(before), len(after)))
    assert seen[0][1] > seen[0][2] > 0 and seen[-1][2] > 0


def test_run_repeats(spark):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str) for _ in range(2))
    assert one == two and one


def test_stages_take_odd_rows(spark):
    rows = [(None, "a line that stands in two rows of this table\nx", None, None, 5), (1, None, "en", "s", None), (1, None, "en", "s", None),
            (2, "", None, "s", 0), (3, "a line that stands in two rows of this table\ny", "en", None, 46),
            (4, "a line that stands in two rows of this table", "en", None, 44), (5, "word " * 40_000, "en", "s", 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "'q' as line", "1 as item", "2 as size", "true as kept", "0.5D as score", "'z' as root")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert out.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    edited = {r.doc_id: (r.text, r.n_chars) for r in stages.drop_repeated_lines(spark, docs, SF).collect() if r.doc_id and r.doc_id > 2}
    assert edited[4] == ("", 0) and edited[3][1] == 46
    mixed = stages.mix_sources(spark, docs, SF)
    assert mixed.count() == 4 and {"size", "source_size", "target", "taken"} <= set(mixed.columns)
    assert stages.mix_sources(spark, docs.limit(0), SF).count() == 0


def test_rows_that_share_a_doc_id(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    rows = [(1, a, "x"), (1, b, "x"), (1, None, "x"), (1, a, "w"), (2, a, "x"), (3, "z", "x"), (None, b, "x"), (None, b, "x"), (4, " ", "x"), (4, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "5 as n_lines", "6 as n_removed")
    got = sorted(map(tuple, stages.keep_one_of_each_group(spark, docs, SF).collect()), key=str)
    want = [(1, a, "w"), (1, b, "x"), (1, None, "x"), (3, "z", "x"), (None, b, "x"), (None, b, "x"), (4, " ", "x"), (4, " ", "x")]
    assert got == sorted(((*r, 5, 6) for r in want), key=str)
    out = stages.drop_repeated_lines(spark, docs, SF)
    assert out.columns == docs.columns and {(r.n_lines, r.n_removed) for r in out.collect()} == {(5, 6)}
