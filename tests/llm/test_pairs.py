"""MinHash near-duplicates and mixing against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import linking, near_dedup, queries, storage
from edgeloom.llm.linking import connected, groups
from edgeloom.llm.mixing import mix, source_targets

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots_of(n, links):
    root = {k: k for k in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in n}


def brute(rows, words, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for k, t in rows:
        w = WORD.findall((t or "").translate(low))
        n = min(words, len(w))
        sets[k] = {tuple(w[a:a + n]) for a in range(len(w) - n + 1)} if w else set()
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            s, t = sets[a], sets[b]
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    links.append((a, b))
    root = roots_of(ids, links)
    return sorted((k, len(sets[k]), root[k], root[k] == k) for k in ids)


def test_near_duplicates_whole_table(spark):
    got = sorted(tuple(r) for r in queries.op1_near_duplicates(spark, SF).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows, 3, 85)
    assert len({r[2] for r in got}) < len(got)


def test_near_duplicates_odd_rows(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, base), (8, base + " x"),
            (9, base.upper()), (10, "z " + base + " x"), (11, base * 40), (12, "one two")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id int, text string, item string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs, 3, 85).collect())
    assert got == brute(rows, 3, 85)
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, base, "x")], docs.schema))
    again = near_dedup.near_duplicates(twice, 3, 85).collect()
    assert len(again) == 25
    assert {(r.doc_id, r.component_id) for r in again if r.doc_id is not None} == {(r[0], r[2]) for r in got}
    assert [(r.component_id, r.kept) for r in again if r.doc_id is None] == [(None, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_an_id_with_two_texts_joins_both(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (3, "alone here")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (3, 3)}


@pytest.mark.parametrize("turns", [3, 1])
def test_a_family_of_edited_copies(spark, monkeypatch, turns):
    monkeypatch.setattr(near_dedup, "STAR_TURNS", turns)
    rng = np.random.default_rng(8)
    rows = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(120)]
        for _ in range(50):
            text = list(base)
            for k in rng.integers(0, 120, rng.integers(0, 16)):
                text[k] = f"e{rng.integers(1e9)}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((3, 85), (5, 80)):
        got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs, words, percent).collect())
        assert got == brute(rows, words, percent)
        assert 3 < len({r[2] for r in got}) < 140


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**64, 12, dtype=np.uint64))
    same = []
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**64, 12, dtype=np.uint64))
        y = x[:9]
        same.append((near_dedup.signature(x, 125) == near_dedup.signature(y, 125)).mean())
    assert abs(np.mean(same) - 0.75) < 0.03


def test_groups_find_every_link_of_a_bucket(spark):
    # a chain in one bucket: each item is linked to its neighbours only
    members = spark.createDataFrame([(1, k * 10) for k in range(40)] + [(2, 5), (2, 390)], "bucket long, item long")
    traits, always = lambda items: items, lambda p, q: F.lit(True)
    got, left = groups(members, lambda pairs: pairs.filter("b - a = 10"), traits, always)
    assert left.isEmpty()
    assert {tuple(r) for r in got.collect()} == {(k * 10, 0) for k in range(1, 40)}
    none, left = groups(members, lambda pairs: pairs.filter("a > b"), traits, always)
    assert left.isEmpty()
    assert none.count() == 0


@pytest.mark.parametrize("part_rows, open_rows", [(1024, 0), (30, 40)])
def test_a_bucket_of_unlike_members_is_settled_in_two_rounds(spark, monkeypatch, part_rows, open_rows):
    monkeypatch.setattr(linking, "PART_ROWS", part_rows)
    members = spark.createDataFrame([(1, k) for k in range(40)] + [(2, k) for k in range(37, 50)], "bucket long, item long")
    seen = []

    def verify(pairs):
        seen.extend(tuple(r) for r in pairs.collect())
        return pairs.filter("a = 3 and b = 38")

    got, left = groups(members, verify, lambda items: items, lambda p, q: F.lit(True), turns=2)
    assert left.count() == open_rows  # larger buckets go on by 1,024 centres
    if not open_rows:
        both = {(a, b) for k in (range(40), range(37, 50)) for a in k for b in k if a < b}
        assert set(seen) <= both and len(both) - len(set(seen)) <= 2 * 40  # pairs of one group need no test
        assert {tuple(r) for r in got.collect()} == {(38, 3)}


@pytest.mark.parametrize("size", [300, 600])
def test_a_large_family_is_settled_in_three_rounds(spark, monkeypatch, size):
    # more than PART_ROWS members, all but 20 of them linked with any other one
    monkeypatch.setattr(linking, "PART_ROWS", 32)
    members = spark.createDataFrame([(b, k) for b in (1, 2) for k in range(size)] + [(2, size)], "bucket long, item long")
    rounds = []

    def verify(pairs):
        rounds.append(pairs.count())
        return pairs.filter(f"a >= 20 or (a = 3 and b = {size - 1}) or (a = 5 and b = 7)")

    got, left = groups(members, verify, lambda items: items, lambda p, q: F.lit(True), turns=3)
    assert left.isEmpty() and len(rounds) <= 3  # members of the family that meet no centre any more are not left open
    assert sum(rounds) <= 60 * size  # in proportion to the family
    want = roots_of(range(size + 1), [(20, k) for k in range(21, size + 1)] + [(3, size - 1), (5, 7)])
    assert {r["item"]: r["root"] for r in got.collect()} == {k: v for k, v in want.items() if k != v}


def test_few_links_are_connected_in_one_task(spark, monkeypatch):
    # also where joins of estimated size are dealt out again
    monkeypatch.setattr(linking, "stored", lambda df, what, **asked: (seen.append((what, df)), kept(df, what, **asked))[1])
    seen, kept = [], storage.stored
    links = spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long")
    assert {r.node: r.root for r in connected(links, 50).collect()} == {k: 0 for k in range(1, 51)}
    assert {what for what, _ in seen} == {"links", "stars"}
    for what, df in seen:
        assert df.rdd.getNumPartitions() == 1
        if what == "stars":
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_large_buckets_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(linking, "PART_ROWS", 3)
    rng = np.random.default_rng(2)
    links = {tuple(sorted(map(int, e))) for e in rng.integers(0, 60, (50, 2)) if e[0] != e[1]}
    members = spark.createDataFrame([(1, k) for k in range(60)] + [(2, k) for k in range(0, 60, 7)], "bucket long, item long")
    allowed = spark.createDataFrame(sorted(links), "a long, b long")
    for most in (32_768, 20):
        monkeypatch.setattr(linking, "MAX_CENTRES", most)
        got, left = groups(members, lambda pairs: pairs.join(allowed, ["a", "b"]), lambda items: items, lambda p, q: F.lit(True))
        want = roots_of(range(60), links)
        assert left.isEmpty() and {r["item"]: r["root"] for r in got.collect()} == {k: v for k, v in want.items() if k != v}


@pytest.mark.parametrize("in_a_task", [1_000_000, 0])
def test_connected(spark, monkeypatch, in_a_task):
    monkeypatch.setattr(linking, "TASK_ROWS", in_a_task)
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots_of(range(300), links)
    assert got == {k: v for k, v in want.items() if v != k}


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 0, 500, 3], [7], [0, 0], [5, 1, 1, 1, 1, 1, 1000]])
def test_targets_share_the_total(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    weight = {f"s{k}": k % 3 + 1 for k in range(len(sizes))}
    fixed, total = set(), sum(sizes)
    while True:  # the rule as it is stated
        free = [s for s in weight if s not in fixed]
        rest = total - sum(3 * sizes[int(s[1:])] for s in fixed)
        want = {s: 3 * sizes[int(s[1:])] if s in fixed else rest * weight[s] / sum(weight[x] for x in free) for s in weight}
        above = {s for s in free if want[s] > 3 * sizes[int(s[1:])]}
        if not above:
            break
        fixed |= above
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(total)


def test_mix_is_exact_and_repeats(spark):
    rows = [(k, None if k % 13 == 0 else " ".join(["w"] * (k % 9)), f"s{k % 4}" if k % 7 else None) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    docs = docs.selectExpr("*", "1 as taken", "2 as words", "'x' as name")
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    one = mix(docs, rows_per_slice=20)
    assert one.columns == ["doc_id", "text", "source", "words", "name", "size", "source_size", "target", "taken"]
    a, b = (sorted(map(tuple, x.select(cols).collect()), key=str) for x in (one, mix(docs.repartition(2))))
    assert a == b and len(a) == 900
    taken, target = {}, {}
    for _, source, size, _, goal, got in a:
        assert 0 <= got <= 3 * size
        taken[source] = taken.get(source, 0) + got
        target[source] = goal
    assert taken == {s: int(np.floor(t)) for s, t in target.items()}
    assert mix(docs.limit(0)).count() == 0
    assert mix(docs.withColumn("text", docs.text.cast("string").substr(1, 0))).agg({"taken": "sum"}).first()[0] == 0


def test_narrowed_rows_keep_every_wanted_key(spark, monkeypatch):
    rows = spark.createDataFrame([(k,) for k in range(-500, 500)] + [(None,)], "k long")
    wanted = spark.createDataFrame([(k,) for k in range(-500, 500, 50)] + [(None,), (7777,)], "w long")
    for words, most in ((linking.KEY_WORDS, 22), (1, 600)):
        monkeypatch.setattr(linking, "KEY_WORDS", words)
        some, others = ([r.k for r in linking.narrowed(rows, F.col("k"), wanted, o).collect()] for o in (False, True))
        assert set(range(-500, 500, 50)) <= set(some) and len(some) <= most and None in others
        assert sorted([*some, *others], key=str) == sorted([*range(-500, 500), None], key=str)


def test_mix_moves_only_the_documents_of_cut_slices(spark):
    docs = spark.createDataFrame([(k, "a b c", "xyz"[k % 3]) for k in range(3000)], "doc_id long, text string, source string")
    mixed = mix(docs, rows_per_slice=50).selectExpr("*", "spark_partition_id() as p")
    assert mixed.count() == 3000
    moved = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert moved.count("Window") == 1 and moved.index("Union") < moved.index("Window")  # one side of the union has none
    assert mixed.filter("taken not in (0, 3, 6, 9)").count() <= 3
    assert mixed.groupBy("source", "target").agg(F.sum("taken").alias("t")).filter("abs(t - target) >= 1").isEmpty()


@pytest.mark.parametrize("most", [10_000, 1])
def test_mix_with_many_sources(spark, monkeypatch, most):
    from edgeloom.llm import mixing
    monkeypatch.setattr(mixing, "MAX_SOURCES", most)
    docs = spark.createDataFrame([(k % 190, "a b " * (k % 5), None if k % 7 == 0 else f"s{k % 40}") for k in range(200)], "doc_id long, text string, source string")
    got = sorted((r.source or "", r.doc_id, r["size"], r.taken) for r in mix(docs, rows_per_slice=20).collect())
    want = sorted((r.source or "", r.doc_id, r["size"], r.taken) for r in mix(docs).collect())
    assert got == want and len(got) == 200
