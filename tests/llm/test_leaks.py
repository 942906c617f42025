"""Decontamination: alignment against the plain recurrence, planted copies, odd rows."""

import random
import re

import numpy as np

from edgeloom.llm import leaks as lk
from edgeloom.llm import queries

SF = "/root/testdata/sf0.01"


def plain(item, window):
    h = np.zeros((len(item) + 1, len(window) + 1), dtype=int)
    for i, x in enumerate(item, 1):
        for j, y in enumerate(window, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (lk.MATCH if x == y else lk.MISMATCH), h[i - 1, j] + lk.GAP, h[i, j - 1] + lk.GAP)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, window = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 30))
        score, begin, end = lk.align(item, window)
        assert score == plain(item, window)
        if score:
            assert 0 <= begin < end <= len(window)
            assert plain(item, window[begin:end]) == score


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_planted_copies(spark):
    rng = random.Random(4)
    items = [words(rng, rng.randint(12, 40)) for _ in range(12)]
    rows, want = [], set()
    for k in range(240):
        text = words(rng, rng.randint(5, 200))
        kind = k % 6
        if kind < 3:
            item = rng.randrange(12)
            copy = list(items[item])
            if kind:  # every sixth word replaced or lost
                copy = [x for n, x in enumerate(copy) if kind == 1 or n % 6 != 3]
                copy = [f"z{k}" if kind == 1 and n % 6 == 3 else x for n, x in enumerate(copy)]
            at = rng.randrange(len(text))
            text[at:at] = [x.upper() if kind == 0 else x for x in copy]
            want.add((k, item))
        rows.append((k, " ".join(text)))
    rows += [(500 + n, " ".join(items[3])) for n in range(300)]  # leaked into more than half
    want |= {(500 + n, 3) for n in range(300)}
    rows += [(1000, None), (1001, ""), (1002, "of the and"), (1003, " ".join(items[5]) + " x" * 30_000)]
    want.add((1003, 5))
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(50, None), (51, ""), (None, "w1 w2")], "item_id long, text string")
    got = lk.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(lk.LEAST <= r.score <= 1 and r.first_word < r.last_word for r in got)
    left = lk.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {k for k, _ in rows} - {k for k, _ in want}
    assert lk.leaks(docs, bench.limit(0)).count() == 0 and lk.leaks(docs.limit(0), bench).count() == 0
    assert lk.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha"), (3, "alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Alpha Beta"), (2, "gamma")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in lk.leaks(docs, bench).collect()} == {(1, 1)}


def test_whole_table_against_containment(spark):
    """Every verbatim copy is found with a full score, and nothing that shares no words in a row with its item."""
    got = {(r.doc_id, r.item_id): r.score for r in queries.op8_benchmark_leaks(spark, SF).collect()}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = {r.doc_id: r.text.translate(low).split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        item = r.text.translate(low).split()
        text = " " + " ".join(item) + " "
        for k, w in docs.items():
            if text in " " + " ".join(w) + " ":
                assert got[k, r.item_id] == 1.0
    assert got


def test_whole_table_against_all_pairs(spark):
    """Every document aligned with every item, cell by cell (items side by side)."""
    small = SF.replace("sf0.01", "sf0.001")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = re.compile(r"[^\x20\x09-\x0D]+")
    docs = {r.doc_id: split.findall((r.text or "").translate(low)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: split.findall((r.text or "").translate(low)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    number = {w: k for k, w in enumerate(sorted({w for t in [*docs.values(), *items.values()] for w in t}))}
    ids = sorted(items)
    longest = max(len(items[k]) for k in ids)
    grid = np.full((longest + 1, len(ids)), -1)
    for c, k in enumerate(ids):
        grid[1:len(items[k]) + 1, c] = [number[w] for w in items[k]]
    full = np.array([lk.MATCH * len(items[k]) for k in ids])
    want = {}
    for doc, text in docs.items():
        before, best = np.zeros((longest + 1, len(ids)), int), np.zeros(len(ids), int)
        for w in text:
            now = np.maximum(before + lk.GAP, 0)
            now[1:] = np.maximum(now[1:], before[:-1] + np.where(grid[1:] == number[w], lk.MATCH, lk.MISMATCH))
            now[0] = 0
            for i in range(1, longest + 1):
                np.maximum(now[i], now[i - 1] + lk.GAP, out=now[i])
            now[grid == -1] = 0
            best, before = np.maximum(best, now.max(axis=0)), now
        for c in np.flatnonzero(best >= lk.LEAST * full):
            want[doc, ids[c]] = best[c] / full[c]
    got = {(r.doc_id, r.item_id): r.score for r in queries.op8_benchmark_leaks(spark, small).collect()}
    assert got == want and got
