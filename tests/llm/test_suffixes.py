"""Suffix order and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from edgeloom.llm import suffixes as sx


@pytest.mark.parametrize(("levels", "letters"), [(1, 2), (2, 2), (2, 5), (3, 1)])
def test_suffix_order(spark, levels, letters):
    rng = random.Random(levels * 10 + letters)
    strings = {k * 3: [rng.randrange(letters) for _ in range(rng.randint(1, 40))] for k in range(25)}
    rows = [(s, p, x) for s, t in strings.items() for p, x in enumerate(t)]
    got = {(r.seq, r.pos): r["rank"] for r in sx.suffix_order(spark.createDataFrame(rows, "seq long, pos int, letter long"), levels).collect()}
    cover = 3 ** levels
    prefixes = sorted(strings[s][p:p + cover] for s, p, _ in rows)
    assert len(got) == len(rows)
    for s, p, _ in rows:
        prefix = strings[s][p:p + cover]
        assert prefixes.index(prefix) <= got[s, p] < prefixes.index(prefix) + prefixes.count(prefix)


def test_neighbours_across_slices(spark):
    rows = [(k, 0, k, k // 3) for k in range(100)]
    df = spark.createDataFrame(rows, "seq long, pos int, rank long, v long")
    got = sx.with_neighbours(df, ["v"], 9).collect()
    assert len(got) == 100 and {r.seq for r in got if not r.same_v} == {99}


def brute(rows):
    seen = Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        seen.update(d[a:a + 400] for a in range(len(d) - 399))
    out = []
    for (k, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for a in range(len(d) - 399):
            if seen[d[a:a + 400]] > 1:
                gone[a:a + 400] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = sum(1 for a in range(len(d)) if gone[a] and (a == 0 or not gone[a - 1]))
        out.append((k, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_against_brute_force(spark):
    rng = random.Random(3)

    def noise(n):
        return "".join(rng.choice("abcdefgé hij") for _ in range(n))

    passages = [noise(n) for n in (390, 398, 399, 400, 401, 430, 460, 700, 1500, 900)]
    rows = []
    for k in range(70):
        text = noise(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:  # an edit somewhere
                a = rng.randrange(len(p))
                p = p[:a] + rng.choice("XYZ") + p[a + 1:]
            if rng.random() < 0.3:
                a = rng.randrange(len(p) // 2)
                p = p[a:a + rng.randint(300, 800)]
            text += p + noise(rng.randint(0, 30))
        rows.append((k, text))
    rows += [(100, None), (101, ""), (102, "x" * 399), (103, "y" * 400), (104, "z" * 401), (105, "ab" * 700), (106, "ab" * 300),
             (107, passages[8]), (107, passages[8]), (None, passages[7] + "!"), (None, None), (108, "é" * 250 + "q" * 10), (109, "q" + "é" * 230),
             (110, noise(60_000) + passages[9])]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, seq int, anchor string").repartition(5)
    got = sorted((tuple(r)[:5] for r in sx.repeats(docs).collect()), key=str)
    assert got == brute(rows)


def test_repeats_of_near_copies(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    rows = []
    for k in range(40):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("XYZ")
        rows.append((k, "".join(t)))
    got = sorted((tuple(r)[:5] for r in sx.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_nothing_repeats(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert {tuple(r)[:4] for r in sx.repeats(docs).collect()} == {(1, 5, 0, 0), (2, 0, 0, 0)}
    assert sx.repeats(docs.limit(0)).count() == 0
