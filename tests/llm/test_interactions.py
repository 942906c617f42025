"""The filter audit against brute force over all orders, and its twin."""

import random
import re
from itertools import permutations

import duckdb
import pytest

from edgeloom.llm import interactions

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    """Apply every order to every document, one filter after the other."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    low = {}
    for k, t, _ in docs:
        if k is not None:
            low[t or ""] = min(low.get(t or "", k), k)
    rows = []
    for k, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            re.search("[#$%&*|]", t), k is not None and low[t] < k), strict=True) if x}
        rows.append((s or "", k, fails))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[2]], [r for r in left if f not in r[2]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[2] for r in mine) - len(gone), sum(r[2] == {f} for r in mine),
                    sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, source string, mask int, part string")
    x = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in interactions.audit(d, x).collect())


def test_every_order_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Aa", "bb", "CC", "dd#", "ee", "ff|"] + [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 60, 300])]) for _ in range(rng.choice([3, 150, 230]))) for _ in range(25)]
    docs = [(k, rng.choice(texts), rng.choice(["s", "t", None, ""])) for k in range(80)]
    docs += [(None, texts[0], "s"), (None, None, "s"), (5, texts[1], "s"), (5, texts[1], "s"), (-1, texts[1], "t"), (200, None, "u"),
             (201, "", "u"), (202, " \n", "u"), (203, "é" * 99 + "A", "u"), (204, "word " * 300_000, "u")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 80, 2)] + [(999, 1, 1), (204, 1, None)]
    assert audited(spark, docs, labels) == brute(docs, labels)
    assert audited(spark, [], labels) == []
    twice = labels + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    assert audited(spark, docs, twice) == brute(docs, twice)


def test_potential_differences_are_shapley_values():
    rng = random.Random(5)
    worth = [0] + [rng.randrange(100) for _ in range(31)]
    pot = interactions.potentials(worth, 5)
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += worth[before | 1 << i] - worth[before]
        assert pot[31] - pot[31 ^ 1 << i] == total


@pytest.mark.parametrize("sf", [SF])
def test_twin(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = interactions.op12_filter_audit(spark, sf)
    want = con.execute(interactions.OP12_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 600 * len({r[0] for r in want})
