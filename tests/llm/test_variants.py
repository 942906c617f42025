"""Spelling variants against plain counting and neighbourhoods made by trying every edit."""

import random
import re
import zlib
from collections import Counter

import pytest

from edgeloom.llm import variants

SF = "/root/testdata/sf0.001"
LETTERS = [chr(c) for c in [*range(97, 123), *range(65, 91), *range(0xC0, 0x100)]]


def brute(rows, min_letters=5, min_count=3):
    n = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_letters and c >= min_count}
    near = {}
    for w in n:
        around = {w[:k] + w[k + 1:] for k in range(len(w))}
        around |= {w[:k] + c + w[k + e:] for k in range(len(w) + 1) for e in (0, 1) for c in LETTERS if k + e <= len(w)}
        near[w] = [x for x in around if x in n and x != w]
    form = {}
    for w, x in near.items():
        best = min(x, key=lambda y: (-n[y], y), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = found(variants.op13_spelling_variants(spark, SF))
    assert got == brute(rows) and any(r[1] for r in got)


@pytest.mark.parametrize("most", [4096, 3])
def test_odd_rows_and_divided_partitions(spark, most):
    rng = random.Random(most)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))) for _ in range(200)]
    words += ["".join(rng.choice("aé") for _ in range(rng.randrange(30, 34))) for _ in range(20)]
    long = "x" * 200
    words += [long, long + "x", "y" + long, long[:90] + "z" + long[91:], long[:90] + "z" + long[90:]]
    rows = [(k, " ".join(rng.choice(words).title() for _ in range(60))) for k in range(120)]
    rows += [(k, " ".join(words[-5:] * k)) for k in range(1, 9)]
    rows += [(None, "Abcde abcde ABCDE abcdé"), (500, None), (501, ""), (502, "12 ×÷× ÷÷÷÷÷"), (502, "12 ×÷× ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷"), (503, "straße STRASSE " * 4)]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id int, text string, n int, word string").repartition(3)
    assert found(variants.spelling_variants(docs, most=most)) == brute(rows)
    if most == 3:
        assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_acceptor_is_the_smallest():
    words = ["aXb", "aYb", "cXb", "cXbb", "cYb"]
    a = variants.Acceptor(words)
    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo += a.arcs[s].values()
    starts = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(reached) == len({frozenset(w[len(s):] for w in words if w.startswith(s)) for s in starts})


def test_composition_finds_every_pair():
    rng = random.Random(0)
    for width in range(4):
        words = sorted({"".join(rng.choice("abc") for _ in range(width + rng.randrange(2))) for _ in range(60)})
        for inside in (False, True):
            got = sorted(variants.one_edit(variants.Acceptor(words), width, inside))
            want = []
            for u in words:
                for v in words:
                    if len(u) == width and len(v) == width and sum(x != y for x, y in zip(u, v, strict=True)) == 1:
                        want.append((u, v))
                    if len(u) == width and len(v) == width + 1 and any(v[:k] + v[k + 1:] == u for k in range(len(v))) and not (inside and v[:width] == u):
                        want.append((u, v))
            assert got == sorted(want)
