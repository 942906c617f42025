"""Line dedup: the edit distance, the join against all pairs, and the edited texts."""

import random

import pytest
from pyspark.sql import functions as F

from edgeloom.llm import lines as ln


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        what = rng.randrange(3)
        if what == 0:
            s[k] = rng.choice("abcé𝛼")
        elif what == 1:
            s.insert(k, rng.choice("abcé𝛼"))
        else:
            del s[k]
    return "".join(s)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edit_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(threshold + 6, 40)))
        pairs.append((a, edited(rng, a, rng.randint(0, 5))))
    got = spark.createDataFrame(pairs, "x string, y string").select(
        "x", "y", ln.edit_distance(F.col("x"), F.col("y"), threshold).alias("d")).collect()
    assert [r.d for r in got] == [min(levenshtein(a, b), threshold + 1) for a, b in pairs]


def brute(rows, threshold, min_chars):
    at = {}
    for k, t in rows:
        for n, x in enumerate((t or "").split("\n") if t is not None else []):
            if k is not None and len(x) >= min_chars:
                at.setdefault(x, []).append((k, n))
    texts = sorted(at)
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            if abs(len(a) - len(b)) <= threshold and find(a) != find(b) and levenshtein(a, b) <= threshold:
                root[find(a)] = find(b)
    groups = {}
    for x in texts:
        groups.setdefault(find(x), []).extend(at[x])
    drop = {p for g in groups.values() for p in g if p != min(g)}
    out = []
    for k, t in rows:
        parts = t.split("\n") if t is not None else []
        kept = [x for n, x in enumerate(parts) if (k, n) not in drop or k is None]
        out.append((k, None if t is None else "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def test_lines_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc d") for _ in range(rng.randint(14, 34))) for _ in range(25)]
    rows = []
    for k in range(60):
        parts = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 6))]
        rows.append((k, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, base[0]), (104, base[0] + "\n" + base[0]), (None, base[0]),
             (105, "long " * 300 + "\n" + base[1]), (106, "long " * 300 + "x")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, line int").repartition(4)
    got = ln.dedup_lines(docs, 2, 20)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == brute(rows, 2, 20)
    assert got.columns == ["doc_id", "line", "text", "n_lines", "n_removed"]


def test_no_rows_and_no_copies(spark):
    docs = spark.createDataFrame([(1, "an entirely different line of text"), (2, "and one that shares nothing at all")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in ln.dedup_lines(docs).collect()} == {(1, 0), (2, 0)}
    assert ln.dedup_lines(docs.limit(0)).count() == 0


def test_bigram_parity_bounds_the_distance(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choice("abcdefgé") for _ in range(rng.randint(20, 90)))
        pairs.append((a, edited(rng, a, rng.randint(0, 3))))
    got = spark.createDataFrame(pairs, "x string, y string").select(
        "x", "y", ln.bigram_parity(F.col("x")).alias("p"), ln.bigram_parity(F.col("y")).alias("q")).collect()
    for r in got:
        apart = sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(r.p, r.q, strict=True))
        assert apart <= 4 * levenshtein(r.x, r.y)
    assert len({tuple(r.p) for r in got}) == len({r.x for r in got})


def test_equal_lines_of_any_length_meet(spark):
    long = "a line that is long enough for near copies"
    rows = [(1, "x\nAnd ornd.\n\n" + long), (2, "And ornd.\nAnd ornd!\n\nx\ny"), (3, "And ornd.\n" + long[:-1]), (None, "x"), (4, "x\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in ln.dedup_lines(docs).collect()}
    assert got == {1: (rows[0][1], 4, 0), 2: ("And ornd!\n\ny", 5, 2), 3: ("", 2, 2), None: ("x", 1, 0), 4: ("\n", 3, 1)}


def test_registered_setting_against_all_pairs(spark):
    """Lines of any length at the setting of the query: equal ones below 20 characters, near ones above."""
    rng = random.Random(21)
    base = ["".join(rng.choice("abc d") for _ in range(rng.choice([1, 5, 18, 22, 30]))) for _ in range(30)]
    rows = [(k, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2])) for _ in range(rng.randint(1, 5)))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = {}
    for k, t in rows:
        for n, x in enumerate(t.split("\n")):
            if x:
                at.setdefault(x, []).append((k, n))
    root = {x: x for x in at}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in at:
        for b in at:
            if a < b and min(len(a), len(b)) >= 20 and levenshtein(a, b) <= 2:
                root[find(a)] = find(b)
    classes = {}
    for x, places in at.items():
        classes.setdefault(find(x), []).extend(places)
    drop = {p for g in classes.values() for p in g if p != min(g)}
    got = {r.doc_id: (r.text, r.n_removed) for r in ln.dedup_lines(docs).collect()}
    assert got == {k: ("\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in drop), sum((k, n) in drop for n in range(t.count("\n") + 1)))
                   for k, t in rows}


def test_long_documents_and_clashing_columns(spark):
    text = "\n".join(f"line {k % 70_000}" for k in range(140_000))
    rows = [(1, text, 5, 6, "i"), (2, "line 3\nother", 7, 8, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_removed int, _id string")
    got = {r.doc_id: r for r in ln.dedup_lines(docs).collect()}
    assert got[1].n_lines == 140_000 and got[1].n_removed == 70_000 and got[1].text == "\n".join(f"line {k}" for k in range(70_000))
    assert (got[2].text, got[2].n_lines, got[2].n_removed, got[2]._id) == ("other", 2, 1, "j")


def test_documents_that_lose_no_line_stay_where_they_are(spark):
    rows = [(k, f"a line that only document {'abcdefghij'[k] * 9} has") for k in range(10)] + [(20, "a line of two documents"), (21, "a line of two documents")]
    got = ln.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {k: int(k == 21) for k, _ in rows}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join LeftAnti" in plan and plan.startswith("Union")
