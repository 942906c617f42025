"""Quality and language models: held-out accuracy, brute force, odd rows."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from edgeloom.llm import language, quality, queries
from edgeloom.llm import text as tx

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in queries.op2_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [k for k in labels if got[k].held_out]
    assert np.mean([got[k].predicted == labels[k] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some words"), (3, "BAD!! BAD!!"), (3, "BAD!! BAD!!"), (4, "fine words " * 30_000)],
                                 "doc_id long, text string").selectExpr("*", "'x' as score", "1 as quality", "2 as held_out")
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, None), (None, 1), (9, 7)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_ftrl_separates():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        y = int(rng.integers(2))
        rows.append((np.array([0, 1 + y, 3 + int(rng.integers(5))]), np.ones(3) / 2, y))
    w = quality.ftrl(rows, 10, epochs=5)
    assert w[2] > 0.5 and w[1] < -0.5 and abs(w[3:8]).max() < 0.5


def test_language_held_out(spark):
    got = {r.doc_id: r for r in queries.op3_language(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [k for k in truth if got[k].held_out]
    assert np.mean([got[k].lang_pred == truth[k] for k in held]) > 0.97


def test_language_against_plain_counts(spark):
    train = [("en", "the cat and the dog"), ("en", "a thing"), ("fr", "le chat, et le chien"), ("fr", "Été"), (None, "xx"), ("de", "12 !")]
    ask = [(1, "THE dog"), (2, "chien"), (3, "été!"), (4, ""), (5, None), (6, "42 – ?"), (7, "𝒳 thing")]
    labelled = spark.createDataFrame(train, "lang string, text string")
    docs = spark.createDataFrame([(k, t, True) for k, t in ask], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in language.identify(docs, labelled, buckets=2 ** 20).collect()}

    def grams(t):
        low = [c.lower() if c.isalpha() else " " for c in t]
        return Counter(tuple(low[a:a + n]) for n in (1, 2, 3) for a in range(len(low) - n + 1))

    counts = {lang: sum((grams(t) for x, t in train if x == lang), Counter()) for lang in ("en", "fr")}
    for k, t in ask:
        if not any(c.isalpha() for c in t or ""):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        score = {lang: math.log(0.5) + sum(n * math.log((c[g] + 0.5) / (c.total() + 0.5 * 2 ** 20)) for g, n in grams(t).items())
                 for lang, c in counts.items()}
        best = max(score, key=score.get)
        assert got[k].lang_pred == best
        assert got[k].score == pytest.approx(1 / sum(math.exp(s - score[best]) for s in score.values()), abs=1e-3)


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "words", False)], "doc_id long, text string, held_out boolean")
    empty = spark.createDataFrame([], "lang string, text string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs, empty).collect()] == [("und", 0.0)]
    assert language.identify(docs.limit(0), empty).count() == 0


def plain_features(text, dimensions):
    """One text token by token; the hashes are those of the operator, taken one at a time."""
    data = (text or "").encode()
    tokens, k = [], 0
    kind = lambda b: 0 if b in b" \t\n\x0b\x0c\r" else 2 if 33 <= b < 127 and not chr(b).isalnum() else 1
    while k < len(data):
        e = k
        while e < len(data) and kind(data[e]) == kind(data[k]):
            e += 1
        if kind(data[k]):
            tokens.append((kind(data[k]), data[k:e]))
        k = e
    mix = lambda x: int(tx.mix(np.array([x % 2**64], np.uint64))[0])
    low = [t.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for _, t in tokens]
    names = [int(tx.Prefix(np.frombuffer(t, np.uint8)).of(np.array([0]), np.array([len(t)]))[0]) for t in low]
    forms = []
    for k, (what, t) in enumerate(tokens):
        up, down = sum(65 <= b <= 90 for b in t), sum(97 <= b <= 122 for b in t)
        form = 1 if up == 0 else 2 if down == 0 and up > 1 else 3
        form += sum(10 * back for back in (1, 2) if k >= back and names[k] == names[k - back])
        forms.append(mix(names[k] if what == 2 else form))
    out = {0: 1.0}
    for view, (stream, most) in enumerate(((names, 2), (forms, 3))):
        count = Counter()
        for n in range(1, most + 1):
            for k in range(len(stream) - n + 1):
                h = stream[k]
                for x in stream[k + 1:k + n]:
                    h = mix(h * 0x9DDFEA08EB382D69 + x)
                count[view * (dimensions // 2) + 1 + mix(h + 977 * n + view) % (dimensions // 2 - 1)] += 1
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in count.values()))
        out.update({k: math.log1p(c) / norm for k, c in count.items()})
    return out


def test_quality_whole_table_recomputed_plainly(spark):
    small, dim = SF.replace("sf0.01", "sf0.001"), quality.DIMENSIONS
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    learn, rows = quality.sample_labels(docs.filter(quality.fold() != 1), labels.filter(quality.fold() != 1))
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = {r.doc_id: plain_features(r.text, dim) for r in docs.collect()}
    shards = -(-rows // quality.SHARD_ROWS)
    epochs = min(max(-(-quality.UPDATES // max(1, rows // shards)), 2), 40)
    order = learn.selectExpr("doc_id", "quality", "xxhash64(doc_id, 11) as o", f"pmod(xxhash64(doc_id, 5), {shards}) as shard").collect()
    assert {r.doc_id: r.quality for r in order} == {k: v for k, v in known.items() if k in texts}
    average = Counter()
    for shard in range(shards):
        z, n = Counter(), Counter()

        def weight(i, z=z, n=n):
            if abs(z[i]) <= quality.L1:
                return 0.0
            return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

        for _ in range(epochs):
            for r in sorted((r for r in order if r.shard == shard), key=lambda r: (r.o, r.doc_id)):
                x = texts[r.doc_id]
                w = {i: weight(i) for i in x}
                p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
                for i, v in x.items():
                    g = (p - r.quality) * v
                    z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                    n[i] += g * g
        for i in list(z):
            average[i] += weight(i) / shards
    got = {r.doc_id: r for r in queries.op2_quality(spark, small).collect()}
    assert got.keys() == texts.keys()
    for k, x in texts.items():
        want = 1 / (1 + math.exp(-sum(average[i] * v for i, v in x.items())))
        assert got[k].score == pytest.approx(want, abs=1e-7)
        assert got[k].predicted == int(got[k].score >= 0.5)


def test_scoring_takes_little_memory_at_once():
    texts = pa.array(["Some words, and Some more: of them " * 60] * 4000)  # 8 MB
    tracemalloc.start()
    try:
        for _, data, offsets in tx.slices(texts):
            quality.features(data, offsets)
        assert tracemalloc.get_traced_memory()[1] < 64_000_000
    finally:
        tracemalloc.stop()
