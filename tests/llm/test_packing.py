"""Packing: exact ids, exact covers, few sequences; the plan alone on hard histograms."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from edgeloom.llm import packing, tokens
from edgeloom.llm import text as tx

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    tok = Tokenizer.from_file(FILE)
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check(rows, texts, limit=4096):
    """Rows against plain tokenising, and sequences against their own definition; the number of sequences."""
    want = {}
    for k, ids in texts:
        for p, s in enumerate(range(0, len(ids), limit)):
            x = ids[s:s + limit]
            want.setdefault((k, p, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_whole_table(spark):
    rows = packing.op11_packed_sequences(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = list(zip([r.doc_id for r in docs], ids_of([r.text for r in docs]), strict=True))
    total = sum(len(x) for _, x in texts)
    assert check(rows, texts) <= -(-total // 4096) + 1


def test_odd_rows(spark):
    data = [(1, None), (2, ""), (None, "null id"), (3, "twice"), (3, "twice"), (4, "it's <|endoftext|> x"), (5, "word " * 9000),
            (6, "a " * 4095), (7, "a " * 4096), (8, "\n\t"), (9, "ÀB é 12 中")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in data], "doc_id int, text string, length int, sequence_id string").repartition(3)
    texts = list(zip([k for k, _ in data], ids_of([t for _, t in data]), strict=True))
    out = packing.pack(docs, FILE, keep_ids=True)
    rows = out.collect()
    check(rows, texts)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert check(packing.pack(docs, FILE, limit=7).collect(), texts, 7) <= 1.02 * sum(len(x) for _, x in texts) / 7 + 1
    assert packing.pack(docs.limit(0), FILE).count() == 0


def replay(counts, limit):
    """Every piece of a plan placed once, no sequence overfull; the number of sequences."""
    p = packing.plan(counts, limit)
    seen, full = np.zeros(limit + 1, np.int64), {}
    for length, rank, each, times, sequence, offset in zip(*p.values(), strict=True):
        assert rank == seen[length]
        seen[length] += each * times
        for s in range(sequence, sequence + times):
            full.setdefault(s, []).append((offset, each * length))
    assert (seen[1:] == counts[1:]).all()
    for parts in full.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= limit
    return len(full)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    counts = np.zeros(4097, np.int64)
    for _ in range([1, 5, 400, 4000, 4000, 20_000][seed]):
        counts[min(4096, int(rng.lognormvariate([1, 3, 6, 6, 7, 5][seed], 1)) + 1)] += rng.choice([1, 1, 30])
    counts[1] += [0, 5000, 0, 9000, 3, 0][seed]
    total = int((counts * np.arange(4097)).sum())
    assert -(-total // 4096) <= replay(counts, 4096) <= 1.01 * total / 4096 + 1


def test_plan_finds_the_only_perfect_packing():
    counts = np.zeros(101, np.int64)
    counts[[51, 49, 61, 30, 9, 100, 2]] = [7, 7, 4, 4, 4, 3, 50]
    assert replay(counts, 100) == 7 + 4 + 3 + 1
    assert replay(np.zeros(101, np.int64), 100) == 0


def test_parts_are_the_tokenizers_own():
    rng, tok = random.Random(1), Tokenizer.from_file(FILE)
    texts = ["", "it's O'Neil 'sun x.'s", "abc<|endoftext|>def", "ÀÉÎ ×÷ ß ÿ", "café é", "İ ΣΑΣ ος", "a b", "\u0085x", "12 3a4b", "_x_", "\x00a\x1cq"]
    texts += ["".join(rng.choice("aAbÉéñ'<|>.!? 12\n\t×ÿß́中") for _ in range(rng.randrange(30))) for _ in range(2000)]
    enc = tokens.Encoder(tok)
    for size in (1, 50, len(texts)):
        for k in range(0, min(len(texts), 100 * size), size):
            for row, data, offsets in tx.slices(pa.array(texts[k:k + size])):
                ids, first = enc.encode(data, offsets)
                for j in range(len(offsets) - 1):
                    assert list(ids[first[j]:first[j + 1]]) == tok.encode(texts[k + row + j], add_special_tokens=False).ids
