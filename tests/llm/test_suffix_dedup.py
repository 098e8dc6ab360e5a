"""Exact substring dedup against a byte-by-byte brute force."""

import hashlib
import random

import pytest
from pyspark.sql import types as T

from causeway.llm import suffix_dedup as S

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("body", T.StringType()), T.StructField("packed", T.IntegerType())])


def brute(docs, length=100):
    first, out = {}, {}
    bodies = sorted(((d, (t or "").encode()) for d, t in docs), key=lambda x: (x[0] is not None, x[0] or 0))
    for d, b in bodies:
        for i in range(len(b) - length + 1):
            first.setdefault(b[i:i + length], (d, i))
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] != (d, i):
                gone[i:i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, docs, parts=3, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(parts)
    return {r[0]: tuple(r[1:]) for r in S.suffix_dedup(df, **kw).collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randint(10, 60)) for _ in range(6)]
    docs = []
    for i in range(n):
        t = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            at = rng.randint(0, len(t))
            t = t[:at] + p[a:a + rng.randint(50, 300)] + t[at:]
        docs.append((rng.randint(0, 10**6) * 100 + i, t))
    docs += [(7, docs[0][1]), (8, docs[0][1]), (9, docs[1][1][:99]), (10, docs[1][1][:100])]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    docs = corpus(seed)
    assert run(spark, docs) == brute(docs)


def test_periodic_text_ties_and_long_text(spark):
    docs = [(1, "a" * 350), (2, "ab" * 300), (3, "x" * 99), (4, "x" * 100), (5, "x" * 101),
            (6, ("lorem ipsum dolor " * 40)), (7, "".join(chr(97 + (i * i) % 23) for i in range(30_000)))]
    assert run(spark, docs) == brute(docs)


def test_hot_kgrams_are_salted_without_change(spark, monkeypatch):
    rng = random.Random(5)
    line = "the same forty or more bytes occur in every one of these documents, always"
    docs = [(i, "".join(rng.choice("abcd") for _ in range(120)) + line + "".join(
        rng.choice("abcd") for _ in range(rng.choice([3, 120])))) for i in range(150)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(20)]
    monkeypatch.setattr(S, "HOT_NAMES", 2)
    assert run(spark, docs, parts=4) == brute(docs)


def test_nulls_empty_and_repeated_rows(spark):
    t = "word number one, two and three; " * 3 + "end of the unique text that is long enough to be judged"
    docs = [(None, t), (1, t), (2, None), (3, ""), (4, "short")]
    want = brute(docs)
    assert run(spark, docs + [(1, t), (4, "short")]) == want
    assert want[None][1] == 0 or want[None][2] >= 0
    assert want[1][1] == len(t)
    assert run(spark, []) == {}
