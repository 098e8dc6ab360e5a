"""Packing invariants, held-out language accuracy, and the pipeline against a
plain restatement."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from causeway.llm import decontam, langid, packing, pii, quality
from conftest import SF001
from oracle_harness import duck
from test_dedup import plain_components, plain_contamination, vocabulary


# --- packing -----------------------------------------------------------------

def plain_best_fit(pieces, capacity):
    bins, out = [], []
    for n, s, c in pieces:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n and s not in b[1] and c not in b[2] and b[0] > 0]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        bins[i][0] -= n
        bins[i][1].add(s)
        bins[i][2].add(c)
        out.append(i)
    return out


def test_best_fit_equals_a_plain_search():
    rng = random.Random(1)
    for _ in range(30):
        pieces = sorted(((rng.randint(1, 40), rng.randrange(5), rng.randrange(30)) for _ in range(80)), reverse=True)
        got = packing.best_fit(*map(list, zip(*pieces)), capacity=40)
        assert got == plain_best_fit(pieces, 40)


def test_packing_invariants(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 64, 65, 200]))) + f" {i % 40}",
             rng.choice(["hot", "hot", "a", "b", None])) for i in range(400)]
    docs += [(1000, None, "a"), (1001, "", None), (None, "x y z", "a"), docs[3], docs[3]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("bin", F.lit("clash"))
    rows = packing.pack(df, capacity=64, shard=90).collect()
    words, bins = Counter(), defaultdict(list)
    for r in rows:
        words[r.doc_id] += r.n_words
        if r.bin is not None:
            bins[r.shard, r.bin].append(r)
    want = Counter()
    for d, t, _ in docs:
        want[d] += len((t or "").split())
    assert words == want and {r.doc_id for r in rows} == {d for d, *_ in docs}
    source = {(d, t): s for d, t, s in docs}
    by_id = {d: (t, s) for d, t, s in docs}
    assert source
    for members in bins.values():
        assert sum(r.n_words for r in members) <= 64
        at = 0
        for r in sorted(members, key=lambda r: r.place):
            assert r.place == at
            at += r.n_words
        assert len({by_id[r.doc_id][1] for r in members}) == len(members)
        assert len({by_id[r.doc_id][0] for r in members}) == len(members)
    assert len({r.shard for r in rows}) > 1
    assert packing.pack(df.limit(0)).count() == 0


def test_equal_rows_are_dealt_to_all_shards(spark):
    """Half of the rows are equal: no shard holds much more than its share."""
    rows = [(1, "same text here", "s") if i % 2 else (i, f"text {i}", f"s{i % 7}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, 50, 100).groupBy("shard").count().collect()
    assert len(got) == 20 and max(r["count"] for r in got) < 160
    assert sum(r["count"] for r in got) == 2000


def test_word_count_is_by_ascii_white_space(spark):
    texts = [None, "", " a\tb\n\x0bc\x0cd\re ", "é\x85ü x", "\x1ca b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(packing.n_words(F.col("t"))).collect()] == [len((t or "").encode().split()) for t in texts]


# --- language ----------------------------------------------------------------

def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF001.replace('0.001', '0.01')}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right >= 0.97


def plain_languages(rows):
    """(held out, language, score) per row (id, text, lang): a set of slots per
    language, one n-gram at a time."""
    def grams(t):
        t = f" {t.lower()} "
        c = [x if x.isalpha() else " " for x in t]
        return ["".join(c[i:i + 3]) for i in range(len(c) - 2) if c[i + 1] != " "]

    def places(g, bits):
        x = sum(ord(c) << (42 - 21 * i) for i, c in enumerate(g))
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) % 2 ** 64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2 ** 64
        x ^= x >> 31
        return [(x + i * ((x >> 32) | 1)) % 2 ** bits for i in range(langid.HASHES)]

    out = [i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    counts = {}
    for (_, t, lang), held in zip(rows, out):
        if not held and t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(t))
    share = {k: {g: n / sum(c.values()) for g, n in c.items() if n / sum(c.values()) >= langid.MIN_SHARE} for k, c in counts.items()}
    top = Counter()
    for s in share.values():
        for g, v in s.items():
            top[g] = max(top[g], v)
    bits = max(10, math.ceil(math.log2(max(1, langid.SLOTS_PER_GRAM * len(top)))))
    slots = {k: {p for g, v in s.items() if v * langid.DOMINANCE >= top[g] for p in places(g, bits)} for k, s in share.items()}
    found = []
    for (_, t, _), held in zip(rows, out):
        gs = grams(t) if t else []
        best = ("und", 0.0)
        for k in sorted(slots):
            hits = sum(all(p in slots[k] for p in places(g, bits)) for g in gs)
            rate = (len(slots[k]) / 2 ** bits) ** langid.HASHES
            score = min(1.0, max(0.0, (hits / len(gs) - rate) / max(1e-9, 1 - rate))) if gs else 0.0
            if gs and (best[0] == "und" or score > best[1]):
                best = (k, score)
        found.append((held, *best))
    return found


def test_language_query_equals_a_plain_restatement(spark):
    from causeway.llm.catalog import QUERIES

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, SF001).collect()}
    want = plain_languages([tuple(r) for r in docs])
    assert len(got) == len(docs)
    for d, (held, lang, score) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.held_out, r.lang_pred) == (held, lang) and abs(r.score - score) < 1e-9, d.doc_id


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "12 !", None),
            (None, "the dog", None), (6, "the dog and cat", None), (6, "the dog and cat", None), (7, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(docs.select("lang", "text"))
    out = langid.predict(docs, model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[6].lang_pred == "en" and by[2].lang_pred == "de" and 0 <= by[6].score <= 1
    assert by[3].lang_pred == by[4].lang_pred == by[7].lang_pred == "und" and by[None].held_out
    empty = langid.identify(docs.where("lang is null"))
    assert {r.lang_pred for r in empty.collect()} == {"und"}


def test_false_positive_correction():
    rows = [("a", g, 1e-3) for g in range(0, 2000, 2)] + [("b", g, 1e-3) for g in range(1, 2000, 2)]
    f = langid.Filters(rows, ["a", "b"])
    assert (f.false_rate < 0.05).all() and f.languages == ["a", "b"]


# --- pipeline ----------------------------------------------------------------

def test_pipeline_equals_a_plain_restatement(spark, tmp_path):
    rng = random.Random(7)
    ws = vocabulary(rng)
    text = lambda k: " ".join(rng.choice(ws) for _ in range(k))
    items = [(i, text(rng.randint(15, 40))) for i in range(10)]
    docs = []
    for i in range(60):
        t = text(rng.choice([10, 60, 150]))
        if i % 6 == 0:
            t += " " + items[i // 6][1]
        if i % 5 == 0:
            t += " write to a.b@mail.example.com please"
        docs.append((i, t, "en", f"s{i % 4}", len(t)))
        if i % 4 == 0:
            w = t.split()
            w[-1] = "changed"
            docs.append((100 + i, " ".join(w), "en", "s9", 1))
    docs += [(300, None, None, None, None), (301, "", "en", "s1", 0), docs[5], docs[5]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    passed = {}
    for d, t, *_ in docs:
        m = quality.measure((t or "").encode())
        if m[0] >= 50 and 100 * m[5] <= 50 * m[0]:
            passed[d] = t
    groups = plain_components(list(passed.items()))
    kept = {d: t for d, t in passed.items() if groups[d][1] == d}
    leaks = plain_contamination(list(kept.items()), items)
    kept = {d: pii.redact(t) for d, t in kept.items() if not leaks[d]}
    assert 5 < len(kept) < len(passed) < len(docs)

    folder, stage_docs = None, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = stage(spark, stage_docs, str(tmp_path))
        assert stage_docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r.doc_id: r.text for r in stage_docs.collect()} == kept
    assert folder is None
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_words for r in rows} == {d: len(t.split()) for d, t in kept.items()}


# --- SQL twins -----------------------------------------------------------------

@pytest.mark.parametrize("name", ["op4_quality_rules", "op5_warc"])
def test_sql_twin(spark, name):
    from causeway.llm.catalog import QUERIES
    from causeway.llm.oracle import ORACLE

    got = sorted(map(tuple, QUERIES[name](spark, SF001).collect()), key=str)
    cols = QUERIES[name](spark, SF001).columns
    want = duck(SF001).execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert got == sorted(want, key=str)


def test_decontamination_finds_planted_items(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    got = {r.doc_id: r.item_ids for r in decontam.contamination(docs, bench).where("contaminated").collect()}
    exact = {d for d, t in texts.items() if any(x in t for x in items.values())}
    assert exact <= set(got)
