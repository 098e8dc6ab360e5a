"""Chunk dedup, decontamination and near-duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from causeway.llm import chunk_dedup, decontam, near_dups

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("row", T.StringType()), T.StructField("n", T.IntegerType())])


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], DOCS).repartition(parts)


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 9))) for _ in range(n)]


# --- chunks ----------------------------------------------------------------

def plain_gear(body):
    out, h = [], 0
    for b in body:
        h = (h * 2 + int(chunk_dedup._GEAR[b])) % 2 ** 32
        out.append(h)
    return out


def plain_chunk_dedup(docs):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        body = (t or "").encode()
        ends = chunk_dedup.chunk_ends(body)
        repeat = []
        for a, b in zip([0, *ends], ends):
            if body[a:b] in seen:
                if repeat and repeat[-1][1] == a:
                    repeat[-1][1] = b
                else:
                    repeat.append([a, b])
            seen.add(body[a:b])
        gone = [(a, b) for a, b in repeat if b - a >= chunk_dedup.MIN_RUN or b - a == len(body)]
        kept, last = b"", 0
        for a, b in gone:
            kept, last = kept + body[last:a], b
        out[d] = (len(body), sum(b - a for a, b in gone), hashlib.sha256(kept + body[last:]).hexdigest())
    return out


def test_gear_and_chunk_sizes():
    rng = random.Random(1)
    for n in (1, 5, 40, 3000):
        body = bytes(rng.randrange(256) for _ in range(n))
        assert chunk_dedup.gear(body).tolist() == plain_gear(body)
    body = bytes(rng.randrange(97, 110) for _ in range(20_000)) + b"a" * 5000
    ends = chunk_dedup.chunk_ends(body)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(body) and sizes[:-1].min() >= 24 and sizes.max() <= 256
    # an insertion only changes the chunks around it
    other = body[:3000] + b"inserted" + body[3000:]
    cut = lambda b: {b[x:y] for x, y in zip([0, *chunk_dedup.chunk_ends(b)], chunk_dedup.chunk_ends(b))}
    assert len(cut(body) - cut(other)) <= 6


def test_chunk_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    ws = vocabulary(rng)
    text = lambda k: " ".join(rng.choice(ws) for _ in range(k))
    passages = [text(60) for _ in range(4)]
    docs = [(i * 3, text(rng.randint(0, 120)) + rng.choice(["", " "]) + rng.choice(passages) + text(rng.randint(0, 50)))
            for i in range(80)]
    docs += [(1, docs[0][1]), (2, None), (4, ""), (5, "tiny"), (7, "tiny"), (None, docs[3][1]), (8, text(20_000))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256)
           for r in chunk_dedup.chunk_dedup(frame(spark, docs + docs[:5])).collect()}
    assert got == plain_chunk_dedup(docs)
    hit = sum(got[i * 3][1] > 0 for i in range(80))
    assert hit >= 70
    assert chunk_dedup.chunk_dedup(frame(spark, [])).count() == 0


# --- decontamination ---------------------------------------------------------

def plain_similarity(item, window, weight):
    a, b = Counter(item), Counter(window)
    of = lambda x: weight[x] if x in a else 1  # noqa: E731  what only the window holds weighs 1
    low = sum(of(x) * min(a[x], b[x]) for x in a | b)
    return low / sum(of(x) * max(a[x], b[x]) for x in a | b)


def plain_contamination(docs, items):
    sh = lambda t: decontam.shingles(decontam.words(t)).tolist()
    parsed = {i: s for i, t in dict(items).items() if (s := sh(t))}
    holders = Counter(x for s in parsed.values() for x in set(s))
    weight = {x: 1 / n for x, n in holders.items()}
    out = {}
    for d, t in docs:
        s = sh(t)
        out[d] = sorted(i for i, item in parsed.items() if s and max(
            plain_similarity(item, s[a:a + len(item)], weight)
            for a in range(max(1, len(s) - len(item) + 1))) >= 0.8)
    return out


def test_decontamination_matches_all_windows(spark, monkeypatch):
    rng = random.Random(3)
    ws = vocabulary(rng, 150)
    text = lambda k: [rng.choice(ws) for _ in range(k)]
    items = [(i, " ".join(text(rng.choice([1, 3, 5, 6, 15, 30, 58])))) for i in range(40)]
    items += [(40, None), (41, ""), (42, items[5][1]), (5, items[5][1]), (43, items[20][1] + " more")]
    docs = []
    for i in range(120):
        w = text(rng.randint(0, 150))
        if i % 2:
            p = (rng.choice(items[:40])[1]).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if p:
                    p[rng.randrange(len(p))] = rng.choice(ws)
            w[rng.randint(0, len(w)):0] = [x.upper() + "," if rng.random() < .3 else x for x in p[rng.choice([0, 0, 1, 4]):]]
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (None, items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = plain_contamination(docs, [(i, t or "") for i, t in items])
    for bound in (decontam.BLOCK_SHINGLES, 200):
        monkeypatch.setattr(decontam, "BLOCK_SHINGLES", bound)
        got = {r.doc_id: [int(x) for x in r.item_ids.split(",") if x]
               for r in decontam.contamination(frame(spark, docs), bench).collect()}
        assert got == want and sum(len(v) for v in got.values()) > 10     # the same whatever the blocks
    clean = decontam.decontaminate_stage(frame(spark, docs), bench)
    assert clean.columns == DOCS.names and clean.count() <= len(docs)
    assert decontam.contamination(frame(spark, docs), bench.limit(0)).where("contaminated").count() == 0


def index_of(items):
    """An index without Spark: rows as benchmark_rows gives them."""
    parsed = [(i, decontam.words(t)) for i, t in items]
    held = Counter(x for _, w in parsed for x in set(decontam.shingles(w).tolist()))
    return decontam.Index([(i, len(w), (sh := decontam.shingles(w).tolist()), {x: held[x] for x in sh}) for i, w in parsed])


def test_leaks_of_repeated_items_are_found():
    """An unknown shingle outweighs many shared ones: leaks are found at any weighting."""
    rng = random.Random(11)
    ws = vocabulary(rng, 3000)
    found = 0
    for n, copies in ((55, 8), (30, 5), (40, 8), (55, 10), (55, 5)):
        text = [rng.choice(ws) for _ in range(n + 4)]
        items = [(i, " ".join(text)) for i in range(copies)] + [(99, " ".join(rng.choice(ws) for _ in range(n + 4)))]
        leak = [*text[:-1], "changed"]
        docs = [(k, " ".join([rng.choice(ws) for _ in range(k)] + leak + [rng.choice(ws) for _ in range(30)])) for k in range(5)]
        want = plain_contamination(docs, items)
        index = index_of(items)
        for d, t in docs:
            assert sorted(i for i, *_ in index.find(t)) == want[d]
            found += len(want[d])
    assert found == 5 * (8 + 5 + 8 + 10 + 5)


def uneven_pairs(rng, ws, n_items=60):
    """Items with a shared template, and texts in which words of one are replaced."""
    template = [rng.choice(ws) for _ in range(60)]
    items = []
    for i in range(n_items):
        k = rng.randint(0, 40)
        items.append((i, " ".join(template[:k] + [rng.choice(ws) for _ in range(rng.randint(15, 40))])))
    texts = []
    for i, t in items:
        w = t.split()
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = "zzz%d" % rng.randrange(10**6)
        texts.append(" ".join([rng.choice(ws) for _ in range(20)] + w + [rng.choice(ws) for _ in range(20)]))
    return items, texts


def test_fingerprints_decide_and_their_recall_is_high():
    """Against the lossless bound: of all windows that are similar, the radius
    lets pass 0.9 or more, all leaks are found, and without the lookup none is."""
    rng = random.Random(21)
    ws = vocabulary(rng, 3000)
    passed = similar = tested = leaks = caught = 0
    for _ in range(6):
        items, texts = uneven_pairs(rng, ws)
        index = index_of(items)
        for text in texts:
            sh = decontam.shingles(decontam.words(text))
            true = set()
            for i, (item_id, m, _, _) in enumerate(index.items):
                for s in range(max(1, len(sh) - m + 1)):
                    window = Counter(sh[s:s + m].tolist())
                    if len(window) and index.allowed(window, i):
                        tested += 1
                        if index.similarity(window, i) >= 0.8 - 1e-12:
                            similar += 1
                            true.add(item_id)
                            f = int(decontam._simhashes(sh[s:s + m], np.zeros(1, np.int64), min(m, len(sh)))[0])
                            passed += i in index.near(m, f)
            got = {i for i, *_ in index.find(text)}
            assert got <= true
            leaks += len(true)
            caught += len(got)
    assert similar > 300 and passed >= 0.97 * similar and tested >= similar
    assert leaks > 150 and caught >= 0.99 * leaks
    index.lookup.clear()
    assert not any(index.find(t) for t in texts)


def test_radius_follows_the_weights():
    assert decontam.radius(50.0, 50) == 25 and decontam.radius(50 / 8, 50) == 12
    assert all(decontam.radius(w, 50) <= decontam.radius(w + 1, 50) for w in range(1, 50))


def test_very_long_texts_are_read_in_stretches(monkeypatch):
    """A text of 20 MB with an item at both ends and across a border of two stretches."""
    import tracemalloc

    rng = random.Random(22)
    ws = vocabulary(rng, 3000)
    items = [(i, " ".join(rng.choice(ws) for _ in range(30))) for i in range(3)]
    index = index_of(items)
    filler = " ".join(rng.choice(ws) for _ in range(5000))
    n = decontam.STRETCH // 5000
    middle = filler.split()[:decontam.STRETCH - 5000 * n - 45]
    text = " ".join([items[0][1], *[filler] * n, *middle, items[1][1], *[filler] * (20_000_000 // len(filler)), items[2][1]])
    assert len(text) > 20_000_000
    tracemalloc.start()
    got = index.find(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, *_ in got] == [0, 1, 2] and peak < 400e6
    words = decontam.words(text)
    assert all(words[s:s + 30] == decontam.words(items[i][1]) for i, _, s in got)
    monkeypatch.setattr(decontam, "STRETCH", 64)
    monkeypatch.setattr(decontam, "PIECE", 50)
    short = " ".join([filler[:2000], items[1][1], filler[:3000], items[0][1]])
    assert [i for i, *_ in index.find(short)] == [0, 1]


def test_short_items_are_found_inside_texts(spark, tmp_path):
    from causeway.llm.catalog import QUERIES

    rng = random.Random(12)
    ws = vocabulary(rng, 60)
    items = [(i, " ".join(rng.choice(ws) for _ in range(1 + i % 5))) for i in range(40)]
    docs = [(i, " ".join(rng.choice(ws) for _ in range(i % 40))) for i in range(120)]
    docs += [(500, "x " * 9 + items[13][1].upper() + ". " + "x " * 9), (501, items[2][1]), (502, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def holds(t, item):
        a, b = decontam.words(t), decontam.words(item)
        if len(b) < decontam.SHORT_WORDS:
            return a == b           # too short to be looked for inside a text
        return any(a[k:k + len(b)] == b for k in range(len(a) - len(b) + 1))
    want = {d: sorted(i for i, item in items if holds(t, item)) for d, t in docs}
    got = {r.doc_id: [int(x) for x in r.item_ids.split(",") if x]
           for r in QUERIES["op6_decontamination"](spark, str(tmp_path)).collect()}
    assert got == want and 13 in got[500] and 2 in got[501]
    clean = corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in clean.collect()} == {d for d, i in want.items() if not i}


# --- near-duplicates -----------------------------------------------------------

def plain_components(docs, pct=85):
    def s(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    sets = {d: s(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_corpus(seed):
    rng = random.Random(seed)
    ws = vocabulary(rng)
    docs = []
    for b in range(25):
        base = [rng.choice(ws) for _ in range(rng.choice([1, 3, 4, 5, 8, 40, 150, 400]))]
        for c in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(ws)
            docs.append((rng.randrange(10**9), rng.choice([" ", "\n", "\t "]).join(t).replace("a", rng.choice("aA"))))
    return docs


def result(spark, docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(frame(spark, docs)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_all_pairs(spark, seed):
    docs = near_corpus(seed)
    docs += [(1, None), (2, ""), (3, " \n"), (4, "Aé"), (5, "aé")]
    want = plain_components(docs)
    assert len({c for _, c in want.values()}) < len(docs)
    assert result(spark, docs + docs[:10]) == want


def test_dense_regions_and_blocks_lose_nothing(spark, monkeypatch):
    rng = random.Random(4)
    ws = vocabulary(rng)
    base = [rng.choice(ws) for _ in range(140)]
    docs = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(140)] = rng.choice(ws)
        docs.append((10 + i, " ".join(t)))
    want = plain_components(docs)
    monkeypatch.setattr(near_dups, "DENSE", 20)
    monkeypatch.setattr(near_dups, "BLOCK_DOCS", 30)
    assert result(spark, docs) == want


def test_null_id_empty_table_and_stage(spark):
    docs = [(None, "one two three four five six"), (7, "one two three four five six"), (8, "other words here")]
    got = result(spark, docs)
    assert got[None] == (2, None) and got[7] == (2, None) and got[8] == (1, 8)
    assert near_dups.near_duplicates(frame(spark, [])).count() == 0
    docs = near_corpus(6)
    out = near_dups.near_dedup_stage(frame(spark, docs + docs[:9]))
    assert out.columns == DOCS.names
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in plain_components(docs).values()})


@pytest.mark.parametrize("seed", [6, 7])
def test_pipeline_stage_links_from_eighty_percent(spark, seed):
    docs = near_corpus(seed)
    want = sorted({c for _, c in plain_components(docs, 80).values()})
    assert len(want) < len({c for _, c in plain_components(docs, 85).values()})
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, docs), "").collect()) == want


def test_plan_follows_from_the_similarity():
    assert near_dups.plan(85) == (85, 24, 5, 86)
    assert near_dups.plan(80) == (80, 30, 4, 78)
    with pytest.raises(ValueError):
        near_dups.plan(5)


def test_stage_drops_no_row_for_its_id_alone(spark):
    rng = random.Random(13)
    ws = vocabulary(rng)
    text = [" ".join(rng.choice(ws) for _ in range(40)) for _ in range(30)]
    near = text[4].rsplit(" ", 1)[0] + " changed"                   # 35 of 37 shingles
    longer = text[3] + " zzz" + text[6]
    docs = [(None, t) for t in text[:10]] + [(7, t) for t in text[10:20]] + [(20 + i, t) for i, t in enumerate(text[20:])]
    docs += [(None, text[1]), (7, text[11]), (50, near), (60, text[10]), (8, longer), (8, text[3]), (None, ""), (None, " "), (70, None)]
    got = Counter((r.doc_id, r.text) for r in near_dups.near_dedup_stage(frame(spark, docs)).collect())
    gone = {(50, near), (60, text[10]), (8, text[3])}
    assert got == Counter({d: 1 for d in docs if d not in gone})


def test_link_matrix_equals_sets():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**60, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(150, 200), replace=False),
                                      rng.integers(0, 2**60, rng.integers(0, 12)).astype(np.uint64)))) for _ in range(60)]
    got = near_dups.linked(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                both = len(np.intersect1d(a, b))
                assert got[i, j] == (100 * both >= 85 * (len(a) + len(b) - both))
