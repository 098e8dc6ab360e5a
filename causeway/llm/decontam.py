"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item of m words is looked for in all windows of m words of a
document (the whole document if it is shorter).

1. A window can only be similar if it shares a five-word shingle with the
   item, so windows without one are not fingerprinted.
2. 64-bit SimHash fingerprints of the windows' shingles, each counted alike.
   For every item, a multi-index over radius + 1 bit blocks finds all windows
   of its size within its radius (at least one block is equal), then the
   distance is taken.  What lies beyond the radius is not looked at again.
3. The exact weighted-shingle similarity of window and item, sum of minima
   over sum of maxima of the shingle counts, must be at least ``SIMILARITY``.
   A shingle of the item weighs 1 / (number of items that hold it), one that
   only the window holds weighs 1: the score of a pair depends on nothing else,
   so it is the same however the benchmark is cut into blocks.

The radius follows from the weights.  Let W be the weight of all shingles of
an item of m shingles, and let u of the window's be foreign.  A similarity of
0.8 means u <= W / 4, so the fingerprints' vectors have a cosine of at least
1 - W / (4m) up to chance agreement; the radius is the expected distance at
that cosine plus ``SPREADS`` standard deviations (25 bits where no shingle is
shared between items, 12 where eight items share each).  A pair at the very
limit is missed with a probability of about one in a thousand, others with
less; ``Index.allowed`` states the lossless bound that the tests hold it
against.

Words are lower-cased, split at ASCII white space and stripped of ASCII
punctuation; items of fewer than five words are one shingle.  With
``short_items`` such an item of m words, three or more, is looked for in all
windows of m words too (a window is equal or not similar at all); a shorter one,
or any without the switch, only matches a whole document of m words: one word
of a benchmark says nothing about a long text.

The benchmark is a query set.  Its texts are shingled and its holders counted
by Spark jobs; the driver gets the shingles of one block of about
``BLOCK_SHINGLES`` at a time (the bound of a broadcast), the tasks build the
index from them, and each block runs against all documents.  A text is read in
pieces and windows are compared in stretches of ``STRETCH`` shingles, so a
long text costs 8 bytes per word.  Null texts and items match nothing; repeated
items count once; a document is an id (see common).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from math import acos, ceil, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import cut, text_batches

SHINGLE = 5
SIMILARITY = 0.8
SPREADS = 3.0
BLOCK_SHINGLES = 500_000
#: Least words of a short item that is looked for inside longer texts.
SHORT_WORDS = 3
#: Windows of a text that are compared at a time, and bytes of it read at a time.
STRETCH, PIECE = 1 << 16, 1 << 20

_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.arange(64, dtype=np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(_STRIP) for x in (text or "").lower().encode("utf-8", "replace").split()) if w]


def _word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words, piece by piece."""
    body = (text or "").lower().encode("utf-8", "replace")
    parts, at = [], 0
    while at < len(body):
        end = _WHITE.search(body, at + PIECE)
        to = end.start() if end else len(body)
        parts.append(np.fromiter((xxh3_64_intdigest(w) for w in (x.strip(_STRIP) for x in body[at:to].split()) if w), np.uint64))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _shingled(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, size)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + h[i:n - size + 1 + i]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def shingles(ws: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles of ``size`` words, in order."""
    return _shingled(np.fromiter((xxh3_64_intdigest(w) for w in ws), np.uint64, len(ws)), size)


def _simhashes(sh: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` shingles at ``starts``."""
    signed = ((sh[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    total = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(signed, axis=0, dtype=np.int32)])
    positive = (total[starts + size] - total[starts]) > 0
    return (positive.astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def radius(weight: float, n: int) -> int:
    """Bits within which an item of n shingles that weigh ``weight`` together finds
    the windows similar to it."""
    p = acos(max(-1.0, 1.0 - weight / (4.0 * n))) / pi
    return min(31, ceil(64 * p + SPREADS * (64 * p * (1 - p)) ** 0.5))


def _blocks(fingerprint: int, edges: list[int]) -> list[int]:
    return [(fingerprint >> a) & ((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def _edges(r: int) -> list[int]:
    return [round(64 * i / (r + 1)) for i in range(r + 2)]


class Index:
    """One block of benchmark items: rows (item id, words, shingles in order,
    {shingle: number of items that hold it}).  Made into tables on first use."""

    def __init__(self, rows: list[tuple[int, int, list[int], dict[int, int]]], short_items: bool = False):
        self.rows, self.short_items = rows, short_items

    @cached_property
    def items(self) -> list[tuple[int, int, Counter, int]]:
        """(id, shingles, counts, fingerprint) of every item."""
        out = []
        for item_id, _, sh, _ in self.rows:
            a = np.array([x % 2 ** 64 for x in sh], np.uint64)      # longs are read as unsigned
            out.append((item_id, len(sh), Counter(a.tolist()), int(_simhashes(a, np.zeros(1, np.int64), len(a))[0])))
        return out

    @cached_property
    def weights(self) -> list[dict[int, float]]:
        return [{x % 2 ** 64: 1.0 / n for x, n in held.items()} for *_, held in self.rows]

    @cached_property
    def totals(self) -> list[float]:
        return [sum(w[x] * n for x, n in item[2].items()) for item, w in zip(self.items, self.weights)]

    @cached_property
    def holders(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = defaultdict(list)
        for i, (_, _, counts, _) in enumerate(self.items):
            for x in counts:
                out[x].append(i)
        return dict(out)

    @cached_property
    def known(self) -> np.ndarray:
        return np.array(sorted(self.holders), np.uint64)

    @cached_property
    def radii(self) -> list[int]:
        return [radius(w, n) for w, (_, n, _, _) in zip(self.totals, self.items)]

    @cached_property
    def lookup(self) -> dict[int, dict[int, list[dict[int, list[int]]]]]:
        """Per item size and radius, for each of radius + 1 blocks: its value's items."""
        out: dict[int, dict[int, list[dict[int, list[int]]]]] = {}
        for i, ((_, n, _, f), r) in enumerate(zip(self.items, self.radii)):
            tables = out.setdefault(n, {}).setdefault(r, [defaultdict(list) for _ in range(r + 1)])
            for table, value in zip(tables, _blocks(f, _edges(r))):
                table[value].append(i)
        return out

    @cached_property
    def short(self) -> dict[int, dict[int, list[int]]]:
        """Per number of words: the short items with that one shingle."""
        out: dict[int, dict[int, list[int]]] = {}
        for i, (_, n_words, sh, _) in enumerate(self.rows):
            if self.short_items and SHORT_WORDS <= n_words < SHINGLE:
                out.setdefault(n_words, {}).setdefault(sh[0] % 2 ** 64, []).append(i)
        return out

    def similarity(self, window: Counter, item: int) -> float:
        counts, weight = self.items[item][2], self.weights[item]
        low = high = 0.0
        for x in window.keys() | counts.keys():
            w = weight.get(x, 1.0)
            low += w * min(window.get(x, 0), counts.get(x, 0))
            high += w * max(window.get(x, 0), counts.get(x, 0))
        return low / high if high else 0.0

    def near(self, m: int, fingerprint: int) -> set[int]:
        """Items of m shingles whose radius the fingerprint is within."""
        out = set()
        for r, tables in self.lookup.get(m, {}).items():
            seen = {i for table, value in zip(tables, _blocks(fingerprint, _edges(r))) for i in table.get(value, ())}
            out |= {i for i in seen if (fingerprint ^ self.items[i][3]).bit_count() <= r}
        return out

    def allowed(self, window: Counter, item: int) -> bool:
        """Whether the weight that window and item share allows the similarity: the
        lossless bound the fingerprints are measured against in the tests."""
        shared = sum(self.weights[item].get(x, 0.0) * n for x, n in window.items())
        foreign = sum(n for x, n in window.items() if x not in self.weights[item])
        return shared >= SIMILARITY * (self.totals[item] + foreign) - 1e-9

    def find(self, text: str | None) -> list[tuple[int, float, int]]:
        """(item id, similarity, first word of the best window) of the items
        the text holds."""
        if not len(self.known):
            return []
        h = _word_hashes(text)
        if not len(h):
            return []
        best: dict[int, tuple[float, int]] = {}
        for size, items in self.short.items():
            for s, x in enumerate(_shingled(h, size).tolist()):
                for i in items.get(x, ()):
                    best.setdefault(i, (1.0, s))
        sh = _shingled(h, SHINGLE)
        widest = max(n for _, n, _, _ in self.items)
        for first in range(0, len(sh), STRETCH):
            self._find_long(sh, first, widest, best)
        return sorted((self.items[i][0], sim, s) for i, (sim, s) in best.items())

    def _find_long(self, sh: np.ndarray, first: int, widest: int, best: dict[int, tuple[float, int]]) -> None:
        """Adds the items found in the windows that start in the stretch at ``first``."""
        part = sh[first:first + STRETCH + widest]
        at = np.searchsorted(self.known, part)
        hits = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == part)
        if not len(hits):
            return
        by_size: dict[int, list[np.ndarray]] = defaultdict(list)
        for p in hits.tolist():
            for m in {self.items[i][1] for i in self.holders[int(part[p])]}:
                by_size[m].append(np.arange(max(0, p - m + 1), max(0, min(p, len(part) - m, STRETCH - 1)) + 1))
        for m, where in by_size.items():
            size = min(m, len(part))
            starts = np.unique(np.concatenate(where))
            if first:       # a window at the end of a text is whole; others begin where they begin
                starts = starts[starts + m <= len(part)]
            if not len(starts):
                continue
            lo, hi = int(starts[0]), int(starts[-1]) + size
            for s, f in zip(starts.tolist(), _simhashes(part[lo:hi], starts - lo, size).tolist()):
                near = self.near(m, f)
                if near:
                    window = Counter(part[s:s + size].tolist())
                    for i in near:
                        sim = self.similarity(window, i)
                        if sim >= SIMILARITY - 1e-12 and sim > best.get(i, (0.0, 0))[0]:
                            best[i] = (sim, first + s)


# ------------------------------------------------------------ the benchmark
def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, n_words, lists = [], [], []
        for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h = _word_hashes(text)
            if len(h):
                ids.append(item_id)
                n_words.append(len(h))
                lists.append(_shingled(h, SHINGLE).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()),
                                          pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "n_words", "shingles"])


def benchmark_rows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words, shingles, held): one row per item with words; held are
    its distinct shingles with the number of items that hold them, counted over
    the whole benchmark."""
    items = cut(benchmark.where("text is not null").groupBy(F.col("item_id").cast("long").alias("item_id"))
                .agg(F.max("text").alias("text"))
                .mapInArrow(_item_shingles, "item_id long, n_words long, shingles array<long>"))
    each = items.select("item_id", F.explode(F.array_distinct("shingles")).alias("x"))
    held = each.groupBy("x").agg(F.count("*").alias("n"))
    of_item = (each.join(held, "x").groupBy(F.col("item_id").alias("of"))
               .agg(F.collect_list(F.struct("x", "n")).alias("held")))
    # a null id is an item too
    return (items.join(of_item, F.col("item_id").eqNullSafe(F.col("of")))
            .select("item_id", "n_words", "shingles", "held"))


def index_blocks(benchmark: DataFrame, short_items: bool = False) -> Iterator[Index]:
    """The benchmark (item_id, text) in blocks of bounded size."""
    rows = cut(benchmark_rows(benchmark))
    total = rows.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    for b in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        yield Index([(r.item_id, r.n_words, r.shingles, {h.x: h.n for h in r.held}) for r in mine], short_items)


def contamination(docs: DataFrame, benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """Per doc_id: contaminated, item_ids (comma-joined, in order), n_items
    and similarity (of the best window, 0 without one)."""
    text_batches(docs.sparkSession)
    found = None
    for index in index_blocks(benchmark, short_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [shared.value.find(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([[i for i, *_ in r] for r in rows], pa.list_(pa.int64())),
                     pa.array([max((s for _, s, _ in r), default=0.0) for r in rows], pa.float64())],
                    names=["doc_id", "items", "similarity"])

        part = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                .mapInArrow(run, "doc_id long, items array<long>, similarity double"))
        found = part if found is None else found.unionByName(part)
    merged = (found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                          F.max("similarity").alias("similarity")))
    return merged.select("doc_id", (F.size("items") > 0).alias("contaminated"),
                         F.array_join("items", ",").alias("item_ids"),
                         F.size("items").cast("long").alias("n_items"), "similarity")


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; no shuffle."""
    def clean(shared):
        @F.pandas_udf(T.BooleanType())
        def holds_none(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: not shared.value.find(t)).astype(bool)
        return holds_none

    text_batches(docs.sparkSession)
    out = docs
    for index in index_blocks(benchmark, short_items):
        out = out.where(clean(docs.sparkSession.sparkContext.broadcast(index))(F.col("text")))
    return out
