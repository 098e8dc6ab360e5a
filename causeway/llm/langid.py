"""Language identification with bit-sliced Bloom filters.

All languages share one table of slots; a slot is a bitmask with one bit per
language, so one lookup of an n-gram (the AND of its slots) returns every
language whose filter holds it.  A document's hits per language are
population counts of those masks, corrected for each filter's false-positive
rate; the largest corrected share of its n-grams decides (ties: the first
name in order).

n-grams are three code points of the lower-cased letters, words bounded by
one or more spaces.  A language's filter holds the n-grams with at least
``MIN_SHARE`` of all its n-gram occurrences, counted over all training
documents (so at most 1 / MIN_SHARE per language: the bound of what reaches
the driver and is broadcast), unless another language has it ``DOMINANCE``
times as often.  A null text or one without a letter is ``und``, score 0.
Rows are predicted one by one; a null doc_id counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SHARE = 1e-5
DOMINANCE = 20.0
HASHES = 3
SLOTS_PER_GRAM = 16
MAX_LANGUAGES = 1024
UNKNOWN = "und"
_GRAMS_AT_ONCE = 2_000_000

_LETTER = None


def _letters() -> np.ndarray:
    """True for every code point that is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str) -> np.ndarray:
    """The text's n-grams as exact 63-bit codes, in order, repeats included."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[a]
    c = np.where(letter, a, 32).astype(np.int64)
    code = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return code[letter[1:-1]]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)), F.lit(0)) == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) summed over at most _GRAMS_AT_ONCE occurrences."""
    pending: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in pending.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())],
                names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            g = grams(text)
            pending.setdefault(lang, []).append(g)
            size += len(g)
            if size > _GRAMS_AT_ONCE:
                yield from flush()
                pending, size = {}, 0
    yield from flush()


def gram_table(train: DataFrame) -> DataFrame:
    """(lang, gram, share) of the n-grams a filter may hold, from (lang, text)."""
    counts = (train.where("lang is not null and text is not null").select("lang", "text")
              .mapInArrow(_count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # one row per language: a size-checked broadcast or a join, as Spark finds
    return (counts.join(total, "lang").withColumn("share", F.col("n") / F.col("total"))
            .where(F.col("share") >= MIN_SHARE).select("lang", "gram", "share"))


class Filters:
    """The bit-sliced filters of all languages."""

    def __init__(self, rows: list[tuple[str, int, float]], languages: list[str]):
        self.languages = sorted(languages)
        index = {x: i for i, x in enumerate(self.languages)}
        top: dict[int, float] = {}
        for _, g, share in rows:
            top[g] = max(top.get(g, 0.0), share)
        kept = [(index[x], g) for x, g, share in rows if share * DOMINANCE >= top[g]]
        self.bits = max(10, int(np.ceil(np.log2(max(1, SLOTS_PER_GRAM * len(top))))))
        self.words = (len(self.languages) + 63) // 64
        self.slots = np.zeros((self.words, 1 << self.bits), np.uint64)
        if kept:
            lang = np.array([k for k, _ in kept])
            at = self._places(np.array([g for _, g in kept], np.int64))
            for w in range(self.words):
                mine = lang // 64 == w
                bit = np.uint64(1) << (lang[mine] % 64).astype(np.uint64)
                for p in at:
                    np.bitwise_or.at(self.slots[w], p[mine], bit)
        fill = [float(((self.slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
                for i in range(len(self.languages))]
        self.false_rate = np.array(fill) ** HASHES

    def _places(self, g: np.ndarray) -> list[np.ndarray]:
        x = g.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        step = (x >> np.uint64(32)) | np.uint64(1)
        mask = np.uint64((1 << self.bits) - 1)
        return [((x + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)]

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if text else np.zeros(0, np.int64)
        n = len(g)
        if not n or not self.languages:
            return UNKNOWN, 0.0
        places = self._places(g)
        hits = np.empty(len(self.languages))
        for w in range(self.words):
            mask = self.slots[w][places[0]]
            for p in places[1:]:
                mask = mask & self.slots[w][p]
            for i in range(64 * w, min(len(hits), 64 * w + 64)):
                hits[i] = np.count_nonzero(mask & (np.uint64(1) << np.uint64(i % 64)))
        share = np.clip((hits / n - self.false_rate) / np.maximum(1e-9, 1 - self.false_rate), 0.0, 1.0)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def train(docs: DataFrame) -> Filters:
    """Filters from (lang, text); the driver receives at most 1 / MIN_SHARE
    n-grams per language."""
    rows = [tuple(r) for r in gram_table(docs).collect()]
    languages = [r[0] for r in docs.where("lang is not null and text is not null")
                 .select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: lang is not a language column")
    return Filters(rows, languages)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = [model.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out, predicts all rows."""
    return predict(docs, train(docs.where(~held_out()).select("lang", "text")))
