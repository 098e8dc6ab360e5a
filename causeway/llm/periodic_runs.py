"""Periodic runs of words: stretches that repeat one phrase at least four times.

A run is a maximal stretch of consecutive words whose smallest period is q
(words q apart are the same) and whose length is at least max(6, 4q).

Block convolution finds them.  At scale L (1, 2, 4, ...) the words are cut
into aligned blocks of L.  A run with a period q in [L, 2L) keeps every place
equal to the one q further on for at least 3q >= 3L places, so it holds two
neighbouring blocks that occur again, word by word, q further on.  For each
block that can recur, the squared differences to every place of the following
window (distances L to 2L - 1) are summed exactly by a number-theoretic
transform modulo the prime 15 * 2^27 + 1:

    sum (b - t)^2 = sum b^2 + sum t^2 - 2 sum b t

with word codes small enough that no sum reaches the prime, so a sum of 0 is
a zero-mismatch occurrence of the codes.  Distances that two neighbouring
blocks share are the seeds; a seed is extended both ways over the words
themselves (codes may collide, words don't) and kept if q is the smallest
period.  A block can only recur if each of its words does, less than 2L words
further on; other blocks skip the transform.

Work is O(n log^2 n) for n words of a batch and memory O(n): transforms run
over at most ``CELLS`` numbers at a time (one block's, if that is longer).
A batch is cut into pieces of about ``PIECE_BYTES`` of text; a text is never
cut.  There is no shuffle: every document is one row's work.

A null or empty text has no words and no runs.  Rows are answered one by one:
repeated and null ids each get their row.  Input columns that are not named
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The prime 15 * 2^27 + 1 and a primitive root of it.
PRIME = 2013265921
ROOT = 31

#: Numbers a transform holds at once.
CELLS = 1 << 19
#: Bytes of text whose words are held at once.
PIECE_BYTES = 2 << 20

MIN_LENGTH, MIN_EXPONENT = 6, 4


# ------------------------------------------------------------ exact transform
_TWIDDLES: dict[tuple[int, bool], list[np.ndarray]] = {}


def _twiddles(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each halving of ``size``."""
    if (size, inverse) not in _TWIDDLES:
        out, n = [], size
        while n > 1:
            w = pow(ROOT, (PRIME - 1) // n, PRIME)
            w = pow(w, PRIME - 2, PRIME) if inverse else w
            powers = np.ones(n // 2, np.uint64)
            filled, step = 1, w
            while filled < n // 2:  # doubling: powers[k + filled] = powers[k] * w^filled
                powers[filled:2 * filled] = powers[:filled] * np.uint64(step) % np.uint64(PRIME)
                filled, step = 2 * filled, step * step % PRIME
            out.append(powers)
            n //= 2
        _TWIDDLES[size, inverse] = out
        if len(_TWIDDLES) > 64:
            _TWIDDLES.pop(next(iter(_TWIDDLES)))
    return _TWIDDLES[size, inverse]


def _forward(a: np.ndarray) -> np.ndarray:
    """Transform of each row (decimation in frequency: bit-reversed output)."""
    p, (rows, size) = np.uint64(PRIME), a.shape
    n = size
    for w in _twiddles(size, False):
        v = a.reshape(rows, size // n, 2, n // 2)
        low, high = v[:, :, 0], v[:, :, 1]
        a = np.empty_like(v)
        np.remainder(low + high, p, out=a[:, :, 0])
        np.remainder((low + (p - high)) * w, p, out=a[:, :, 1])
        n //= 2
    return a.reshape(rows, size)


def _backward(a: np.ndarray) -> np.ndarray:
    """Inverse of ``_forward``, without the division by the size."""
    p, (rows, size) = np.uint64(PRIME), a.shape
    n = 2
    for w in reversed(_twiddles(size, True)):
        v = a.reshape(rows, size // n, 2, n // 2)
        low, high = v[:, :, 0], v[:, :, 1] * w % p
        a = np.empty_like(v)
        np.remainder(low + high, p, out=a[:, :, 0])
        np.remainder(low + (p - high), p, out=a[:, :, 1])
        n *= 2
    return a.reshape(rows, size)


def zero_mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For blocks (rows of L codes) and windows (rows of 2L codes): whether the
    block equals the window from place d on, for d in 0..L-1 (rows x L)."""
    rows, length = blocks.shape
    p = np.uint64(PRIME)
    turned = np.zeros((rows, 2 * length), np.uint64)  # the block, read backwards around the circle
    turned[:, 0] = blocks[:, 0]
    turned[:, length + 1:] = blocks[:, :0:-1]
    w = windows.astype(np.uint64)
    shared = _backward(_forward(turned) * _forward(w) % p)[:, :length]
    shared = shared * np.uint64(pow(2 * length, PRIME - 2, PRIME)) % p  # exact: below the prime
    squares = np.zeros((rows, 2 * length + 1), np.int64)
    np.cumsum((w * w).astype(np.int64), axis=1, out=squares[:, 1:])
    own = (blocks.astype(np.int64) ** 2).sum(axis=1, keepdims=True)
    sums = own + squares[:, length:2 * length] - squares[:, :length] - 2 * shared.astype(np.int64)
    return sums == 0


def _codes(ids: np.ndarray, length: int) -> np.ndarray:
    """Word codes from 1 up, so small that L squared differences stay below the
    prime; 0 stands for places behind the end."""
    bits = max(1, (30 - (length - 1).bit_length()) // 2)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return (mixed % np.uint64((1 << bits) - 1)).astype(np.int64) + 1


# ------------------------------------------------------------ seeds and runs
def _gaps(ids: np.ndarray) -> np.ndarray:
    """Distance from each place to the next one with the same word."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, np.iinfo(np.int64).max // 2, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _seeds(ids: np.ndarray, length: int, able: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block number, distance) of all zero-mismatch occurrences of the blocks
    ``able``, distances length to 2 * length - 1."""
    codes = np.zeros(len(ids) + 3 * length, np.int64)
    codes[:len(ids)] = _codes(ids, length)
    per = max(1, CELLS // (2 * length))
    inside, ahead = np.arange(length), np.arange(length, 3 * length)
    for i in range(0, len(able), per):
        part = able[i:i + per]
        at = (part * length)[:, None]
        row, d = np.nonzero(zero_mismatch(codes[at + inside], codes[at + ahead]))
        yield part[row], d + length


def _stretch(ids: np.ndarray, q: int, lo: int, hi: int) -> tuple[int, int] | None:
    """The maximal stretch around [lo, hi) on which ids[j] == ids[j + q]; None
    if [lo, hi) itself differs somewhere."""
    if hi + q > len(ids) or not np.array_equal(ids[lo:hi], ids[lo + q:hi + q]):
        return None
    step = 16
    while lo:
        a = max(0, lo - step)
        bad = np.flatnonzero(ids[a:lo] != ids[a + q:lo + q])
        if len(bad):
            lo = a + int(bad[-1]) + 1
            break
        lo, step = a, 2 * step
    step, end = 16, len(ids) - q
    while hi < end:
        b = min(end, hi + step)
        bad = np.flatnonzero(ids[hi:b] != ids[hi + q:b + q])
        if len(bad):
            hi += int(bad[0])
            break
        hi, step = b, 2 * step
    return lo, hi


def _prime_factors(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + ([q] if q > 1 else [])


def find_runs(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of word numbers,
    by start, then period.  No run is longer than ``longest``."""
    n = len(ids)
    longest = n if longest is None else longest
    found: set[tuple[int, int, int]] = set()
    if n < MIN_LENGTH:
        return []
    reach = _gaps(ids)  # per block: the farthest next occurrence of one of its words
    run_end, run_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    length = 1
    while MIN_EXPONENT * length <= longest:
        able = np.flatnonzero(reach < 2 * length)
        # two neighbouring blocks are needed for a seed
        twin = np.zeros(len(able), bool)
        close = np.flatnonzero(np.diff(able) == 1)
        twin[close] = twin[close + 1] = True
        pairs = list(_seeds(ids, length, able[twin])) if twin.any() else []
        if pairs:
            block, dist = (np.concatenate(x) for x in zip(*pairs))
            start = block * length
            # a multiple of the period of a known run, inside that run, says nothing new
            known = (dist % run_period[start] == 0) & (start + dist + length <= run_end[start])
            block, dist = block[~known], dist[~known]
            o = np.lexsort((block, dist))
            block, dist = block[o], dist[o]
            breaks = np.flatnonzero((np.diff(block) != 1) | (np.diff(dist) != 0)) + 1
            edges = np.concatenate([[0], breaks, [len(block)]]) if len(block) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a < 2:
                    continue
                q = int(dist[a])
                at = _stretch(ids, q, int(block[a]) * length, (int(block[b - 1]) + 1) * length)
                if at is None:
                    # a collision of codes within the group: its blocks one by one
                    tries = {_stretch(ids, q, int(k) * length, (int(k) + 1) * length) for k in block[a:b]}
                else:
                    tries = {at}
                for s, e in (t for t in tries if t):
                    size = e - s + q
                    if size < max(MIN_LENGTH, MIN_EXPONENT * q):
                        continue
                    shorter = [q // f for f in _prime_factors(q)]
                    if any(np.array_equal(ids[s:s + q], ids[s + d:s + d + q]) for d in shorter):
                        continue  # q is not the smallest period
                    found.add((s, size, q))
                    wins = run_end[s:s + size] < s + size
                    run_end[s:s + size][wins] = s + size
                    run_period[s:s + size][wins] = q
        length *= 2
        reach = reach[:len(reach) // 2 * 2].reshape(-1, 2).max(axis=1)
    return sorted(found, key=lambda r: (r[0], r[2]))


# ------------------------------------------------------------ documents
def words_of(doc_id: int | None, text: bytes) -> list[bytes]:
    """Words of a text: stretches without space, tab, line feed, vertical tab,
    form feed and carriage return."""
    return text.split()


def _document(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    gone = np.zeros(len(words), bool)
    for s, size, q in runs:
        gone[s + q:s + size] = True
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    milli = 1000 * best[1] // best[2] if best else None
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if runs else b" ".join(words)
    return (len(runs), *(best or (None, None, None)), milli, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(kept).hexdigest(), len(words), int(gone.sum()))


def _piece(words: list[list[bytes]]) -> list[tuple]:
    """Result rows of some documents.  Their words stand in one sequence, with
    a word of its own behind each document (no run can hold one)."""
    fresh = count()
    number: dict[bytes, int] = defaultdict(fresh.__next__)
    parts, starts, at = [], [], 0
    for ws in words:
        starts.append(at)
        parts.append(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)))
        parts.append(np.array([next(fresh)], np.int64))
        at += len(ws) + 1
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    by_doc: list[list[tuple[int, int, int]]] = [[] for _ in words]
    runs = find_runs(ids, max(map(len, words), default=0))
    for d, (s, size, q) in zip(np.searchsorted(starts, [r[0] for r in runs], side="right") - 1, runs):
        by_doc[d].append((s - starts[d], size, q))
    return [_document(ws, rs) for ws, rs in zip(words, by_doc)]


_KINDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
          ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
          ("n_words", pa.int64()), ("n_dropped", pa.int64())]
_RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long")


def periodic_runs(docs: DataFrame,
                  words: Callable[[int | None, bytes], list[bytes]] = words_of) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_runs; start, length, period and
    exponent_milli of the run with the greatest length / period (ties: smallest
    start, then period); SHA-256 of the list of runs (``start,length,period`` and
    a line feed each) and of the text with every run collapsed to its first
    period; n_words; n_dropped.  ``words`` makes a text's words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, out, held, size = batch.column(0), batch.column(1), [], [], 0
            for doc, text in zip(ids.to_pylist(), texts):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                held.append(words(doc, body))
                size += len(body)
                if size >= PIECE_BYTES:
                    out += _piece(held)
                    held, size = [], 0
            out += _piece(held)
            cols = list(zip(*out)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), *(pa.array(c, k) for c, (_, k) in zip(cols, _KINDS))],
                names=["doc_id", *(name for name, _ in _KINDS)])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS BINARY) AS text").mapInArrow(rows, _RESULT)
