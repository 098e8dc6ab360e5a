"""Exact substring dedup by the names of sampled suffixes.

A byte is removed if it is covered by a string of ``length`` (100) bytes that
also starts earlier (smaller doc_id, or the same document further left);
strings are judged on the input.  In place of a suffix sort, equal strings are
found by grouping sampled suffixes by hashes, from long runs to single strings:
no suffix is put in lexicographic order, and the ranks of a difference-cover
sort are hash names here (see README for what that sort would cost).

1. *Sample.*  A cover picks suffixes so that two equal strings always hold a
   sampled suffix at the same offset.  A periodic cover mod 31 does that with
   6 / 31 of all positions; a locally consistent one (the smallest k-gram of
   each string) does it with about 2 / 62, so that is the one used.  Every
   string belongs to exactly one sampled suffix, its consecutive strings
   form a run.
2. *Name.*  Sampled suffixes are grouped by their k-gram; the name of a run is
   the digest of all bytes its strings cover.  Equal names in a group are equal
   runs: all but the earliest are removed whole.  A run whose k-gram has one name only has no equal string elsewhere.
3. *Shorter blocks.*  Only the earliest run of each name whose k-gram has
   several names goes on.  It is cut into blocks of ``BLOCK`` strings, aligned
   to the sampled suffix; the bytes all strings of a block share take the
   k-gram's part and the block's own bytes give its name, as in step 2.
4. *Single strings.*  The strings of the blocks that are left are grouped by
   name; all but the earliest of a group are marked.
5. Marks go back to their documents.

Names are 64-bit hashes, told apart within one k-gram (64 more bits) or, in
step 4, with 24 bits more.  Copies inside one batch are settled there, so a
group of copies sends one row per batch; a k-gram with many names in a batch
is salted, so no k-gram gathers in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from .common import one_per_id, restore_id

LENGTH = 100
KGRAM = 40
BLOCK = 8
#: A k-gram with more names than this in a batch is spread over SALTS keys.
HOT_NAMES = 16
SALTS = 64

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
NORMAL, FORCED, SETTLED, BEACON = 0, 1, 2, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def kgram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes (mod 2^64, then mixed) of all k-grams, by doubling."""
    power, block, size = _BASE, a.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        if k & 1:
            if out is None:
                out, done = block, size
            else:
                n = len(a) - done - size + 1
                out = out[:n] * np.uint64(power) + block[done:done + n]
                done += size
        k >>= 1
        if not k:
            return _mix(out)
        block = block[:len(block) - size] * np.uint64(power) + block[size:]
        power = power * power % 2 ** 64
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (w - size)], x[w - size:]) if size < w else x


def runs(body: bytes, length: int = LENGTH, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """(k-gram hash, its place, first string, number of strings) of each run:
    the strings that share a sampled suffix."""
    if len(body) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h = kgram_hashes(np.frombuffer(body, np.uint8), k)
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(keyed, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]], at[first], first, np.diff(np.append(first, len(at)))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _rows(gram: np.ndarray, name: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    """(slot, name, doc_id, packed) of a batch of runs, packed = mark * 4 +
    kind; the rows are given, and stay, in the order of their documents."""
    o = np.lexsort((mark, doc, name, gram))
    g = gram[o]
    first = _first_of(g, name[o])
    group = np.cumsum(_first_of(g)) - 1
    hot = (np.bincount(group, weights=first)[group] > HOT_NAMES) & first
    nth = np.cumsum(hot) - np.maximum.accumulate(np.where(_first_of(g), np.cumsum(hot) - hot, 0))
    kind, beacon = np.empty(len(o), np.int64), np.empty(len(o), bool)
    kind[o] = np.where(hot, FORCED, np.where(first, NORMAL, SETTLED))
    beacon[o] = hot & (nth <= 2)
    slot = gram.copy()
    salted, settled = kind == FORCED, kind == SETTLED
    slot[salted] ^= _mix((name[salted] % np.uint64(SALTS)) + np.uint64(1))
    slot[settled] = _mix(gram[settled] ^ _mix(doc[settled].view(np.uint64) * np.uint64(31) + mark[settled].view(np.uint64)))
    packed = mark * 4 + kind
    # two names of a salted k-gram tell its unsalted slot that there are several
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((slot, gram[beacon])).view(np.int64)),
         pa.array(np.concatenate((name, name[beacon])).view(np.int64)),
         pa.array(np.concatenate((doc, doc[beacon]))),
         pa.array(np.concatenate((packed, mark[beacon] * 4 + BEACON)))],
        names=["slot", "name", "doc_id", "packed"])


def _sample(length: int, k: int):
    """Rows of all runs; mark = (start * 128 + offset of the sampled suffix)
    * 128 + strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, names, ids, marks = [], [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g, at, s, n = runs(body, length, k)
                grams.append(g)
                marks.append((s * 128 + (at - s)) * 128 + n)
                ids.append(np.full(len(g), doc, np.int64))
                names += [xxh3_64_intdigest(body[a:a + c + length - 1]) for a, c in zip(s.tolist(), n.tolist())]
            if names:
                yield _rows(np.concatenate(grams), np.array(names, np.uint64), np.concatenate(ids), np.concatenate(marks))
    return run


def _blocks(length: int):
    """Rows of the blocks of the runs that go on (odd marks); mark = start *
    128 + strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, names, ids, marks = [], [], [], []
            for doc, body, whole in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for m in whole or ():
                    if not m & 1:
                        continue
                    m >>= 1
                    start, at, end = m >> 14, (m >> 14) + (m >> 7 & 127), (m >> 14) + (m & 127)
                    while end > start:
                        # strings last - BLOCK + 1 .. last share the bytes from last on
                        last = at - (at - end + 1) // BLOCK * BLOCK
                        low = max(start, last - BLOCK + 1)
                        grams.append(xxh3_64_intdigest(body[last:last - BLOCK + 1 + length]))
                        names.append(xxh3_64_intdigest(body[low:end - 1 + length]))
                        marks.append(low * 128 + end - low)
                        ids.append(doc)
                        end = low
            if names:
                yield _rows(np.array(grams, np.uint64), np.array(names, np.uint64), np.array(ids, np.int64),
                            np.array(marks, np.int64))
    return run


def _strings(length: int):
    """(h, x, doc_id, packed) of each string of the blocks that go on; packed =
    (start * 128 + strings) * 2 + settled.  Repeats within the batch are
    settled here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ids, starts = [], [], []
            for doc, body, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for m in marks or ():
                    if m & 1:
                        s, n = (m >> 1) // 128, (m >> 1) % 128
                        hs += [xxh3_128_intdigest(body[i:i + length]) & (2 ** 88 - 1) for i in range(s, s + n)]
                        starts += range(s, s + n)
                        ids += [doc] * n
            if not hs:
                continue
            h = np.array([v & (2 ** 64 - 1) for v in hs], np.uint64)
            x = np.array([v >> 64 for v in hs], np.int32)
            doc, start = np.array(ids, np.int64), np.array(starts, np.int64)
            o = np.lexsort((start, doc, x, h))
            h, x, doc, start = h[o], x[o], doc[o], start[o]
            first = _first_of(h, x)
            # settled strings: consecutive ones of a document become one row
            sd, ss = doc[~first], start[~first]
            o = np.lexsort((ss, sd))
            sd, ss = sd[o], ss[o]
            lead = _first_of(sd, ss - np.arange(len(ss)))
            lead_at = np.flatnonzero(lead)
            n = np.diff(np.append(lead_at, len(ss)))
            pieces_d, pieces_s, pieces_n = [], [], []
            for d, s, c in zip(sd[lead_at].tolist(), ss[lead_at].tolist(), n.tolist()):
                for at in range(0, c, 127):
                    pieces_d.append(d)
                    pieces_s.append(s + at)
                    pieces_n.append(min(127, c - at))
            pd_, ps, pn = (np.array(v, np.int64) for v in (pieces_d, pieces_s, pieces_n))
            spread = _mix(pd_.astype(np.uint64) * np.uint64(31) + ps.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((h[first], spread)).view(np.int64)),
                 pa.array(np.concatenate((x[first], np.full(len(ps), -1, np.int32)))),
                 pa.array(np.concatenate((doc[first], pd_))),
                 pa.array(np.concatenate(((start[first] * 128 + 1) * 2, (ps * 128 + pn) * 2 + 1)))],
                names=["h", "x", "doc_id", "packed"])
    return run


def covered(n: int, marks: list[int], length: int) -> np.ndarray:
    """Bytes of a text of n covered by the strings marked (start * 128 + count)."""
    m = np.array(marks, np.int64)
    delta = np.zeros(n + 1, np.int32)
    start, count = m // 128, m % 128
    np.add.at(delta, start, 1)
    np.add.at(delta, start + count - 1 + length, -1)
    return np.cumsum(delta[:-1]) > 0


_RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, whole, blocks, single in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                marks = ([(m >> 15) * 128 + (m >> 1 & 127) for m in whole or () if not m & 1]
                         + [m >> 1 for m in blocks or () if not m & 1] + (single or []))
                if not marks:
                    out.append((len(body), 0, 0, hashlib.sha256(body).hexdigest()))
                    continue
                gone = covered(len(body), marks, length)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                out.append((len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(
                    cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def _named(rows: DataFrame) -> DataFrame:
    """(doc_id, m) per run that matters: mark * 2 if it is a repeat, + 1 if
    it is the earliest of its name and goes on."""
    kind = F.col("packed") % 4
    by_gram = Window.partitionBy("slot")
    open_name = F.when(kind != SETTLED, F.col("name"))
    named = (rows.repartition("slot")
             .withColumn("side", kind >= SETTLED)
             .withColumn("low", F.min(open_name).over(by_gram)).withColumn("high", F.max(open_name).over(by_gram))
             .withColumn("place", F.row_number().over(
                 Window.partitionBy("slot", "name", "side").orderBy("doc_id", "packed"))))
    repeat = (kind == SETTLED) | ((kind < SETTLED) & (F.col("place") > 1))
    goes_on = (kind == FORCED) | ((kind == NORMAL) & (F.col("low") != F.col("high")))
    return (named.where((kind != BEACON) & (repeat | goes_on))
            .select("doc_id", (F.shiftright("packed", 2) * 2 + F.when(repeat, 0).otherwise(1)).alias("m")))


def repeated_strings(docs: DataFrame, length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """(doc_id, body, whole, blocks, single): every document with its marks of
    steps 2 to 4 (odd values in whole and blocks went on to the next step).

    The text is shuffled once, by doc_id; all passes read that exchange.
    """
    if not BLOCK <= length - k + 1 <= 127:
        raise ValueError("length - k + 1 must be between BLOCK and 127")
    texts = one_per_id(docs)
    rows = "slot long, name long, doc_id long, packed long"

    def by_doc(marks: DataFrame, name: str) -> DataFrame:
        return marks.groupBy("doc_id").agg(F.collect_list("m").alias(name))

    whole = by_doc(_named(texts.mapInArrow(_sample(length, k), rows)), "whole")
    first = texts.join(whole, "doc_id", "left").select("doc_id", "body", "whole")
    blocks = by_doc(_named(first.mapInArrow(_blocks(length), rows)), "blocks")
    second = first.join(blocks, "doc_id", "left").select("doc_id", "body", "whole", "blocks")
    strings = (second.select("doc_id", "body", "blocks")
               .mapInArrow(_strings(length), "h long, x int, doc_id long, packed long"))
    settled = F.col("packed") % 2 == 1
    again = (strings.repartition("h")
             .withColumn("place", F.row_number().over(Window.partitionBy("h", "x").orderBy("doc_id", "packed")))
             .where(settled | (F.col("place") > 1))
             .select("doc_id", F.shiftright("packed", 1).alias("m")))
    return (second.join(by_doc(again, "single"), "doc_id", "left")
            .select("doc_id", "body", "whole", "blocks", "single"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the
    SHA-256 of the bytes that stay.  Texts shorter than ``length`` stay
    whole; see the module and common for nulls and repeated ids."""
    out = repeated_strings(docs, length, k).mapInArrow(_finish(length), _RESULT)
    return out.select(restore_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
