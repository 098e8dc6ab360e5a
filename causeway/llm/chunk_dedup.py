"""Substring dedup by content-defined chunks.

A gear rolling hash over the bytes places chunk boundaries by content, so an
insertion only changes the chunks around it.  Chunks are told apart by a
128-bit digest; of equal chunks the first (smallest doc_id, then place)
stays, the others are repeats.  Runs of consecutive repeats of at least
``MIN_RUN`` bytes, or that make up a whole document, are removed.

The hash of a place depends on the last 16 bytes; a boundary may fall where 5
of its bits are 0, chunks are 24 to 256 bytes long (the last of a document
may be shorter).  Copies inside one slice (``SLICE`` bytes of text) are settled
there, so a chunk that occurs everywhere sends one row per slice.  A worker
holds one slice's chunks at a time.  Nulls, empty texts and repeated ids: see
common; an empty text has no chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh3_64_intdigest

from .common import cut, one_per_id, restore_id, slices, text_batches

MIN_CHUNK, MAX_CHUNK = 24, 256
WINDOW = 16
MASK_BITS = 5
MIN_RUN = 64
#: Bytes of text whose chunks a worker holds at once.
SLICE = 4 << 20

_GEAR = np.array([xxh3_64_intdigest(bytes([b]), seed=7) & 0xFFFFFFFF for b in range(256)], np.uint32)


def gear(body: bytes | memoryview | pa.Buffer) -> np.ndarray:
    """Gear hash at every byte: the sum of table values of the last 32 bytes,
    each shifted by its age; built by doubling the window."""
    h = _GEAR[np.frombuffer(body, np.uint8)]
    size = 1
    while size < 32:
        older = h[:-size] << np.uint32(size)
        h = h.copy()
        h[size:] += older
        size *= 2
    return h


def chunk_ends(body: bytes | memoryview | pa.Buffer) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(body)
    if not n:
        return []
    bits = np.uint32(((1 << MASK_BITS) - 1) << (WINDOW - MASK_BITS))
    cuts = (np.flatnonzero((gear(body) & bits) == 0) + 1).tolist()
    ends, last = [], 0
    for c in cuts:
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if c - last >= MIN_CHUNK:
            ends.append(c)
            last = c
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, doc_id, packed) per chunk; packed = (start * 512 + bytes) * 2
    + settled (an earlier copy is in the same slice)."""
    for whole in batches:
        for batch in slices(whole, 1, SLICE):
            digests, docs, starts, sizes = bytearray(), [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = text.as_buffer()
                ends = np.array(chunk_ends(body), np.int64)
                begins = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])
                view = memoryview(body)
                for a, b in zip(begins.tolist(), ends.tolist()):
                    digests += xxh3_128_digest(view[a:b])
                starts.append(begins)
                sizes.append(ends - begins)
                docs.append(np.full(len(ends), doc, np.int64))
            if not digests:
                continue
            d = np.frombuffer(digests, np.int64).reshape(-1, 2)
            doc, start, size = np.concatenate(docs), np.concatenate(starts), np.concatenate(sizes)
            o = np.lexsort((start, doc, d[:, 1], d[:, 0]))
            d, doc, start, size = d[o], doc[o], start[o], size[o]
            settled = np.zeros(len(o), bool)
            settled[1:] = (d[1:] == d[:-1]).all(axis=1)
            # settled rows only go to their document: any key does, spread evenly
            key = np.where(settled, d[:, 0] ^ (doc * 0x9E3779B1 + start) * 0x2545F491, d[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(d[:, 1]), pa.array(doc), pa.array((start * 512 + size) * 2 + settled)],
                names=["d1", "d2", "doc_id", "packed"])


def _runs(n: int, repeats: list[int] | None) -> list[tuple[int, int]]:
    """Byte ranges to remove from the repeated chunks (start * 512 + bytes)."""
    out: list[list[int]] = []
    for p in sorted(repeats or ()):
        s, e = p // 512, p // 512 + p % 512
        if out and out[-1][1] == s:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= MIN_RUN or e - s == n]


_RESULT = ("doc_id long, n_bytes long, n_chunks long, n_repeats long, n_removed long, removed string, "
           "kept_sha256 string")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1, SLICE):
            rows = []
            for text, repeats in zip(batch.column(1), batch.column(2).to_pylist()):
                body = memoryview(text.as_buffer())
                gone = _runs(len(body), repeats)
                kept, last = hashlib.sha256(), 0
                for s, e in gone:
                    kept.update(body[last:s])
                    last = e
                kept.update(body[last:])
                rows.append((len(body), len(chunk_ends(body)), len(repeats or ()), sum(e - s for s, e in gone),
                             ",".join(f"{s}:{e}" for s, e in gone), kept.hexdigest()))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "n_bytes", "n_chunks", "n_repeats", "n_removed", "removed", "kept_sha256"])


def chunk_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_chunks, n_repeats (repeated chunks),
    n_removed (bytes), removed (byte ranges start:end) and the SHA-256 of
    what stays.  The text is shuffled once (by doc_id) and read twice."""
    text_batches(docs.sparkSession, 8 << 20)
    texts = one_per_id(docs)
    chunks = texts.mapInArrow(_chunks, "d1 long, d2 long, doc_id long, packed long")
    settled = F.col("packed") % 2 == 1
    repeats = (chunks.repartition("d1").withColumn("settled", settled)
               .withColumn("place", F.row_number().over(
                   Window.partitionBy("d1", "d2", "settled").orderBy("doc_id", "packed")))
               .where("settled or place > 1")
               .groupBy("doc_id").agg(F.collect_list(F.shiftright("packed", 1)).alias("repeats")))
    out = texts.join(repeats, "doc_id", "left").select("doc_id", "body", "repeats").mapInArrow(_finish, _RESULT)
    out = cut(out)              # narrow rows
    return out.select(restore_id(), *[c for c in out.columns if c != "doc_id"])
