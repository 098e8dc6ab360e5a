"""Near-duplicates by MinHash and an LSH forest.

A document's set is its distinct five-word shingles (ASCII lower-cased words
split at ASCII white space; with fewer words the whole sequence is one);
documents with 100 * intersection >= pct * union are linked, groups are the
connected components.  ``pct`` is 85 unless the caller gives another; trees,
depth and agreement follow from it (``Plan``).

1. *Signatures.*  120 MinHash values of 16 bits per document.  Documents with
   equal sets become one representative (a grouped minimum).
2. *Forest.*  24 trees (30 at 80), each an order of the signature that starts
   at another value, cut at a common prefix of 5 (4) values: documents below the
   same cut are candidates (a pair at the limit is missed by all trees with
   probability 8e-7 or 1e-7).  The cut is the same in every region: a forest that
   goes deeper where a region is dense finds fewer of the pairs at the limit
   there, and no link is to be lost.  (In effect this is banding; see README.)
3. *Regions.*  Within a prefix, candidates whose signatures agree in 86 (78)
   or more of 120 values (four spreads below the limit) are joined; a prefix
   shared by more than ``DENSE`` representatives is joined as a whole.  The
   components of that graph are the regions: no link leaves its region.
4. *Adaptive blocks.*  A region is cut into as many blocks as its members and
   shingles need, one for almost all; every pair of blocks is one bounded
   task.  So dense regions cost more tasks instead of being capped.
5. *Verification.*  A task takes the full shingle sets: documents with more
   than 100 - pct % of shingles nobody else there has can't be linked and go; the
   intersections of the others come from one incidence product.  It returns
   a spanning forest of the links, never the pairs.
6. Components of those links, joined back to all copies.

Documents without words are linked with nothing.  In the table of groups
(``near_duplicates``) a document is an id: where it repeats, the row with the
most shingles counts; a null id is a document of its own.  In the stage a
document is an id with a text: rows equal in both are copies of one, equal or
null ids alone join nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import components, cut, id_or_sentinel, restore_id, slices, text_batches

SHINGLE = 5
LINK_PCT = 85
HASHES = 120
#: A pair at the limit is missed by all trees with at most this probability.
MISS = 1e-6
DENSE = 1000
BLOCK_DOCS, BLOCK_SHINGLES = 2000, 4_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_501)
_A = _rng.integers(0, 2 ** 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2 ** 32, HASHES, dtype=np.uint32)


class Plan(NamedTuple):
    """What finds the pairs of a similarity of ``pct`` percent."""

    pct: int
    trees: int
    depth: int
    agree: int


def plan(pct: int) -> Plan:
    """The deepest forest over HASHES values that misses at most MISS of the
    pairs at ``pct``, and an agreement four spreads below it."""
    p = pct / 100
    depth = max((d for d in range(1, HASHES + 1) if HASHES % d == 0 and (1 - p ** d) ** (HASHES // d) <= MISS), default=0)
    if not depth:
        raise ValueError(f"{HASHES} values can't find pairs at {pct} %")
    return Plan(pct, HASHES // depth, depth, int(HASHES * p - 4 * (HASHES * p * (1 - p)) ** 0.5))


def shingle_set(body: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    ws = body.lower().split()
    n = len(ws)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxh3_64_intdigest(w) for w in ws), np.uint64, n)
    size = min(n, SHINGLE)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + h[i:n - size + 1 + i]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(s: np.ndarray) -> bytes:
    """HASHES MinHash values, 16 bits each."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 2 ** 32 - 1, np.uint32)
    for i in range(0, len(x), 4096):
        low = np.minimum(low, (x[i:i + 4096, None] * _A + _B).min(axis=0))
    return ((low >> np.uint32(16)) ^ low).astype(">u2").tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, whole.num_columns - 1):
            n, keys, sigs = [], [], []
            for body in b.column(b.num_columns - 1):
                s = shingle_set(body.as_py())
                n.append(len(s))
                keys.append(xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s) if len(s) else b"")
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(k[:, 0])),
                 pa.array(np.ascontiguousarray(k[:, 1])), pa.array(sigs, pa.binary())],
                names=[*b.schema.names[:-1], "n", "k1", "k2", "sig"])


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns after it) per run of equal leading columns."""
    key, cols = None, None
    for b in batches:
        values = [c.to_pylist() for c in b.columns]
        for row in zip(*values):
            if row[:n_keys] != key:
                if key is not None:
                    yield key, cols
                key, cols = row[:n_keys], [[] for _ in row[n_keys:]]
            for c, v in zip(cols, row[n_keys:]):
                c.append(v)
    if key is not None:
        yield key, cols


def _forest(links: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id of its component) of a boolean link matrix."""
    order = np.argsort(ids, kind="stable")
    links, ids = links[np.ix_(order, order)], ids[order]
    n = len(ids)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(links, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(a), int(b)) for a, b in zip(ids, ids[label]) if a != b]


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()),
                                       pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _agreeing(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the pairs of a prefix with similar signatures."""
    pairs: list[tuple[int, int]] = []
    for _, (ids, sigs) in _grouped(batches, 1):
        s = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), HASHES)
        links = np.zeros((len(s), len(s)), bool)
        step = max(1, 2_000_000 // (len(s) * HASHES))
        for i in range(0, len(s), step):
            links[i:i + step] = (s[i:i + step, None, :] == s[None, :, :]).sum(axis=2) >= agree
        pairs += _forest(links, np.array(ids))
        if len(pairs) > 50_000:
            yield _edges(pairs)
            pairs = []
    yield _edges(pairs)


def linked(sets: list[np.ndarray], pct: int = LINK_PCT) -> np.ndarray:
    """Boolean matrix of the links between full shingle sets."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = code.reshape(-1)
    alive = np.ones(n, bool)
    while True:
        on = alive[owner]
        df = np.bincount(code[on], minlength=code.max(initial=0) + 1)
        shared = np.bincount(owner[on & (df[code] > 1)], minlength=n)
        still = alive & (100 * shared >= pct * size)
        if (still == alive).all():
            break
        alive = still
    out = np.zeros((n, n), bool)
    who = np.flatnonzero(alive)
    if len(who) < 2:
        return out
    keep = alive[owner] & (df[code] > 1)
    row = (np.cumsum(alive) - 1)[owner[keep]]
    _, col = np.unique(code[keep], return_inverse=True)
    col = col.reshape(-1)
    both = np.zeros((len(who), len(who)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(256, 8_000_000 // len(who))
    for first in range(0, int(col[-1]) + 1, width):
        a, b = np.searchsorted(col, (first, first + width))
        m = np.zeros((len(who), min(width, int(col[-1]) + 1 - first)), np.float32)
        m[row[a:b], col[a:b] - first] = 1
        both += m @ m.T
    both = np.rint(both).astype(np.int64)
    union = size[who][:, None] + size[who][None, :] - both
    out[np.ix_(who, who)] = 100 * both >= pct * union
    return out


def _verify(batches: Iterator[pa.RecordBatch], pct: int) -> Iterator[pa.RecordBatch]:
    for _, (ids, sets) in _grouped(batches, 3):
        once = [i for i, x in enumerate(ids) if not i or x != ids[i - 1]]    # sorted; copies may come from several tasks
        ids, sets = [ids[i] for i in once], [sets[i] for i in once]
        if len(ids) > 1:
            pairs = _forest(linked([np.frombuffer(s, np.uint64) for s in sets], pct), np.array(ids))
            if pairs:
                yield _edges(pairs)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each representative, if the row is the one that counts;
    once per task."""
    done: set[int] = set()
    for whole in batches:
        for b in slices(whole, 1):
            cols = [b.column(i).to_pylist() for i in range(6)]
            rows = []
            for rep, body, region, blocks, k1, k2 in zip(*cols):
                if rep in done:
                    continue
                s = shingle_set(body)
                if tuple(np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64).tolist()) == (k1, k2):
                    done.add(rep)
                    rows.append((region, blocks, rep, s.tobytes()))
            out = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["region", "blocks", "rep", "shingles"])


def bodies(docs: DataFrame) -> DataFrame:
    """(doc_id, body) per row."""
    return docs.select(id_or_sentinel().alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))


def sketches(rows: DataFrame) -> DataFrame:
    """(keys, n, k1, k2, sig) of rows (keys, body): one row per key; k1, k2
    the set's digest."""
    keys = rows.columns[:-1]
    s = rows.mapInArrow(_sketch, ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
                                           + ["n long, k1 long, k2 long, sig binary"]))
    return s.groupBy(*keys).agg(F.max(F.struct("n", "k1", "k2", "sig")).alias("s")).select(*keys, "s.*")


def regions(reps: DataFrame, how: Plan) -> DataFrame:
    """(node, root) of the candidate graph over (rep, sig)."""
    tree = reps.select("rep", F.explode(F.array(*[
        F.xxhash64(F.lit(t), F.substring("sig", 1 + 2 * how.depth * t, 2 * how.depth)) for t in range(how.trees)])).alias("prefix"))
    dense = tree.groupBy("prefix").agg(F.count("*").alias("members"), F.min("rep").alias("first")).where("members > 1")
    near = tree.join(dense, "prefix")
    whole = near.where(F.col("members") > DENSE).select(F.col("rep").alias("a"), F.col("first").alias("b"))
    similar = (near.where(F.col("members") <= DENSE).select("prefix", "rep").join(reps.select("rep", "sig"), "rep")
               .select("prefix", "rep", "sig").repartition("prefix").sortWithinPartitions("prefix")
               .mapInArrow(partial(_agreeing, agree=how.agree), "a long, b long"))
    return components(whole.unionByName(similar))


def links(rows: DataFrame, reps: DataFrame, how: Plan) -> DataFrame:
    """(a, b): a spanning forest of the links between the representatives
    (rep, keys, k1, k2, sig, n) of rows (keys, body)."""
    keys = rows.columns[:-1]
    found = regions(reps, how)
    inside = (found.select(F.col("node").alias("rep"), F.col("root").alias("region"))
              .unionByName(found.select(F.col("root").alias("rep"), F.col("root").alias("region")).distinct()))
    member = reps.select("rep", *keys, "k1", "k2", "n").join(inside, "rep")
    blocks = (member.groupBy("region").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS),
                                                      F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks")))
    member = member.join(blocks, "region")
    sets = (rows.join(member, keys).select("rep", "body", "region", "blocks", "k1", "k2")
            .mapInArrow(_sets, "region long, blocks long, rep long, shingles binary"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    paired = (sets.withColumn("mine", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("region", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
                      "rep", "shingles"))
    return (paired.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y", "rep")
            .mapInArrow(partial(_verify, pct=how.pct), "a long, b long"))


def representatives(s: DataFrame) -> DataFrame:
    """The smallest key of each set: (k1, k2, keys, sig, n)."""
    keys = s.columns[:-4]
    return (s.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct(*keys, "sig", "n")).alias("r"))
            .select("k1", "k2", "r.*"))


def near_duplicates(docs: DataFrame, pct: int = LINK_PCT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group), kept."""
    text_batches(docs.sparkSession)
    rows = bodies(docs)
    s = cut(sketches(rows))
    reps = representatives(s).withColumn("rep", F.col("doc_id"))
    root = components(links(rows, reps, plan(pct)))
    of_set = (reps.select("k1", "k2", "rep").join(root, F.col("rep") == F.col("node"), "left")
              .select("k1", "k2", F.coalesce("root", "rep").alias("component")))
    out = (s.select("doc_id", "n", "k1", "k2").join(of_set, ["k1", "k2"], "left")
           .withColumn("component_id", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
           .withColumn("kept", F.col("doc_id") == F.col("component_id")))
    return out.select(restore_id(), F.col("n").alias("n_shingles"), restore_id("component_id"), "kept")


def near_dedup_stage(docs: DataFrame, pct: int = LINK_PCT) -> DataFrame:
    """One row of ``docs`` per group, with its columns: the document with the
    smallest id, a null one first (of those that share it, the smallest text
    digest's; of equal rows any).  Null or repeated ids with different texts
    are different documents.

    Representatives are numbered, as an id doesn't tell them apart; the
    checkpoint keeps the numbers fixed.
    """
    text_batches(docs.sparkSession)
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = bodies(docs.select("doc_id", "text")).select("doc_id", F.unhex(F.md5("body")).alias("digest"), "body")
    s = cut(sketches(rows))
    # nullable as ids are: Spark 4.1 fails on the constraints of components' unions over a checkpoint otherwise
    reps = cut(representatives(s).withColumn("rep", F.monotonically_increasing_id())
               .withColumn("rep", F.when(F.col("rep") >= 0, F.col("rep"))))
    root = components(links(rows, reps, plan(pct)))
    first = (reps.select("rep", "doc_id", "digest").join(root, F.col("rep") == F.col("node"), "left")
             .groupBy(F.coalesce("root", "rep").alias("component"))
             .agg(F.min(F.struct("doc_id", "digest")).alias("r")))
    kept = (first.select("r.*").unionByName(s.where("n = 0").select("doc_id", "digest"))
            .select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")))
    packed = docs.select(id_or_sentinel().alias("__id"), digest.alias("__digest"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return (packed.join(kept, ["__id", "__digest"], "left_semi")
            .groupBy("__id", "__digest").agg(F.first("row").alias("row")).select("row.*"))
