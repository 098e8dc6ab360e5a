"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are grouped by length.  The distinct ones are put in falling order of
length (a range partition), packed into slabs of at most ``SLAB`` rows, and
each slab is cut into buckets of similar length (at most ``BUCKET`` rows, the
shortest at least ``LENGTH_RATIO`` of the longest).  A query knows a threshold:
the score of its k-th best so far.  Against a bucket it becomes a threshold on
the cosine, threshold / (|query| * longest of the bucket), which decides what
is pruned there:

* above 1: the whole bucket, and with the bound of a slab, the whole slab;
* coordinate pruning, where the threshold is so high that few rows can meet
  it: a row whose cosine with the query is at least t has its coordinate f in
  q_f t +- sqrt((1 - q_f^2)(1 - t^2)) (unit vectors); the ranges of the query's
  ``FOCUS`` greatest coordinates are looked up in the bucket's sorted lists and
  the rows in all ranges are verified;
* length pruning otherwise: rows of at least threshold / |query|, a prefix of
  the bucket, are verified, many queries at once.

Verification is the exact integer product; every bound has a slack for
rounding, so nothing that belongs to the result is pruned.

Search goes in rounds, the longest slabs first, each four times the one
before.  After a round the k best of each query are merged and the thresholds
rise, so a round adds a few rows per query, not one per pair.  Queries travel
in blocks of at most ``QUERIES``; each block meets a slab in one row of a join.

Equal vectors are one candidate that carries its k + 1 smallest ids (no other
can be in a result), and one query.  So a vector that fills a third of the
table is one row.  The window that takes the smallest ids and the join that
gives results back to query rows drop, respectively salt, such hot vectors.

Defined cases: vectors that are null or hold a null or non-finite entry take
no part; shorter vectors count as filled up with zeros; a null id is no query,
as a result it stands behind all other ids; repeated ids are rows of their own
(a query's own row is left out once); scores beyond a long are held at its
ends; no queries or no candidates give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import unpack, whole_vectors

SLAB, BUCKET, QUERIES = 16384, 1024, 4096
LENGTH_RATIO = 0.9
FOCUS = 4
#: Coordinate pruning is used if the narrowest range holds at most this share of a bucket.
SELECTIVE = 0.2
SLACK = 1e-9
_LAST = 2 ** 63 - 1  # stands for a null id
_SALTS = 16
_LONG = 2 ** 63


# ------------------------------------------------------------ packing
def _dim(values: list[bytes]) -> int:
    return max(((len(v) - 1) // v[0] for v in values), default=0)


def _pack_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (v, norm, ids) to slabs (pid, longest, rows, dim, data, norms, counts, ids)."""
    pid = TaskContext.get().partitionId()
    for batch in batches:
        for i in range(0, batch.num_rows, SLAB):
            part = batch.slice(i, SLAB)
            values, norms, ids = (part.column(j).to_pylist() for j in range(3))
            dim = _dim(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid], pa.int64()), pa.array([max(norms)]), pa.array([len(values)], pa.int64()),
                 pa.array([dim], pa.int64()), pa.array([unpack(values, dim).tobytes()], pa.binary()),
                 pa.array([np.array(norms).tobytes()], pa.binary()),
                 pa.array([np.array([len(x) for x in ids], np.int64).tobytes()], pa.binary()),
                 pa.array([np.array([y for x in ids for y in x], np.int64).tobytes()], pa.binary())], names=_SLAB_NAMES)


_SLAB = "pid long, longest double, rows long, dim long, data binary, norms binary, counts binary, ids binary"
_SLAB_NAMES = [c.split()[0] for c in _SLAB.split(", ")]


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qk, v, norm) to blocks (block, q_rows, q_dim, q_data, q_norms, q_keys)."""
    pid, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for i in range(0, batch.num_rows, QUERIES):
            part = batch.slice(i, QUERIES)
            keys, values, norms = (part.column(j).to_pylist() for j in range(3))
            dim = _dim(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(pid << 24) + seq], pa.int64()), pa.array([len(values)], pa.int64()),
                 pa.array([dim], pa.int64()), pa.array([unpack(values, dim).tobytes()], pa.binary()),
                 pa.array([np.array(norms).tobytes()], pa.binary()),
                 pa.array([np.array(keys, np.int64).tobytes()], pa.binary())], names=_QUERY_NAMES)
            seq += 1


_QUERY = "block long, q_rows long, q_dim long, q_data binary, q_norms binary, q_keys binary"
_QUERY_NAMES = [c.split()[0] for c in _QUERY.split(", ")]


# ------------------------------------------------------------ search in a slab
def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of longs (held at the
    ends of a long)."""
    most = max(int(np.abs(a.astype(np.float64)).max(initial=0)), 1) * max(int(np.abs(b.astype(np.float64)).max(initial=0)), 1)
    if most * a.shape[1] < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most * a.shape[1] < 2 ** 62:
        return a @ b.T
    full = a.astype(object) @ b.astype(object).T
    return np.minimum(np.maximum(full, -_LONG), _LONG - 1).astype(np.int64)


def _best(q: np.ndarray, score: np.ndarray, row: np.ndarray, first_id: np.ndarray, k: int) -> tuple:
    """The k best (score, then smallest id) rows of each query."""
    o = np.lexsort((first_id[row], -score, q))
    q, score, row = q[o], score[o], row[o]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    keep = place < k
    return q[keep], score[keep], row[keep]


def search(queries: np.ndarray, q_norms: np.ndarray, floor: np.ndarray, known: np.ndarray, rows: np.ndarray,
           norms: np.ndarray, first_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, row) of the up to k best rows of each query that reach its
    threshold ``floor`` (``known``: it has one).  ``rows`` in falling order of norm."""
    dim = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (queries, rows))
    limit = np.where(known, floor.astype(np.float64), -np.inf)
    found = [np.zeros(0, np.int64)] * 3
    a = 0
    while a < len(rows):
        b = min(len(rows), a + BUCKET)
        b = a + int(np.searchsorted(-norms[a:b], -LENGTH_RATIO * norms[a], side="right"))
        b = max(b, a + 1)
        longest, part = norms[a], rows[a:b]
        # threshold of each query on the cosine in this bucket
        reach = q_norms * longest
        live = np.flatnonzero(limit <= reach * (1 + SLACK))
        cosine = np.where(reach[live] > 0, limit[live] / np.where(reach[live] > 0, reach[live], 1), -1.0)
        hits = [found]
        narrow = np.zeros(len(live), bool)
        tried = np.flatnonzero(cosine > 0.5)
        if len(tried) and dim:
            units = part / np.maximum(norms[a:b], 1e-300)[:, None]
            order = np.argsort(units, axis=0, kind="stable")
            lists = np.take_along_axis(units, order, axis=0)
            for j in tried.tolist():
                i = live[j]
                got = _by_coordinates(queries[i] / q_norms[i], min(1.0, cosine[j] - SLACK), units, order, lists)
                if got is None:
                    continue
                narrow[j] = True
                got = got[norms[a:b][got] * q_norms[i] * (1 + SLACK) >= limit[i]]
                if len(got):
                    hits.append(_reaching(queries[i:i + 1], part[got], floor[i:i + 1], known[i:i + 1],
                                          np.array([i]), got + a, k))
        wide = live[~narrow]
        for i in range(0, len(wide), 512):
            group = wide[i:i + 512]
            # length pruning: rows shorter than the lowest need of the group are behind its prefix
            need = np.min(np.where(q_norms[group] > 0, limit[group] / np.where(q_norms[group] > 0, q_norms[group], 1),
                                   -np.inf))
            e = int(np.searchsorted(-norms[a:b], -need * (1 - SLACK), side="right")) if need > 0 else b - a
            if e:
                hits.append(_best(*_reaching(queries[group], part[:e], floor[group], known[group], group,
                                             np.arange(a, a + e), k), first_id, k))
        found = list(_best(*(np.concatenate(x) for x in zip(*hits)), first_id, k))
        # the k-th best of a query in this slab raises its threshold
        q, n = np.unique(found[0], return_counts=True)
        ends = np.cumsum(n) - 1
        full = n >= k
        at, score = q[full], found[1][ends[full]]
        up = at[~known[at] | (score > floor[at])]
        floor[up] = score[np.isin(at, up)]
        known[up] = True
        limit[up] = floor[up].astype(np.float64)
        a = b
    return found[0], found[1], found[2]


def _by_coordinates(unit: np.ndarray, t: float, units: np.ndarray, order: np.ndarray,
                    lists: np.ndarray) -> np.ndarray | None:
    """Rows of a bucket that can have a cosine of t or more with ``unit``; None
    if the ranges are too wide to be worth it."""
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    half = np.sqrt(np.maximum(0.0, (1 - unit[focus] ** 2) * (1 - t * t))) + SLACK
    # beyond |q_f| = t the coordinate's own axis lies within the cone
    low = np.where(unit[focus] < -t, -1.0 - SLACK, unit[focus] * t - half)
    high = np.where(unit[focus] > t, 1.0 + SLACK, unit[focus] * t + half)
    a = np.array([np.searchsorted(lists[:, f], x, side="left") for f, x in zip(focus, low)])
    b = np.array([np.searchsorted(lists[:, f], x, side="right") for f, x in zip(focus, high)])
    best = int(np.argmin(b - a))
    if b[best] - a[best] > SELECTIVE * len(units):
        return None
    rows = np.sort(order[a[best]:b[best], focus[best]])
    inside = ((units[rows][:, focus] >= low) & (units[rows][:, focus] <= high)).all(axis=1)
    return rows[inside]


def _reaching(queries: np.ndarray, part: np.ndarray, floor: np.ndarray, known: np.ndarray, names: np.ndarray,
              places: np.ndarray, k: int) -> list[np.ndarray]:
    """(query, score, row) of the products that reach the thresholds and are
    among the k greatest scores (ties included) of their query here."""
    score = products(queries, part)
    ok = (score >= floor[:, None]) | ~known[:, None]
    if score.shape[1] > k:
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        ok &= score >= kth[:, None]
    q, r = np.nonzero(ok)
    return [names[q].astype(np.int64), score[q, r], places[r].astype(np.int64)]


def _search_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of (query block, slab, thresholds) to (block, qk, q_norm, score, vec_id)."""
    raised: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            keys = np.frombuffer(r["q_keys"], np.int64)
            q_norms = np.frombuffer(r["q_norms"], np.float64)
            queries = np.frombuffer(r["q_data"], np.int64).reshape(r["q_rows"], r["q_dim"])
            if r["block"] not in raised:
                floor, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
                if r["floor_keys"]:
                    at = np.argsort(keys, kind="stable")
                    place = at[np.searchsorted(keys[at], np.array(r["floor_keys"], np.int64))]
                    floor[place], known[place] = r["floors"], True
                raised = {r["block"]: (floor, known)}  # rows of a block mostly come together
            floor, known = raised[r["block"]]
            rows = np.frombuffer(r["data"], np.int64).reshape(r["rows"], r["dim"])
            counts, ids = np.frombuffer(r["counts"], np.int64), np.frombuffer(r["ids"], np.int64)
            starts = np.cumsum(counts) - counts
            q, score, row = search(queries, q_norms, floor, known, rows, np.frombuffer(r["norms"], np.float64),
                                   ids[starts], k)
            # rows to their ids, and again the k best
            each = np.repeat(np.arange(len(q)), counts[row])
            within = np.arange(len(each)) - np.repeat(np.cumsum(counts[row]) - counts[row], counts[row])
            q, score, place = _best(q[each], score[each], starts[row][each] + within, ids, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), r["block"], np.int64)), pa.array(keys[q]), pa.array(q_norms[q]),
                 pa.array(score), pa.array(ids[place])], names=["block", "qk", "q_norm", "score", "vec_id"])


_HIT = "block long, qk long, q_norm double, score long, vec_id long"


# ------------------------------------------------------------ the plan
def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qk").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """For every row of ``vectors`` (vec_id, embedding) that ``is_query`` (a
    condition on vec_id) holds for, its k best other rows: query_id, rank (from
    1), vec_id, score; ties go to the smaller vec_id.

    Exchanges: the distinct vectors twice (equal ones together, then by
    length), the queries once, and per round the query blocks that a slab can
    still matter to, against the round's slabs."""
    spark = vectors.sparkSession
    more = k + 1  # a query's own row is among its best
    rows = whole_vectors(vectors, scale)
    null_last = F.coalesce("vec_id", F.lit(_LAST))
    smallest = Window.partitionBy("v").orderBy("id")
    candidates = cut(rows.select("v", "norm", null_last.alias("id"))
                     .withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= more)
                     .groupBy("v").agg(F.max("norm").alias("norm"), F.array_sort(F.collect_list("id")).alias("ids")))
    asked = rows.where(is_query & F.col("vec_id").isNotNull())
    blocks = cut(asked.groupBy("v").agg(F.max("norm").alias("norm"))
                 .select(F.monotonically_increasing_id().alias("qk"), "v", "norm"))
    n, n_queries = candidates.count(), blocks.count()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    packed = cut(blocks.coalesce(max(1, -(-n_queries // QUERIES))).mapInArrow(_pack_queries, _QUERY))
    parts = max(spark.sparkContext.defaultParallelism, -(-n // SLAB))
    by_length = [F.col("norm").desc(), F.xxhash64("v")]
    slabs = cut(candidates.repartitionByRange(parts, *by_length).sortWithinPartitions(*by_length)
                .mapInArrow(_pack_slabs, _SLAB))
    last = slabs.agg(F.max("pid")).first()[0]
    state = spark.createDataFrame([], _HIT)
    a, width = 0, 1
    while a <= last:
        b = min(last, a + width - 1)
        state = cut(_top(state.unionByName(_round(packed, slabs, state, a, b, more)), more))
        a, width = b + 1, 4 * width
    return _answers(state, blocks, asked, k)


def _round(packed: DataFrame, slabs: DataFrame, state: DataFrame, a: int, b: int, k: int) -> DataFrame:
    """Hits of all query blocks in the slabs of parts a to b."""
    floors = (state.groupBy("block", "qk").agg(F.count("*").alias("n"), F.min("score").alias("floor"),
                                               F.max("q_norm").alias("q_norm")).where(F.col("n") >= k)
              .groupBy("block").agg(
                  F.collect_list(F.struct("qk", "floor")).alias("f"), F.count("*").alias("with_floor"),
                  # the length from which a row can matter to any query of the block
                  F.min(F.when(F.col("floor") <= 0, F.lit(0.0))
                        .otherwise(F.col("floor") / F.greatest("q_norm", F.lit(1e-300)))).alias("need")))
    ready = (packed.join(floors, "block", "left")
             .withColumn("need", F.when(F.col("with_floor") == F.col("q_rows"), F.col("need")).otherwise(F.lit(0.0)))
             .withColumn("floor_keys", F.coalesce(F.col("f.qk"), F.array().cast("array<long>")))
             .withColumn("floors", F.coalesce(F.col("f.floor"), F.array().cast("array<long>")))
             .drop("f", "with_floor"))
    pairs = (ready.select("block", "need", F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))).alias("pid"))
             .join(slabs.where(F.col("pid").between(a, b)).groupBy("pid").agg(F.max("longest").alias("longest")), "pid")
             .where(F.col("longest") * (1 + SLACK) >= F.col("need")).select("block", "pid"))
    return (pairs.join(ready.drop("need"), "block").join(slabs.where(F.col("pid").between(a, b)), "pid")
            .mapInArrow(lambda batches: _search_rows(batches, k), _HIT))


def _answers(state: DataFrame, blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The lists of the distinct queries, given to the query rows, without each row itself."""
    lists = (state.groupBy("qk").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), "vec_id", "score"))).alias("best"))
        .join(blocks.select("qk", "v"), "qk").select(
            "v", F.transform("best", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("best"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))))
    salted = asked.select("v", "square", F.col("vec_id").alias("query_id"),
                          F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).cast("int").alias("salt"))
    own = F.array_position("best", F.struct(F.col("square").alias("score"), F.col("query_id").alias("vec_id")))
    others = F.filter("best", lambda x, i: i + 1 != F.col("own"))
    return (salted.join(lists, ["v", "salt"]).withColumn("own", own)
            .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "hit"))
            .select("query_id", (F.col("place") + 1).alias("rank"),
                    F.nullif(F.col("hit.vec_id"), F.lit(_LAST)).alias("vec_id"), F.col("hit.score").alias("score")))
