"""Conflict-constrained best-fit packing.

Documents are packed into sequences of ``capacity`` words.  Bins of a shard
are kept in order of residual space, each with two bitmaps: the sources and
the duplicate clusters it holds.  Pieces come in order of falling length; a
piece goes to the bin with the smallest residual that fits *and* holds
neither its source nor its duplicate cluster: the successor search walks up
the residuals until it finds one, else a bin is opened.  So no sequence
repeats a source or a duplicate.

A document longer than a sequence is cut into full sequences of its own (a
bin each) and a rest, which is packed like any other piece.  Shards are
hash-dealt slices of about ``SHARD`` pieces; the row's place in the input is
part of the hash, so neither a hot source nor a large cluster nor equal rows
land in one task.  Only (doc_id, length, source, cluster) is shuffled.  Null text counts no words; documents without words get piece 0
of length 0 with a null bin.  Null sources are one source.  Rows are packed
one by one; repeated rows share a cluster (the digest of the text) and so
never share a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD = 4096

SCHEMA = ("doc_id long, piece long, n_words long, shard long, bin long, place long")


def n_words(text: Column) -> Column:
    """Runs of bytes other than ASCII white space: each becomes one mark, and
    the marks are counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin number of every piece; pieces come in the given order."""
    bins: list[list] = []                       # [residual, sources, clusters]
    by_residual: dict[int, list[int]] = {}
    residuals: list[int] = []                   # in order
    out = []

    def file(b: int) -> None:
        r = bins[b][0]
        if r not in by_residual:
            by_residual[r] = []
            insort(residuals, r)
        insort(by_residual[r], b)

    def take(r: int, b: int) -> None:
        by_residual[r].remove(b)
        if not by_residual[r]:
            del by_residual[r]
            residuals.pop(bisect_left(residuals, r))

    for n, s, c in zip(lengths, sources, clusters):
        source, cluster = 1 << s, 1 << c
        best = None
        for i in range(bisect_left(residuals, n), len(residuals)):
            best = next((b for b in by_residual[residuals[i]]
                         if not (bins[b][1] & source or bins[b][2] & cluster)), None)
            if best is not None:
                break
        if best is None:
            best = len(bins)
            bins.append([capacity, 0, 0])
        else:
            take(bins[best][0], best)
        bins[best][0] -= n
        bins[best][1] |= source
        bins[best][2] |= cluster
        if bins[best][0]:
            file(best)
        out.append(best)
    return out


def _pack_shard(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        p = pieces.sort_values(["n_words", "doc_id", "piece", "cluster", "source"],
                               ascending=[False, True, True, True, True], na_position="first", kind="stable")
        full = p["n_words"] == capacity
        bins = pd.Series(0, index=p.index, dtype="int64")
        bins[full] = range(int(full.sum()))
        rest = p[~full]
        packed = best_fit(rest["n_words"].tolist(), pd.factorize(rest["source"], use_na_sentinel=False)[0].tolist(),
                          pd.factorize(rest["cluster"])[0].tolist(), capacity)
        bins[~full] = [int(full.sum()) + b for b in packed]
        place = p["n_words"].groupby(bins).cumsum() - p["n_words"]
        return pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "piece": p["piece"], "n_words": p["n_words"],
                             "shard": p["shard"], "bin": bins, "place": place})
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece (number within the document), n_words,
    shard, bin (within the shard), place (first word's place in the bin)."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        n_words(F.col("text")).alias("words"),
                        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("cluster"),
                        F.monotonically_increasing_id().alias("row"))
    pieces = (sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
                  F.lit(0).cast("long"), F.ceil(F.col("words") / capacity) - 1))))
              .withColumn("n_words", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("long")))
    shards = max(1, -(-docs.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece", "row"), F.lit(shards)))
    packed = (dealt.where("n_words > 0").select("doc_id", "piece", "n_words", "shard", "source", "cluster")
              .groupBy("shard").applyInPandas(_pack_shard(capacity), SCHEMA))
    empty = dealt.where("n_words = 0").select(
        "doc_id", "piece", "n_words", "shard", F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("place"))
    return packed.unionByName(empty)
