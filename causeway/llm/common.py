"""Helpers shared by the corpus operators.

Conventions, unless an operator says otherwise: a document is one
``doc_id``; a null id is one document of its own (it sorts before all
others); where an id repeats, the row with the greatest text counts; a null
text is an empty one; input columns the operator doesn't name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import ensure_checkpoint_dir
from causeway.sources.tables import table_path

#: Stands for a null doc_id inside a plan (plain equi-joins and sorting then
#: treat it as a value); ``restore_id`` turns it back.
NULL_ID = -(2 ** 63)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table)).select(*columns)


def id_or_sentinel(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def restore_id(name: str = "doc_id") -> Column:
    return F.nullif(F.col(name), F.lit(NULL_ID)).alias(name)


def one_per_id(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, body): one row per document, body its UTF-8 bytes.

    One exchange by doc_id; plans that use the result twice read that
    exchange twice (Spark reuses it) instead of shuffling the text again.
    """
    return (docs.select(id_or_sentinel().alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
            .groupBy("doc_id").agg(F.max("t").alias("t"))
            .select("doc_id", F.col("t").cast("binary").alias("body")))


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch into stretches of rows with about ``most`` bytes in
    column ``text`` (a longer one alone), without a copy: what a Python worker
    holds at once then follows from the longest text, not from the session's
    batch size."""
    column = batch.column(text)
    width = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of about ``most`` bytes at most, for this session.

    Executors hold a few batches per task outside the heap, so this bounds what
    texts cost there.  Every operator that sends texts to Python sets it, and it
    stays set: plans are lazy, so it must hold when the caller runs them.  A lower
    limit of the session's own is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))     # Spark gives its default as "67108864b"
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder (survives lost executors).

    The shuffle files behind it are then garbage; Spark's cleaner deletes
    them when the driver collects its own, which is asked for here."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


#: Copies of a node's minimum in a join: a hub's edges are spread over so many tasks.
_SALTS = 8


def _with_minimum(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges (u, v) with the minimum m of u.  Edges are salted by their other end
    and minima repeated per salt, so those of a hub don't meet in one task."""
    salt = F.pmod(F.xxhash64("v"), F.lit(_SALTS)).cast("int")
    copies = low.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return edges.withColumn("s", salt).join(copies, ["u", "s"]).drop("s")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root),
    root the smallest node; a root itself has no row.

    Alternating large-star and small-star passes, each a grouped minimum and
    a join, cut by a checkpoint; the edge set is at most the input's size.
    Hubs are safe: minima are pre-aggregated and the joins are salted.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .where("u > v").distinct())
    before = None
    for _ in range(rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (_with_minimum(both, low).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (_with_minimum(large, low).where("v > m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
