"""Host-level quality rules.

Every document is measured by fixed text rules: the base rules, the strict
rules, and clear breaks of the strict ones.  Failures of the base and of the
strict rules are aggregated by host (``source``) and each host's two failure
rates are shrunk towards the corpus by a beta prior fitted to the hosts
themselves (method of moments).  A host fails if a shrunk rate lies more than
``DEVIATIONS`` of the prior's standard deviation above its mean: hosts that
stand out from the others at any base rate.  The verdicts are joined back: a
document must pass the base rules and break no strict rule clearly, and in a
failing host it must pass the strict rules too.

Measures: words are runs of bytes other than ASCII white space; lines are
split at ``\\n`` and count if they hold a word.  Null or empty text has no
words and fails.  Rows are judged one by one, so repeated rows each get the
same verdict; a null source is a host of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, text_batches

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A host fails if a shrunk failure rate is so many standard deviations of the
#: prior above its mean.
DEVIATIONS = 1.0
#: Strict rules for documents of failing hosts, in percent of words / lines.
STRICT_SYMBOL_PCT = 10
STRICT_DUP_LINE_PCT = 30
#: A text beyond these fails in any host.
CLEAR_SYMBOL_PCT = 100
CLEAR_DUP_LINE_PCT = 60

MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in
                         ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1].reshape(-1)
    triple = pair[:-1].astype(np.int64) * len(ids) + w[2:]
    _, inv, counts = np.unique(triple, return_inverse=True, return_counts=True)
    again = counts[inv.reshape(-1)] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def measure(body: bytes | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    if not body:
        return (0, 0, 0, 0, 0, 0)
    a = np.frombuffer(body, np.uint8)
    points = int(((a & 0xC0) != 0x80).sum())
    words = body.split()
    lines = [x for x in body.split(b"\n") if x.strip()]
    return (len(words), points - int(_WHITE[a].sum()), int(_SYMBOL[a].sum()),
            len(lines), len(lines) - len(set(lines)), _repeat_words(words))


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the struct ``m`` of MEASURES of a text column added.  Workers
    hold a slice of the texts at a time, whatever the session's batch size."""
    at = rows.columns.index(text)
    kinds = pa.struct([pa.field(n, pa.int64()) for n in MEASURES.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                found = [measure(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column(at)]
                cols = [pa.array(c, pa.int64()) for c in zip(*found)]
                m = pa.StructArray.from_arrays(cols, fields=list(kinds))
                yield pa.RecordBatch.from_arrays([*b.columns, m], names=[*b.schema.names, "m"])

    text_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("m", MEASURES)]))


def base_failed(m: str = "m") -> Column:
    return ((F.col(f"{m}.n_words") < MIN_WORDS)
            | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PCT * F.col(f"{m}.n_words")))


def strict_failed(m: str = "m", symbol_pct: int = STRICT_SYMBOL_PCT, dup_line_pct: int = STRICT_DUP_LINE_PCT) -> Column:
    return ((100 * F.col(f"{m}.n_symbols") > symbol_pct * F.col(f"{m}.n_words"))
            | (100 * F.col(f"{m}.n_dup_lines") > dup_line_pct * F.col(f"{m}.n_lines")))


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate, n_strict, strict_rate, shrunk,
    strict_shrunk, host_failed) per source of measured rows (source, m).

    The prior is beta(a, b) with the mean and variance of the hosts' rates:
    mean m, variance v, strength s = m(1-m)/v - 1 (at least 1, at most 1e6;
    1 where v is 0 or m is 0 or 1); shrunk = (failed + m s) / (n + s); the
    prior's standard deviation is sqrt(m(1-m)/(s+1)).  Base and strict failures
    have a prior each.
    """
    hosts = (rows.select(F.col("source").alias("host"), "m")
             .groupBy("host").agg(F.count("*").alias("n_docs"),
                                  F.sum(base_failed().cast("long")).alias("n_failed"),
                                  F.sum(strict_failed().cast("long")).alias("n_strict"))
             .withColumn("rate", F.col("n_failed") / F.col("n_docs"))
             .withColumn("strict_rate", F.col("n_strict") / F.col("n_docs")))
    return shrink(hosts)


def _prior(failed: str, rate: str) -> Column:
    """Struct (mean, strength) of the beta prior: a global aggregate."""
    mean, var = F.sum(failed) / F.sum("n_docs"), F.var_pop(rate)
    return F.struct(mean.alias("mean"), F.when((var > 0) & mean.between(1e-12, 1 - 1e-12), F.least(
        F.lit(1e6), F.greatest(F.lit(1.0), mean * (1 - mean) / var - 1))).otherwise(1.0).alias("strength"))


def _shrunk(failed: str, prior: str) -> Column:
    return ((F.col(failed) + F.col(f"{prior}.mean") * F.col(f"{prior}.strength"))
            / (F.col("n_docs") + F.col(f"{prior}.strength")))


def _stands_out(shrunk: str, prior: str) -> Column:
    mean, strength = F.col(f"{prior}.mean"), F.col(f"{prior}.strength")
    # a rate equal to the limit but for rounding doesn't stand out
    return F.col(shrunk) > mean + DEVIATIONS * F.sqrt(mean * (1 - mean) / (strength + 1)) + 1e-9


def shrink(hosts: DataFrame) -> DataFrame:
    """Adds the shrunk rates and the verdict to the hosts' counts and rates."""
    prior = hosts.agg(_prior("n_failed", "rate").alias("base"), _prior("n_strict", "strict_rate").alias("strict"))
    # one row: the broadcast side is a global aggregate
    return (hosts.join(F.broadcast(prior))
            .withColumn("shrunk", _shrunk("n_failed", "base"))
            .withColumn("strict_shrunk", _shrunk("n_strict", "strict"))
            .withColumn("host_failed", _stands_out("shrunk", "base") | _stands_out("strict_shrunk", "strict"))
            .drop("base", "strict"))


def judge(rows: DataFrame) -> DataFrame:
    """Measured rows (source, m, ...) with the columns base_failed and kept added.

    Host totals are partial aggregates per source; the join back is on the
    host, planned by size at run time (broadcast where the host table turns
    out small, else a sort-merge join whose hot hosts AQE splits).
    """
    names = set(rows.columns) & {"base_failed", "kept", "host", "host_failed"}
    if names:
        raise ValueError(f"columns {sorted(names)} clash with the verdict's; rename them first")
    verdicts = host_rates(rows).select("host", "host_failed")
    clear = strict_failed("m", CLEAR_SYMBOL_PCT, CLEAR_DUP_LINE_PCT)
    return (rows.withColumn("base_failed", base_failed())
            .join(verdicts, F.col("source").eqNullSafe(F.col("host")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~clear
                        & ~(F.coalesce(F.col("host_failed"), F.lit(False)) & strict_failed()))
            .drop("host", "host_failed"))


def quality_report(docs: DataFrame) -> DataFrame:
    """The judged measures per row, without the text.  Texts are measured once;
    the narrow table of measures is checkpointed for its two readers."""
    rows = cut(measured(docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))).drop("text"))
    return (judge(rows)
            .select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines",
                    "m.n_repeat_words", "base_failed", "kept"))


def quality_stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns.  Clashing column
    names are set aside during the judging.  Texts are measured twice (for the
    hosts, then for the verdicts): rows have no key to join measures back by."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    source, text = (f"c{names.index(c)}" for c in ("source", "text"))
    marked = judge(measured(safe, text).withColumn("source", F.col(source))).where("kept")
    return marked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
