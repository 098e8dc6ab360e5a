"""Deterministic keys derived from md5 of the row id.

Folds, permutations and bootstrap weights must be reproducible under task
retry and identical in any SQL engine, so they are pure functions of
``md5(id || ':' || salt)``; ``rand()`` / ``uuid()`` are never used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_60 = float(2 ** 60)


def md5_key(id_col: Column | str, *salt: Column | str | int) -> Column:
    """md5 hex of ``id:salt1:salt2...`` (ids rendered as decimal text)."""
    parts = [F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")]
    for s in salt:
        parts.append(F.lit(":"))
        parts.append(s.cast("string") if isinstance(s, Column) else F.lit(str(s)))
    return F.md5(F.concat(*parts))


def md5_int(id_col: Column | str, *salt: Column | str | int) -> Column:
    """First 60 bits of the md5 key as a non-negative BIGINT."""
    return F.conv(F.substring(md5_key(id_col, *salt), 1, 15), 16, 10).cast("bigint")


def md5_uniform(id_col: Column | str, *salt: Column | str | int) -> Column:
    """Uniform value in [0, 1) from the md5 key."""
    return md5_int(id_col, *salt) / F.lit(TWO_POW_60)


def fold_of(id_col: Column | str, k: int, seed: int) -> Column:
    """Shuffled K-fold membership: md5 integer modulo k."""
    return F.pmod(md5_int(id_col, seed), F.lit(k)).cast("int")
