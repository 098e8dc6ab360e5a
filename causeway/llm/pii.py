"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, ``://``, ``tel:``,
identifier cues such as ``IBAN`` or ``account``); small deterministic parsers
expand each anchor to the left and right and validate the result.  Digit
runs and plus signs anchor the numeric kinds.

Base kinds (fixed formats): email, ip, card, phone.  Added kinds: userinfo
(credentials in a URL), tel (numbers of ``tel:`` links) and account (the
identifier after a cue; an IBAN must pass mod 97).  Spans are code points
``[start, end)``; within a kind they don't overlap.  All parsers are linear
in the text.  Null text is empty; rows are scanned one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches


KINDS = ("email", "ip", "card", "phone", "userinfo", "tel", "account")
N_BASE = 4
CUES = ("iban", "account", "acct", "passport", "ssn")

# A dotted quad can only start where a digit run starts: a later digit of the
# same run would meet the same continuation.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]+")
_TEL = re.compile(r"\+?[0-9](?:[ ().-]?[0-9])++")
_ACCOUNT = re.compile(r"(?:[ ]?(?:no|number|nr|id))?[ .:#=-]{0,3}([A-Z0-9](?:[ -]?[A-Z0-9]){4,33})(?![A-Za-z0-9])")

_AUTOMATON = None


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for anchor in ("@", "://", "tel:"):
            a.add_word(anchor, (anchor, anchor))
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (cue, form))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(s: str) -> bool:
    return (15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit()
            and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _email_at(t: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``, not before ``floor``."""
    start = at
    while start > floor and t[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(t, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def find(t: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of every span, ordered by kind, then start."""
    out: list[tuple[int, int, int]] = []
    end = dict.fromkeys(range(len(KINDS)), 0)

    def add(kind: int, s: int, e: int) -> None:
        out.append((kind, s, e))
        end[kind] = e

    for last, (anchor, form) in _automaton().iter(t):
        first = last - len(form) + 1
        if anchor == "@":
            if first >= end[0] and (hit := _email_at(t, first, end[0])):
                add(0, *hit)
        elif anchor == "://":
            authority = _AUTHORITY.match(t, last + 1)
            if authority and first > 0 and t[first - 1].isalpha():
                at = t.rfind("@", authority.start(), authority.end())
                if at > authority.start() and authority.start() >= end[4]:
                    add(4, authority.start(), at)
        elif anchor == "tel:":
            m = _TEL.match(t, last + 1)
            if m and 7 <= len(_digits(m[0])) <= 15 and m.start() >= end[5]:
                add(5, m.start(), m.end())
        elif first == 0 or not t[first - 1].isalnum():
            m = _ACCOUNT.match(t, last + 1)
            if m and m.start(1) >= end[6]:
                plain = re.sub("[ -]", "", m[1])
                if _iban(plain) if anchor == "iban" else len(_digits(plain)) >= 5:
                    add(6, m.start(1), m.end(1))
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            add(1, *m.span())
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            add(2, *m.span())
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= len(_digits(m[0])) <= 15:
                add(3, *m.span())
    return sorted(out)


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redact(t: str) -> str:
    """The text with every span replaced by its kind in brackets; spans that
    overlap become one, named after the first."""
    pieces, at, until, label = [], 0, -1, ""
    for s, k, e in sorted((s, k, e) for k, s, e in find(t)):
        if s < until:
            until = max(until, e)
            continue
        if until >= 0:
            pieces.append(label)
            at = until
        pieces.append(t[at:s])
        until, label = e, f"[{KINDS[k].upper()}]"
    if until < 0:
        return t
    return "".join(pieces) + label + t[until:]


_REPORT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in _REPORT.names]
        for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = find(t)
            counts = [0] * len(KINDS)
            for k, _, _ in spans:
                counts[k] += 1
            base = join_spans([x for x in spans if x[0] < N_BASE])
            row = [doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), join_spans(spans)]
            for c, v in zip(cols, row):
                c.append(v)
        kinds = [pa.int64()] * (1 + len(KINDS)) + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_REPORT.names)


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, a count per kind, the digest of the base spans and all spans;
    one map pass without a shuffle."""
    return (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(_report, _REPORT))


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else redact(t))


def pii_stage(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked (and ``n_chars``, if
    there is one, brought up to date); rows and other columns stay."""
    text_batches(docs.sparkSession)
    out = docs.withColumn("text", _redacted(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
