"""Secret scan by entropy over candidate strings, in SQL functions only.

Base kinds (fixed formats): ``assign`` (a key word, ``:`` or ``=``, a value of
6+ characters), ``access`` (``AKIA`` ids of 20+ characters) and ``hex`` (24+
lower-case hex digits); leftmost non-overlapping matches per kind, those that
are too short are dropped.  The method adds ``entropy`` spans: candidate
strings of 20+ characters in which a sliding window's Shannon entropy, taken
per character class, reaches the class's threshold, unless the allow-list
suppresses them or they lie inside a base span.

Matches are located by wrapping them in control characters and splitting
there (control characters of the text itself are first replaced by another
one, which no pattern matches), so offsets are code points.  A null text is
an empty one; each row is scanned by itself, repeated rows included.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed formats of the base kinds (Java syntax).
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

#: Entropy windows: characters, and bits per character a window must reach.
WINDOW = 20
CLASSES = (
    # name, characters, threshold in bits (a window of 20 has at most 4.32)
    ("hex", r"^[0-9a-fA-F-]+$", 3.0),
    ("alnum", r"^[0-9A-Za-z]+$", 3.6),
    ("base64", r"^[0-9A-Za-z+/_=-]+$", 3.8),
)
#: Candidates that match one of these are known placeholders, not secrets.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|dummy|redacted|your[_-]",
    r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$",
    r"(.)\1{5,}",
    r"(?i)0123456789|abcdefghij",
)

#: Long texts are worked on in stretches: matches or spans taken together, and
#: windows per stretch of a candidate (first level, second level).
AT_ONCE = 256
STRETCHES = (65_536, 256)

_OPEN, _CLOSE, _SPARE = "\u0001", "\u0002", "\u0003"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often (also
    inside lambdas) it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _split(text: Column, pattern: str, shown: str = "$0") -> Column:
    """Pieces of ``text``: the first before any match, each other one a match,
    the closing mark and what follows it (``shown`` may add to the match)."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}{shown}{_CLOSE}"))
    return F.split(marked, _OPEN)


def _matches(text: Column, pattern: str, value_group: bool = False) -> Column:
    """array<struct<s, e, v>> of all matches: code points [s, e) and the
    text v that length rules apply to (group 2 or the whole match)."""
    pieces = _split(text, pattern, f"$0{_CLOSE}$2" if value_group else "$0")
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")

    def width(part: Column) -> Column:
        return F.length(F.element_at(part, 1)) + F.when(F.size(part) > 1, F.length(F.element_at(part, -1))).otherwise(0)

    def step(acc: Column, piece: Column) -> Column:
        part = F.split(piece, _CLOSE)
        found = F.element_at(part, 1)
        value = F.element_at(part, 2) if value_group else found
        here = F.struct(acc["at"].alias("s"), (acc["at"] + F.length(found)).alias("e"), value.alias("v"))
        return F.struct((acc["at"] + width(part)).alias("at"),
                        F.when(F.size(part) == 1, acc["found"]).otherwise(
                            F.concat(acc["found"], F.array(here))).alias("found"))

    # an accumulator is copied at every step, so matches gather in lots: the
    # lots' widths give their places, each lot is then worked on by itself
    def located(p: Column) -> Column:
        lots = F.transform(F.sequence(F.lit(1), F.size(p), F.lit(AT_ONCE)), lambda i: F.slice(p, i, AT_ONCE))
        return _once(lots, placed)

    def placed(lots: Column) -> Column:
        widths = F.transform(lots, lambda lot: F.aggregate(
            lot, F.lit(0), lambda n, piece: n + width(F.split(piece, _CLOSE))))
        places = F.aggregate(widths, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
        return _once(places, lambda at: F.flatten(F.transform(lots, lambda lot, k: F.aggregate(
            lot, F.struct(F.get(at, k).alias("at"), none.alias("found")), step, lambda a: a["found"]))))

    return _once(pieces, lambda p: F.when(F.size(p) > 1, located(p)).otherwise(none))


def _spans(found: Column, kind: int, least: int) -> Column:
    """array<struct<s, k, e>> of the matches with a value of ``least`` chars."""
    return F.transform(F.filter(found, lambda m: F.length(m["v"]) >= least),
                       lambda m: F.struct(m["s"].alias("s"), F.lit(kind).alias("k"), m["e"].alias("e")))


def _stretches(s: Column, windows: int, window: int) -> Column:
    """Substrings that hold ``windows`` consecutive windows each (the last may
    hold fewer); every window of ``s`` is in one of them."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - window + 1), F.lit(windows))
    return F.transform(starts, lambda i: F.substr(s, i, F.lit(windows + window - 1)))


def _least_sum(s: Column, window: int) -> Column:
    """Least S of any window of a short string (see peak_entropy)."""
    def f(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))

    def count(w: Column, ch: Column) -> Column:
        return (F.length(w) - F.length(F.replace(w, ch, F.lit("")))).cast("double")

    def step(acc: Column, i: Column) -> Column:
        enters = F.substr(s, i, F.lit(1))
        leaves = F.when(i > window, F.substr(s, i - window, F.lit(1))).otherwise(F.lit(""))
        # the window before this step, without the character that leaves
        kept_from = F.greatest(F.lit(1), i - window + 1)
        kept = F.substr(s, kept_from, i - kept_from)
        c_out = count(kept, leaves) + 1
        c_in = count(kept, enters)
        total = acc["s"] + F.when(leaves == "", F.lit(0.0)).otherwise(f(c_out - 1) - f(c_out)) \
            + f(c_in + 1) - f(c_in)
        low = F.when(i >= window, F.least(acc["low"], total)).otherwise(acc["low"])
        return F.struct(total.alias("s"), low.alias("low"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(1e300).alias("low"))
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), start, step, lambda a: a["low"])


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy (bits) of any ``window`` consecutive characters.

    H = log2 W - S / W with S the sum of c log2 c over the window's character
    counts c.  S is kept up to date as the window slides: the character that
    leaves lowers its own count by one, the one that enters raises its own.
    Each stretch of windows starts afresh, so the time is linear in ``s``.
    """
    long, short = STRETCHES
    low = F.array_min(F.transform(_stretches(s, long, window), lambda p: F.array_min(
        F.transform(_stretches(p, short, window), lambda q: _least_sum(q, window)))))
    return F.lit(math.log2(window)) - low / window


def _suspicious(s: Column) -> Column:
    """True if a candidate string reaches its class's entropy threshold, mixes
    digits with letters, and no allow-list rule knows it."""
    known = F.lit(False)
    for rule in ALLOW:
        known = known | s.rlike(rule)
    limit = F.lit(None).cast("double")
    for _, chars, bits in reversed(CLASSES):
        limit = F.when(s.rlike(chars), F.lit(bits)).otherwise(limit)
    return F.when(s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~known, peak_entropy(s) >= limit).otherwise(False)


def _text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(
        ":", F.element_at(kinds, m["k"] + 1), m["s"].cast("string"), m["e"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base (array<struct<s, k, e>>, k the index in KINDS) and
    added (the same) columns."""
    t = F.translate(F.coalesce(F.col(text), F.lit("")), _OPEN + _CLOSE, _SPARE * 2)
    base = F.array_sort(F.concat(
        _spans(_matches(t, ASSIGN, True), 0, MIN_ASSIGN),
        _spans(_matches(t, ACCESS), 1, MIN_ACCESS),
        # runs of {24,} are the runs of + that are long enough; shorter ones need no mark
        _spans(_matches(t, HEX[:-1] + f"{{{MIN_HEX},}}+"), 2, MIN_HEX)))
    # base spans by AT_ONCE, each lot with the range it lies in
    lots = F.transform(
        F.when(F.size("base") > 0, F.sequence(F.lit(1), F.size("base"), F.lit(AT_ONCE))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.element_at("base", i)["s"].alias("s"),
                           F.array_max(F.transform(F.slice("base", i, AT_ONCE), lambda b: b["e"])).alias("e"),
                           F.slice("base", i, AT_ONCE).alias("spans")))

    def touches(x: Column, m: Column) -> Column:
        return (x["s"] < m["e"]) & (m["s"] < x["e"])

    def new(m: Column, known: Column) -> Column:
        inside = F.exists(known, lambda lot: touches(lot, m) & F.exists(lot["spans"], lambda b: touches(b, m)))
        return ~inside & _suspicious(m["v"])

    added = _once(lots, lambda known: F.filter(_matches(t, CANDIDATE), lambda m: new(m, known)))
    return (docs.withColumn("base", base)
            .withColumn("added", F.transform(added, lambda m: F.struct(
                m["s"].alias("s"), F.lit(3).alias("k"), m["e"].alias("e")))))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans
    in order of start then kind."""
    found = scan(docs.select("doc_id", "text")).select("doc_id", "base", "added")

    def n(k: int) -> Column:
        return F.size(F.filter("base", lambda m: m["k"] == k)).cast("long")

    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.size("added").cast("long").alias("n_entropy"),
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("base", "added"))).alias("spans"))
