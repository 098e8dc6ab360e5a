"""Symbolic feature search: a beam of expressions over the numeric columns.

A generation takes the best expressions so far and joins each with every
column by +, -, * and / and with itself by a few functions.  All candidates of
a generation are scored by one aggregate: rows are exploded by candidate inside
the scan stage and only mergeable moments per candidate are shuffled.  The
score is the absolute correlation with the target, less ``PER_NODE`` for every
node, so a longer expression must earn its length.

Equal expressions are one: an expression is kept in a canonical form (operands
of + and * in order, x * x a square, x - x and x / x nothing), and the form is
the name of the feature.  A value that isn't defined (a division by 0, the
logarithm of nothing) is NULL and counts for neither moment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalar import safe_div
from causeway.operators.features.derive import num

PER_NODE = 1e-3
#: An expression is only worth a score if this share of the rows has a value.
MIN_SHARE = 0.5

Expr = tuple  # ("col", name) | (function, x) | (operator, a, b)
FUNCTIONS = ("square", "sqrt", "log", "abs")
OPERATORS = ("+", "-", "*", "/")


def text(e: Expr) -> str:
    """The canonical form as text."""
    if e[0] == "col":
        return e[1]
    if len(e) == 2:
        return f"{e[0]}({text(e[1])})"
    return f"({text(e[1])} {e[0]} {text(e[2])})"


def size(e: Expr) -> int:
    return 1 if e[0] == "col" else 1 + sum(size(x) for x in e[1:])


def canonical(op: str, *args: Expr) -> Expr | None:
    """The expression in canonical form; None if it is a constant or no news."""
    if len(args) == 1:
        inner = args[0][0]
        if op == "abs" and inner in ("abs", "square", "sqrt") or op == "square" and inner in ("sqrt", "abs"):
            return None
        return (op, args[0])
    a, b = args
    if op in "+*" and text(b) < text(a):
        a, b = b, a
    if a == b:
        return {"*": ("square", a)}.get(op)     # x + x is x again, x - x and x / x are constants
    return (op, a, b)


def column(e: Expr) -> Column:
    """The value of an expression: double, NULL where it isn't defined."""
    if e[0] == "col":
        return num(e[1])
    x = column(e[1])
    if len(e) == 2:
        return {"square": lambda: x * x, "abs": lambda: F.abs(x), "sqrt": lambda: F.when(x >= 0, F.sqrt(x)),
                "log": lambda: F.when(x > 0, F.log(x))}[e[0]]()
    y = column(e[2])
    return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: safe_div(x, y)}[e[0]]()


def grown(beam: Sequence[Expr], columns: Sequence[Expr]) -> list[Expr]:
    """The next generation, without repeats, in the order of its text."""
    out = {}
    for a in beam:
        made = [canonical(f, a) for f in FUNCTIONS]
        for b in columns:
            made += [canonical(op, a, b) for op in OPERATORS] + [canonical(op, b, a) for op in "-/"]
        out.update({text(e): e for e in made if e is not None})
    return [out[k] for k in sorted(out)]


def scored(df: DataFrame, expressions: Sequence[Expr], y: str) -> DataFrame:
    """``expression, size, n, corr, score`` of every expression, by one aggregate."""
    target = F.col(y).cast("double")
    values = F.posexplode(F.array(*[column(e) for e in expressions])).alias("_c", "_x")
    x, t = F.col("_x"), F.col("_y")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)
    rows = df.where(target.isNotNull()).select(target.alias("_y"), values)
    per = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(finite, 1)).alias("n"),
                                 F.covar_pop(F.when(finite, x), F.when(finite, t)).alias("_xy"),
                                 F.var_pop(F.when(finite, x)).alias("_xx"), F.var_pop(F.when(finite, t)).alias("_yy"))
    spread = F.sqrt("_xx") * F.sqrt("_yy")
    corr = F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_xy") / spread)))
    names, sizes = (F.array(*[F.lit(f(e)) for e in expressions]) for f in (text, size))
    out = per.select(F.get(names, F.col("_c")).alias("expression"), F.get(sizes, F.col("_c")).alias("size"), "n",
                     F.when(F.col("n") >= MIN_SHARE * F.col("_all"), corr).alias("corr"))
    return out.withColumn("score", F.abs("corr") - PER_NODE * F.col("size"))


def symbolic_search(df: DataFrame, nums: Sequence[str], y: str, generations: int = 2, beam: int = 8,
                    best: int = 10) -> tuple[list[Expr], DataFrame]:
    """The ``best`` expressions over all generations and the table of all that
    were scored (``generation`` added).  ``generations`` + 1 aggregates; what
    reaches the driver is a row per candidate."""
    columns = [("col", c) for c in nums]
    known = {text(e): e for e in columns}
    table = []
    front: list[Expr] = columns
    for g in range(generations + 1):
        rows = scored(df, front, y).withColumn("generation", F.lit(g)).collect()
        table += rows
        found = sorted((r for r in table if r["score"] is not None), key=lambda r: (-r["score"], r["expression"]))
        if g < generations:
            top = [known[r["expression"]] for r in found[:beam]]
            front = [e for e in grown(top, columns) if text(e) not in known]
            known.update({text(e): e for e in front})
            if not front:
                break
    schema = "expression string, size int, n long, corr double, score double, generation int"
    return [known[r["expression"]] for r in found[:best]], df.sparkSession.createDataFrame([tuple(r) for r in table], schema)


def symbolic_features(df: DataFrame, expressions: Sequence[Expr], prefix: str = "sym_") -> DataFrame:
    """Adds the expressions' values as columns ``sym_0``, …"""
    return df.select("*", *[column(e).alias(f"{prefix}{i}") for i, e in enumerate(expressions)])
