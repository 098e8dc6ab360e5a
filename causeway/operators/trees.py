"""Regression trees and forests for many models in one growth.

Cross-fitting needs the same learner many times: every fold, both arms, the
propensity, and in a forest every tree.  Here they grow together, level by
level.  A level is one pass over the rows and one aggregate: each task adds
its rows to histograms keyed by (model, tree, node, feature, bin) — weight and
weighted target — which are merged by a grouped sum; each tree's merged
histogram picks the best split of all its nodes in one task (its size is nodes
× features × bins, whatever the rows).  A growth of depth d takes d passes and
d aggregates, not one fit per model.  The passes read a narrow copy of the rows
(features, targets, fold and hash), written once and spread over the cores.

Features are cut into at most ``bins`` bins by approximate quantiles taken in
one job (or by given cut points); a NULL feature falls into a bin of its own
below all others.  A split sends bins up to its bin to the left; the best has
the largest reduction of the sum of squares, ties go to the first feature and
lowest bin.  Sampling of rows is a hash of the id, so it is repeatable under
retry: with ``bags`` each bag draws half of the rows, and its trees draw from
that half (what :func:`bag_spread` needs); without, each tree draws ``rate``.

The trees themselves are lists of at most models × trees × 2^(depth + 1) nodes
on the driver; rows never get there.  Scoring is one pass that reads all trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.hashing import md5_int
from causeway.operators.joins import caches, settle

#: Rows of a task that adds up histograms: at least, and at most on large tables.
TASK_ROWS = (10_000, 1_000_000)


@dataclass(frozen=True)
class Family:
    """One target, learned once per fold: ``where`` says which rows train."""

    name: str
    target: Column
    where: Column | None = None


@dataclass(frozen=True)
class Forest:
    families: tuple[str, ...]
    folds: tuple[int, ...]          # (-1,) without cross-fitting
    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    depth: int
    trees: int
    per_bag: int                    # trees of a bag; 0 without bags
    feature: np.ndarray             # models x trees x nodes; -1 at a leaf
    bin: np.ndarray
    value: np.ndarray               # mean target of the node
    weight: np.ndarray

    def rules(self, family: str = "", fold: int = -1, tree: int = 0) -> list[dict]:
        """Leaves of one tree as rules: conditions, mean and weight."""
        m = self._model(self.families.index(family) if family else 0, self.folds.index(fold))
        out: list[dict] = []

        def walk(node: int, conds: list[dict]) -> None:
            f = int(self.feature[m, tree, node])
            if f < 0:
                out.append({"leaf": len(out), "value": float(self.value[m, tree, node]),
                            "weight": float(self.weight[m, tree, node]), "conditions": conds})
                return
            # bin b holds cuts[b - 2] < x <= cuts[b - 1], bin 0 the missing values
            at = int(self.bin[m, tree, node])
            cut = self.cuts[f][at - 1] if at else float("-inf")
            walk(2 * node + 1, conds + [{"feature": self.features[f], "op": "<=", "threshold": cut}])
            walk(2 * node + 2, conds + [{"feature": self.features[f], "op": ">", "threshold": cut}])

        walk(0, [])
        return out

    def _model(self, family: int, fold: int) -> int:
        return family * len(self.folds) + fold


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row hashes (one multiply-xorshift round per salt)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2 ** 64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


def _drawn(hashes: np.ndarray, tree: int, trees: int, per_bag: int, rate: float) -> np.ndarray:
    """Which rows a tree trains on."""
    if trees == 1:
        return np.ones(len(hashes), bool)
    mine = _mix(hashes, 1_000_003 + tree) < rate
    return mine & (_mix(hashes, tree // per_bag) < 0.5) if per_bag else mine


def _routes(feature: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and bin every node asks for; a leaf sends all rows to the left."""
    leaf = feature < 0
    return np.where(leaf, 0, feature).astype(np.intp), np.where(leaf, np.iinfo(np.int64).max, split).astype(np.int64)


def _descend(routes: tuple[np.ndarray, np.ndarray], bins: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row ``levels`` below the root."""
    feature, split = routes
    flat, start = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    node = np.zeros(len(bins), np.intp)
    for _ in range(levels):
        right = flat.take(start + feature.take(node)) > split.take(node)
        node *= 2
        node += 1
        node += right
    return node


def _reached(feature: np.ndarray, level: int) -> np.ndarray:
    """Which nodes of a level rows can be in: all nodes above them split."""
    alive = np.ones(1, bool)
    for lv in range(level):
        alive = np.repeat(alive & (feature[2 ** lv - 1:2 ** (lv + 1) - 1] >= 0), 2)
    return alive


def _handed_down(forest: Forest) -> np.ndarray:
    """Node values, those of a leaf handed down to all nodes below it."""
    value = forest.value.copy()
    for lv in range(forest.depth):
        here = np.arange(2 ** lv - 1, 2 ** (lv + 1) - 1)
        leaf = forest.feature[..., here] < 0
        for child in (2 * here + 1, 2 * here + 2):
            value[..., child] = np.where(leaf, value[..., here], value[..., child])
    return value


def feature_cuts(df: DataFrame, features: Sequence[str], bins: int = 32) -> tuple[tuple[float, ...], ...]:
    """Cut points of every feature from one approximate-quantile job."""
    probs = [i / bins for i in range(1, bins)]
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    got = numbers.approxQuantile(list(features), probs, 1.0 / (4 * bins))
    return tuple(tuple(sorted(set(g))) for g in got)


def _matrix(column: pa.ListArray, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _numbers(features: Sequence[str]) -> Column:
    """The features as one array of numbers, NaN where missing."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def _bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of the features: 0 if missing, else 1 + the number of cut points below."""
    out = np.empty(x.shape, np.int64)
    for i, at in enumerate(cuts):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(at, x[:, i], "left"))
    return out


def _prepared(df: DataFrame, features: Sequence[str], families: Sequence[Family], fold: str | None,
              id_col: str, seed: int) -> DataFrame:
    """(_h, _f, _x features, _y targets, _w which families the row trains)."""
    y = [f.target.cast("double") for f in families]
    ok = [y[i].isNotNull() & (F.lit(True) if f.where is None else F.coalesce(f.where, F.lit(False)))
          for i, f in enumerate(families)]
    return df.select(
        md5_int(id_col, "trees", seed).alias("_h"),
        (F.lit(-1) if fold is None else F.col(fold).cast("int")).alias("_f"),
        _numbers(features).alias("_x"),
        F.array(*[F.when(k, v).otherwise(F.lit(0.0)) for k, v in zip(ok, y)]).alias("_y"),
        F.array(*[k.cast("double") for k in ok]).alias("_w"))


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """The rows in as many parts as there are cores, none under ``TASK_ROWS[0]`` and,
    on large tables, none over ``TASK_ROWS[1]``: a task's histograms have the
    size of the trees, whatever its rows."""
    least, most = TASK_ROWS
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // most))
    return rows.repartition(max(1, min(parts, -(-n // least))), "_h")


def _histograms(forest: Forest, level: int, p: int, n_bins: int, rate: float):
    """Arrow function: rows to (tree, cell, weight, target sum) of one level.
    The tree number counts models × trees, the cell (node of the level,
    feature, bin)."""
    first = 2 ** level - 1
    nodes = 2 ** level
    n_folds, n_families = len(forest.folds), len(forest.families)
    cells = nodes * p * n_bins
    cuts = [np.sort(np.array(at, float)) for at in forest.cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        routes = [[_routes(forest.feature[m, t], forest.bin[m, t]) for t in range(forest.trees)] for m in range(n_families * n_folds)]
        alive = [[_reached(forest.feature[m, t], level) for t in range(forest.trees)] for m in range(n_families * n_folds)]
        offsets = np.arange(p) * n_bins
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            x = _bins(_matrix(batch.column(2), p, np.float64), cuts)
            y = _matrix(batch.column(3), n_families, np.float64)
            w = _matrix(batch.column(4), n_families, np.float64)
            trains = [w[:, a] > 0 for a in range(n_families)]
            for t in range(forest.trees):
                drawn = _drawn(hashes, t, forest.trees, forest.per_bag, rate)
                for a in range(n_families):
                    mine = np.flatnonzero(drawn & trains[a])
                    own_x, own_y, own_fold = x[mine], y[mine, a], fold[mine]
                    for b, own in enumerate(forest.folds):
                        m = a * n_folds + b
                        if not alive[m][t].any():
                            continue
                        others = np.flatnonzero(own_fold != own) if own != -1 else np.arange(len(mine))
                        if not len(others):
                            continue
                        there, target = own_x.take(others, axis=0), own_y.take(others)
                        node = _descend(routes[m][t], there, level) - first
                        if not alive[m][t].all():
                            live = np.flatnonzero(alive[m][t].take(node))
                            there, target, node = there.take(live, axis=0), target.take(live), node.take(live)
                        there += offsets
                        there += (node * (p * n_bins))[:, None]
                        cell = there.ravel()
                        key = m * forest.trees + t
                        if key not in sums:
                            sums[key] = np.zeros((2, cells))
                        sums[key][0] += np.bincount(cell, minlength=cells)
                        sums[key][1] += np.bincount(cell, np.repeat(target, p), cells)
        for key, s in sums.items():
            at = np.flatnonzero(s[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), key, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[0][at]),
                 pa.array(s[1][at])], names=["tree", "cell", "w", "s"])

    return run


def _splitter(level: int, p: int, n_bins: int, min_leaf: float, mtry: int, seed: int):
    """Arrow function: one tree's merged histogram to the best split of each node."""
    nodes = 2 ** level

    def run(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        h = np.zeros((2, nodes * p * n_bins))
        at = table.column("cell").to_numpy()
        h[0, at], h[1, at] = table.column("w").to_numpy(), table.column("s").to_numpy()
        h = h.reshape(2, nodes, p, n_bins)
        total = h[:, :, 0, :].sum(axis=2)
        left = np.cumsum(h, axis=3)
        n, s = total[0][:, None, None], total[1][:, None, None]
        lw, ls = left
        rw, rs = n - lw, s - ls
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = ls * ls / lw + rs * rs / rw - s * s / n
        gain = np.where((lw >= min_leaf) & (rw >= min_leaf), gain, -np.inf)
        if mtry < p:
            for k in range(nodes):
                u = _mix(np.arange(p, dtype=np.uint64) + np.uint64((tree * nodes + k) * p), seed + 77)
                gain[k, np.argsort(u)[mtry:]] = -np.inf
        flat = gain.reshape(nodes, -1)
        best = flat.argmax(axis=1)
        good = np.flatnonzero((total[0] > 0))
        top = flat[good, best[good]]
        split = top > 1e-12 * np.maximum(1.0, np.abs(total[1][good]))
        f, b = best[good] // n_bins, best[good] % n_bins
        pick = (good, f, b)
        return pa.table({
            "tree": pa.array(np.full(len(good), tree, np.int32)), "node": pa.array(good.astype(np.int32)),
            "feature": pa.array(np.where(split, f, -1).astype(np.int32)), "bin": pa.array(b.astype(np.int32)),
            "w": pa.array(total[0][good]), "s": pa.array(total[1][good]),
            "lw": pa.array(lw[pick]), "ls": pa.array(ls[pick])})

    return run


def grow(df: DataFrame, features: Sequence[str], families: Sequence[Family], folds: Sequence[int] | None = None,
         fold: str = "fold", depth: int = 4, bins: int = 32, min_leaf: float = 10, trees: int = 1, bags: int = 0,
         rate: float = 0.632, mtry: int | None = None, seed: int = 42, id_col: str = "id",
         cuts: Sequence[Sequence[float]] | None = None) -> Forest:
    """Grows one forest (``trees`` of depth ``depth``) for every family and fold;
    the model of a fold trains on the rows of the other folds."""
    if bags and trees % bags:
        raise ValueError("the trees must divide evenly into the bags")
    features, families = list(features), list(families)
    cuts = feature_cuts(df, features, bins) if cuts is None else tuple(tuple(float(c) for c in at) for at in cuts)
    n_bins = max(len(at) for at in cuts) + 2
    places = tuple(sorted(folds)) if folds is not None else (-1,)
    shape = (len(families) * len(places), trees, 2 ** (depth + 1) - 1)
    forest = Forest(tuple(f.name for f in families), places, tuple(features), cuts, depth, trees,
                    trees // bags if bags else 0, np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape),
                    np.zeros(shape))
    with caches(df.sparkSession):
        n = df.count()
        rows = settle(_spread(_prepared(df, features, families, fold if folds is not None else None, id_col, seed), n))
        _grow_levels(forest, rows, n_bins, min_leaf, rate, mtry or len(features), seed)
    return forest


def _grow_levels(forest: Forest, rows: DataFrame, n_bins: int, min_leaf: float, rate: float, mtry: int, seed: int) -> None:
    """Fills in the nodes of ``forest`` level by level."""
    p, trees = len(forest.features), forest.trees
    for level in range(forest.depth):
        merged = (rows.mapInArrow(_histograms(forest, level, p, n_bins, rate), "tree int, cell int, w double, s double")
                  .groupBy("tree", "cell").agg(F.sum("w").alias("w"), F.sum("s").alias("s")))
        picked = merged.groupBy("tree").applyInArrow(
            _splitter(level, p, n_bins, min_leaf, mtry, seed),
            "tree int, node int, feature int, bin int, w double, s double, lw double, ls double").collect()
        grown = False
        for r in picked:  # at most models x trees x 2^level rows
            m, t = divmod(r["tree"], trees)
            node = 2 ** level - 1 + r["node"]
            forest.value[m, t, node], forest.weight[m, t, node] = r["s"] / r["w"], r["w"]
            if r["feature"] < 0:
                continue
            grown = True
            forest.feature[m, t, node], forest.bin[m, t, node] = r["feature"], r["bin"]
            for child, w, s in ((2 * node + 1, r["lw"], r["ls"]), (2 * node + 2, r["w"] - r["lw"], r["s"] - r["ls"])):
                forest.value[m, t, child], forest.weight[m, t, child] = s / w, w
        if not grown:
            break


def predict(df: DataFrame, forest: Forest, fold: str = "fold", spread: bool = False,
            depths: Sequence[int] | None = None) -> DataFrame:
    """Adds each family's prediction (by the model of the row's own fold) under
    its name; with ``spread`` also ``<name>_sd``, the standard deviation by the
    little bags; with ``depths`` ``<name>_<d>``, the trees cut at those depths,
    instead.  A model that no row trained predicts NULL."""
    p = len(forest.features)
    place = F.lit(-1) if forest.folds == (-1,) else F.col(fold).cast("int")
    numbered = df.withColumn("_f", place).withColumn("_x", _numbers(forest.features))
    value, cuts = _handed_down(forest), [np.sort(np.array(at, float)) for at in forest.cuts]
    levels = list(depths) if depths else [None]
    out_names = [f if d is None else f"{f}_{d}" for f in forest.families for d in levels]
    added = [T.StructField(n, T.DoubleType()) for n in out_names] + \
        ([T.StructField(f"{n}_sd", T.DoubleType()) for n in out_names] if spread else [])
    kept = [c for c in df.columns if c not in {f.name for f in added}]
    schema = T.StructType([df.schema[c] for c in kept] + added)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = _bins(_matrix(batch.column(len(kept) + 1), p, np.float64), cuts)
            own = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            means, sds = [], []
            for a, depth in [(a, d) for a in range(len(forest.families)) for d in levels]:
                mean, sd = np.full(n, np.nan), np.full(n, np.nan)
                for b, f in enumerate(forest.folds):
                    rows = np.flatnonzero(own == f)
                    m = forest._model(a, b)
                    if not len(rows) or not forest.weight[m, :, 0].any():
                        continue
                    mine, down = x[rows], forest.depth if depth is None else min(depth, forest.depth)
                    each = np.array([value[m, t].take(_descend(_routes(forest.feature[m, t], forest.bin[m, t]), mine, down))
                                     for t in range(forest.trees) if forest.weight[m, t, 0]])
                    mean[rows] = each.mean(axis=0)
                    if spread:
                        sd[rows] = bag_spread(each, forest.per_bag)
                means.append(pa.array(mean, from_pandas=True))
                sds.append(pa.array(sd, from_pandas=True))
            cols = [batch.column(i) for i in range(len(kept))] + means + (sds if spread else [])
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return numbered.select(*kept, "_f", "_x").mapInArrow(score, schema)


def bag_spread(each: np.ndarray, per_bag: int) -> np.ndarray:
    """Standard deviation of a forest's mean from its little bags (trees x rows):
    the variance between the means of the bags, each grown on half of the rows,
    less the part that the few trees of a bag add."""
    if per_bag < 2 or len(each) < 2 * per_bag:
        return np.full(each.shape[1], np.nan)
    bags = each[:len(each) // per_bag * per_bag].reshape(-1, per_bag, each.shape[1])
    between = bags.mean(axis=1).var(axis=0, ddof=1)
    within = bags.var(axis=1, ddof=1).mean(axis=0) / per_bag
    return np.sqrt(np.maximum(between - within, 0.0))
