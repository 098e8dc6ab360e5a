"""The feature step as one estimator: ``fit_transform`` learns its state
(target-encoding map, counts, weights of evidence, group statistics, bin cut
points, ratio denominators, leaf model, PCA, anchors) and ``transform``
applies it to another batch.  With ``state='batch'`` counts, frequencies and
group statistics are recomputed on the batch being transformed; the default
``state='fit'`` uses the fitted ones.

Output names follow the feature contract: ``c__te``, ``c__count``,
``c__freq``, ``c__woe``, ``grp_{keys}__{num}__{f}``, ``c__log1p``,
``ratio__a__per__b``, ``inter__a__x__b``, ``inter__a__div__b``,
``c__qbin_k``, ``poly2_i``, ``leaf_idx_i``, ``pca_i``, ``dsban_pc_i``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from causeway.functions.scalar import category
from causeway.operators.features import derive, encode, groups, reduce


@dataclass
class FeatureFactory:
    cat_cols: Sequence[str]
    num_cols: Sequence[str]
    group_keys: Sequence[Sequence[str]] = ()
    target_encoding: bool = True
    count_freq: bool = True
    woe: bool = False
    group_stats: bool = True
    log1p: bool = True
    ratios: bool = True
    interactions: bool = True
    pairs: Sequence[tuple[str, str]] | None = None
    quantile_bins: int = 10
    poly2: bool = True
    leaf_embeddings: bool = False
    pca: int = 0
    max_total_cols: int | None = None
    n_splits: int = 5
    seed: int = 42
    state: str = "fit"
    fitted: dict = field(default_factory=dict)

    def _numeric(self, df: DataFrame, y: str | None) -> DataFrame:
        if "per" not in self.fitted:
            self.fitted["per"] = derive.counts_of(df, self.num_cols)
        out = derive.numeric_derivatives(df, self.num_cols, self.log1p, self.ratios, self.interactions,
                                         per=self.fitted["per"], pairs=self.pairs)
        if self.quantile_bins and self.quantile_bins > 1:
            if "cuts" not in self.fitted:
                out, cuts = derive.quantile_bins(out, self.num_cols, self.quantile_bins)
                self.fitted["cuts"] = cuts
            else:
                out = out.select("*", *derive.bin_columns(self.fitted["cuts"], self.quantile_bins))
        if self.poly2 and self.num_cols:
            out = out.select("*", *derive.poly2_columns(self.num_cols))
        return out

    def _fit_levels(self, df: DataFrame, y: str | None, fold: str) -> DataFrame:
        """Learns the level and group tables; returns ``df`` with the
        out-of-fold target encodings, which only training rows get."""
        out, fitted = df, self.fitted
        if y is not None and self.target_encoding and self.cat_cols:
            out, te_map = encode.target_encode_oof(out, self.cat_cols, y, self.n_splits, fold)
            fitted["te_map"], fitted["te_mean"] = te_map.persist(), encode.global_mean(df, y)
        if self.count_freq and self.cat_cols:
            counts, fitted["rows"] = encode.count_table(df, self.cat_cols)
            fitted["counts"] = counts.persist()
        if y is not None and self.woe and self.cat_cols and encode.is_binary_target(df, y):
            fitted["woe"] = encode.woe_table(df, self.cat_cols, y).persist()
        if self.group_stats and self.group_keys and self.num_cols:
            fitted["groups"] = [(k, t.persist()) for k, t in groups.group_tables(df, self.group_keys, self.num_cols)]
        return out

    def _apply_levels(self, out: DataFrame, batch: bool) -> DataFrame:
        """Counts, WoE and group statistics from the fitted tables; ``batch``
        takes counts and statistics from ``out`` instead."""
        fitted = self.fitted
        if "counts" in fitted:
            table = (None, None) if batch else (fitted["counts"], fitted["rows"])
            out = encode.count_frequency(out, self.cat_cols, *table)
        if "woe" in fitted:
            out = encode.woe_encode(out, self.cat_cols, table=fitted["woe"])
        if "groups" in fitted:
            tables = groups.group_tables(out, self.group_keys, self.num_cols) if batch else fitted["groups"]
            out = groups.group_apply(out, tables)
        return out

    def _categories(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: category(c) for c in self.cat_cols}) if self.cat_cols else df

    def fit_transform(self, df: DataFrame, y: str | None = None, fold: str = "fold") -> DataFrame:
        self.release()
        out = self._apply_levels(self._fit_levels(self._categories(df), y, fold), False)
        out = self._numeric(out, y)
        fitted = self.fitted
        if self.leaf_embeddings and y is not None:
            fitted["leaf"] = reduce.leaf_fit(out, list(self.num_cols), y)
            out = reduce.leaf_apply(out, fitted["leaf"])
        if self.pca:
            fitted["pca"] = reduce.pca_fit(out, self.feature_columns(out, df), self.pca)
            out = reduce.pca_apply(out, fitted["pca"])
        cols = self.feature_columns(out, df)
        if self.max_total_cols is not None and len(cols) > self.max_total_cols:
            fitted["anchors"] = reduce.anchors_of(out, cols, y)
            fitted["cap"] = reduce.pca_fit(out, fitted["anchors"], min(self.max_total_cols, len(fitted["anchors"])),
                                           prefix="dsban_pc_")
            fitted["replaced"] = cols
            out = reduce.pca_apply(out, fitted["cap"]).drop(*cols)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """The fitted steps on another batch: the same feature columns in the
        same order.  Levels unknown to the fit get the global mean, count 0
        and a NULL weight of evidence; unknown groups get NULLs."""
        if "per" not in self.fitted:
            raise ValueError("fit_transform first")
        fitted, out = self.fitted, self._categories(df)
        if "te_map" in fitted:
            out = encode.target_encode_apply(out, self.cat_cols, fitted["te_map"], fitted["te_mean"])
        out = self._numeric(self._apply_levels(out, self.state == "batch"), None)
        if "leaf" in fitted:
            out = reduce.leaf_apply(out, fitted["leaf"])
        if "pca" in fitted:
            out = reduce.pca_apply(out, fitted["pca"])
        if "cap" in fitted:
            out = reduce.pca_apply(out, fitted["cap"]).drop(*fitted["replaced"])
        return out

    def release(self) -> None:
        """Drops the fitted state and frees its cached tables."""
        for v in self.fitted.values():
            for t in [t for _, t in v] if isinstance(v, list) and v and isinstance(v[0], tuple) else [v]:
                if isinstance(t, DataFrame):
                    t.unpersist()
        self.fitted = {}

    @staticmethod
    def feature_columns(out: DataFrame, base: DataFrame) -> list[str]:
        numeric = {"double", "float", "int", "bigint"}
        return [c for c, t in out.dtypes if c not in base.columns and t in numeric]
