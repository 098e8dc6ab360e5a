"""The feature step as a Spark ML estimator whose fitted model can be saved.

``FeatureEstimator(factory).fit(df)`` gives a :class:`FeatureModel`, a Spark ML
transformer (it goes into a ``Pipeline``).  A saved model is a folder: the
factory's settings and small numbers as one line of JSON, its level and group
tables as Parquet, its fitted Spark ML stages as their own folders.  It is read
back in any session with ``FeatureModel.load``.
"""

from __future__ import annotations

import json
from dataclasses import asdict, fields, replace

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from causeway.operators.features.factory import FeatureFactory

_TABLES = ("te_map", "counts", "woe")
_NUMBERS = ("te_mean", "rows", "per", "cuts", "anchors", "replaced")
#: Fitted parts that hold Spark ML models, and their keys.
_STAGES = {"leaf": ("model",), "pca": ("scaler", "pca"), "cap": ("scaler", "pca")}


class FeatureEstimator(Estimator):
    """Learns a :class:`FeatureFactory`'s state; ``y`` and ``fold`` as there."""

    def __init__(self, factory: FeatureFactory, y: str | None = None, fold: str = "fold"):
        super().__init__()
        self.factory, self.y, self.fold = factory, y, fold

    def _fit(self, df: DataFrame) -> FeatureModel:
        fitted = replace(self.factory, fitted={})
        fitted.fit_transform(df, self.y, self.fold)
        return FeatureModel(fitted)

    def fit_transform(self, df: DataFrame) -> tuple[FeatureModel, DataFrame]:
        """The model, and the training rows with their out-of-fold encodings."""
        fitted = replace(self.factory, fitted={})
        out = fitted.fit_transform(df, self.y, self.fold)
        return FeatureModel(fitted), out


class FeatureModel(Model, MLWritable, MLReadable):
    """A fitted feature step."""

    def __init__(self, factory: FeatureFactory | None = None):
        super().__init__()
        self.factory = factory

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.factory.transform(df)

    def write(self) -> MLWriter:
        return _FeatureWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FeatureReader()


class _FeatureWriter(MLWriter):
    def __init__(self, model: FeatureModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        ff, spark = self.model.factory, SparkSession.getActiveSession()
        fitted = ff.fitted
        settings = {k: v for k, v in asdict(replace(ff, fitted={})).items() if k != "fitted"}
        state: dict = {"settings": settings, "numbers": {k: fitted[k] for k in _NUMBERS if k in fitted},
                       "tables": [k for k in _TABLES if k in fitted],
                       "groups": [keys for keys, _ in fitted.get("groups", [])], "stages": {}}
        for name in state["tables"]:
            fitted[name].write.parquet(f"{path}/tables/{name}")
        for i, (_, table) in enumerate(fitted.get("groups", [])):
            table.write.parquet(f"{path}/tables/group_{i}")
        for part, keys in _STAGES.items():
            if part in fitted:
                plain = {k: v for k, v in fitted[part].items() if k not in keys}
                held = [k for k in keys if fitted[part][k] is not None]
                for k in held:
                    fitted[part][k].write().save(f"{path}/stages/{part}_{k}")
                state["stages"][part] = {"plain": plain, "held": held, "none": [k for k in keys if k not in held]}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{path}/state")


class _FeatureReader(MLReader):
    def load(self, path: str) -> FeatureModel:
        spark = SparkSession.getActiveSession()
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        names = {f.name for f in fields(FeatureFactory)}
        ff = FeatureFactory(**{k: v for k, v in state["settings"].items() if k in names})
        fitted = dict(state["numbers"])
        for name in state["tables"]:
            fitted[name] = spark.read.parquet(f"{path}/tables/{name}")
        if state["groups"]:
            fitted["groups"] = [(list(keys), spark.read.parquet(f"{path}/tables/group_{i}"))
                                for i, keys in enumerate(state["groups"])]
        for part, held in state["stages"].items():
            fitted[part] = {**held["plain"], **dict.fromkeys(held["none"]), **{
                k: DefaultParamsReader.loadParamsInstance(f"{path}/stages/{part}_{k}", spark) for k in held["held"]}}
        ff.fitted = fitted
        return FeatureModel(ff)


def fit_and_save(factory: FeatureFactory, df: DataFrame, path: str, y: str | None = None, fold: str = "fold",
                 overwrite: bool = False) -> FeatureModel:
    """Fits, saves and gives the model."""
    model = FeatureEstimator(factory, y, fold).fit(df)
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)
    return model


