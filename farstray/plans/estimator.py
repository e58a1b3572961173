"""The detectors as ``pyspark.ml`` stages: fitted in pipelines, saved to any store that Spark writes to, and loaded in another session."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from farstray.config import Settings
from farstray.operators import cblof, features, forest, hbos, incremental, lof, neighbours, ocsvm, scoring, vectors
from farstray.plans.engine import Detector, EnsembleModel, fit_detector

#: Classes that a saved detector may be made of; nothing else is built from a file.
PARTS = {
    c.__name__: c
    for module in (cblof, features, forest, hbos, incremental, lof, neighbours, ocsvm, scoring, vectors)
    for c in vars(module).values()
    if dataclasses.is_dataclass(c) and isinstance(c, type) or c is neighbours.Boxes
} | {"Detector": Detector, "EnsembleModel": EnsembleModel}


def packed(value):
    """``value`` as JSON can hold it: plain values, arrays, tuples, broadcasts and the classes of ``PARTS``."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "dtype": "object" if value.dtype == object else value.dtype.str, "shape": list(value.shape)}
    if isinstance(value, (list, tuple)):
        return {type(value).__name__: [packed(v) for v in value]}
    if isinstance(value, dict):
        return {"dict": [[packed(k), packed(v)] for k, v in value.items()]}
    if type(value) is PARTS.get(type(value).__name__):
        return {"part": type(value).__name__, "fields": {k: packed(v) for k, v in vars(value).items()}}
    if hasattr(value, "value") and hasattr(value, "unpersist"):
        return {"broadcast": packed(value.value)}
    raise TypeError(f"a {type(value).__name__} can't be saved")


def unpacked(spark: SparkSession, value):
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.array(value["array"], dtype=value["dtype"]).reshape(value["shape"])
    if "broadcast" in value:
        return spark.sparkContext.broadcast(unpacked(spark, value["broadcast"]))
    if "part" in value:
        made = object.__new__(PARTS[value["part"]])
        for k, v in value["fields"].items():
            object.__setattr__(made, k, unpacked(spark, v))
        return made
    if "dict" in value:
        return {unpacked(spark, k): unpacked(spark, v) for k, v in value["dict"]}
    kind = "tuple" if "tuple" in value else "list"
    items = [unpacked(spark, v) for v in value[kind]]
    return tuple(items) if kind == "tuple" else items


def save_detector(spark: SparkSession, detector: Detector, path: str) -> None:
    """One text of JSON; the model is bounded, as it has been sent to all tasks."""
    text = json.dumps(packed(dataclasses.replace(detector, table=None, places=None)))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def load_detector(spark: SparkSession, path: str) -> Detector:
    return unpacked(spark, json.loads(spark.read.text(path, wholetext=True).first()[0]))


class _Named(Params):
    algorithm = Param(Params._dummy(), "algorithm", "which detector", TypeConverters.toString)
    key = Param(Params._dummy(), "key", "column that names a row, or nothing", TypeConverters.toString)
    inputCols = Param(Params._dummy(), "inputCols", "numeric columns; all of them, if there are none", TypeConverters.toListString)
    settings = Param(Params._dummy(), "settings", "settings other than the defaults, as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(algorithm="iforest", key="", inputCols=[], settings="{}")


class OutlierDetector(Estimator, _Named, DefaultParamsReadable, DefaultParamsWritable):
    """Fits one of the detectors; its model adds anomaly_score and is_outlier."""

    @keyword_only
    def __init__(self, *, algorithm: str = "iforest", key: str = "", inputCols: list[str] | None = None, settings: str = "{}"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> OutlierModel:
        chosen = Settings(**json.loads(self.getOrDefault("settings")))
        detector = fit_detector(dataset, self.getOrDefault("algorithm"), chosen, self.getOrDefault("inputCols") or None, self.getOrDefault("key") or None)
        return self._copyValues(OutlierModel(detector))


class OutlierModel(Model, _Named, MLReadable, MLWritable):
    def __init__(self, detector: Detector | None = None):
        super().__init__()
        self.detector = detector

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.detector.transform(dataset)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: OutlierModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        save_detector(self.sparkSession, self.instance.detector, f"{path}/detector")


class _ModelReader(MLReader):
    def __init__(self, kind: type[OutlierModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> OutlierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(load_detector(self.sparkSession, f"{path}/detector"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
