"""A model's state by epoch, in a folder of any store that Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class EpochStore:
    """One text for each epoch of a stream.  An epoch counts once its files have been written whole; ``keep`` of the latest stay."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _store(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _path(self, epoch: int) -> str:
        return f"{self.folder}/epoch={epoch:012d}"

    def epochs(self) -> list[int]:
        """Whole epochs, in order."""
        store, where = self._store(self.folder)
        if not store.exists(where):
            return []
        names = [f.getPath().getName() for f in store.listStatus(where)]
        return sorted(e for e in (int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=")) if self.has(e))

    def has(self, epoch: int) -> bool:
        store, where = self._store(self._path(epoch) + "/_SUCCESS")
        return store.exists(where)

    def load(self, epoch: int) -> dict:
        return json.loads(self.spark.read.text(self._path(epoch), wholetext=True).first()[0])

    def save(self, epoch: int, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(self._path(epoch))
        for old in self.epochs()[: -self.keep]:
            store, where = self._store(self._path(old))
            store.delete(where, True)
