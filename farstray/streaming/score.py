"""Detection on streams: stateless scoring by a fitted detector, and incremental fitting by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from farstray.operators.incremental import IncrementalModel
from farstray.plans.engine import Detector
from farstray.streaming.state import EpochStore


def score_stream(stream: DataFrame, detector: Detector) -> DataFrame:
    """Scores are expressions and Arrow batches over single rows, so they need no state."""
    return detector.transform(stream)


class StreamFitter:
    """Fits an incremental model, one gradient step for each micro-batch.

    With a ``store`` each epoch's model is written there before the epoch ends, made of the epoch before.  A stream that is begun again
    goes on from the store, and an epoch that is handed out twice, as it may be after a failure, changes nothing the second time.
    """

    def __init__(self, model: IncrementalModel, store: EpochStore | None = None):
        self.first, self.model, self.store = model, model, store
        known = store.epochs() if store else []
        if known:
            self.model = IncrementalModel.of(store.load(known[-1]))

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if self.store is None:
            self.model = self._stepped(self.model, batch)
            return
        if not self.store.has(epoch):
            before = [e for e in self.store.epochs() if e < epoch]
            begun = IncrementalModel.of(self.store.load(before[-1])) if before else self.first
            self.store.save(epoch, self._stepped(begun, batch).state())
        self.model = IncrementalModel.of(self.store.load(epoch))

    @staticmethod
    def _stepped(model: IncrementalModel, batch: DataFrame) -> IncrementalModel:
        return model if batch.isEmpty() else model.step(batch)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Go on with ``stream`` from ``checkpoint``, where the offsets are and, beside them, the model."""
        if self.store is None:
            self.__init__(self.first, EpochStore(stream.sparkSession, f"{checkpoint.rstrip('/')}/model"))
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
