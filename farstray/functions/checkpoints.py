"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir``.

    Only a local master may do without that setting: a folder of this process serves it and goes at its end.
    """
    session = df.sparkSession
    if not session.sparkContext.getCheckpointDir():
        shared = session.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not re.match(r"local(\[|$)", session.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
            if not _own:
                _own.append(tempfile.mkdtemp(prefix="checkpoints-"))
                atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
            shared = _own[0]
        session.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def shared_folder(session: SparkSession, name: str) -> str:
    """A new folder for files, beside the checkpoints; it is not there yet."""
    if not session.sparkContext.getCheckpointDir():
        checkpointed(session.range(0))
    return f"{session.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
