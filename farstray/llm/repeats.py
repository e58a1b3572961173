"""Removal of repeated word windows: a count-min sketch first, exact grouping of what it lets through second.

The sketch overestimates: a window it counts once occurs once and needs no shuffle.  Windows it counts twice or more
are grouped exactly by fingerprint, so none is lost, and each document learns which of its windows start in a document
with a smaller doc_id.  Of windows that very many documents hold, the smallest doc_id is found by an aggregate that tasks
begin, and no group is gathered.  The sketch has a bounded size; where the corpus outgrows it, it lets more through and the second
pass, which is exact, does more of the work.  Windows are compared by 64-bit fingerprints of their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farstray.llm import packed
from farstray.llm.common import checkpointed, run_hashes, sized_bytes, slices, small_batches, tidy, word_hashes, word_spans

NO_ID = np.iinfo(np.int64).max


def windows(column, size: int):
    """(row, fingerprint) arrays of all windows of ``size`` words in an Arrow text column, a slice at a time."""
    for at, offsets, data in slices(column):
        start, end, row = word_spans(offsets, data)
        runs = run_hashes(word_hashes(data, start, end), size)
        within = row[: len(runs)] == row[size - 1 : size - 1 + len(runs)]
        yield row[: len(runs)][within] + at, runs[within]


def _least_owners(texts: DataFrame, keys: np.ndarray, size: int) -> np.ndarray:
    """The smallest owner of each of the sorted windows ``keys``."""
    out = np.zeros(len(keys), dtype=np.uint64)
    if not len(keys):
        return out
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def least(batches):
        import pyarrow as pa

        known = shared.value
        best = np.full(len(known), NO_ID)
        seen = np.zeros(len(known), dtype=bool)
        for batch in batches:
            owner = batch.column("owner").to_numpy(zero_copy_only=False)
            for row, h in windows(batch.column("text"), size):
                hit, at = packed.is_in(known, h)
                np.minimum.at(best, at[hit], owner[row[hit]])
                seen[at[hit]] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[at])], names=["at", "least"])

    found = texts.select("owner", "text").mapInArrow(tidy(least), "at long, least long").groupBy("at").agg(F.min("least").alias("least")).toArrow()
    out[found["at"].to_numpy()] = found["least"].to_numpy().view(np.uint64)
    shared.destroy()
    return out


def remove_repeats(docs: DataFrame, size: int = 13, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept`` with ``keep_text``) of every document.

    Words are what stands between ASCII white space.  A word goes if a window of ``size`` words that covers it also starts
    in a document with a smaller doc_id; all is judged on the input.  Null and empty texts have no words.  A null doc_id
    counts as larger than every other.  Rows that repeat a doc_id lose nothing to each other.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("owner"), "text")
    size_of_all = packed.text_bytes(texts)
    bits = packed.log2_cells(size_of_all // 7)
    bitmap = packed.count_min(texts.select("text"), lambda batch: (h for _, h in windows(batch.column("text"), size)), bits)
    sketch = spark.sparkContext.broadcast(bitmap)

    def suspects(batch):
        owner = batch.column("owner").to_numpy(zero_copy_only=False)
        for row, h in windows(batch.column("text"), size):
            hit = packed.marked(sketch.value, bits, h)
            yield owner[row[hit]], h[hit]

    def losers(_, parts):
        (owner, value, first), (heavy_owner, heavy_value, heavy_least) = packed.grouped(parts)
        least = np.repeat(owner[first], np.diff(np.r_[first, len(owner)]))  # sorted: a group's first owner is its smallest
        lost = owner > least
        yield owner[lost], value[lost]
        lost = heavy_owner > heavy_least.view(np.int64)
        yield heavy_owner[lost], heavy_value[lost]

    heavy, _ = packed.heavy_items(texts.select("text"), lambda batch: (h for _, h in windows(batch.column("text"), size)), size_of_all)
    heavy = spark.sparkContext.broadcast((heavy, _least_owners(texts, heavy, size)))
    rows = packed.pairs_by_range(texts.select("owner", "text"), suspects, heavy)
    lost = checkpointed(packed.answered(rows, losers, "owner", ["lost"]))
    both = texts.join(sized_bytes(lost, "lost"), "owner", "left").select("doc_id", "text", "lost")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, text, lost in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("lost").to_pylist()):
                words = (text.as_py() or "").encode("utf-8").split()
                kept = words
                if lost:
                    gone = np.unique(np.frombuffer(lost, dtype=np.uint64))
                    h = np.concatenate([h for _, h in windows(pa.array([text.as_py()], pa.string()), size)])
                    starts = np.flatnonzero(np.isin(h, gone, kind="sort"))
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    edges[starts] += 1
                    edges[np.minimum(starts + size, len(words))] -= 1
                    kept = [w for w, c in zip(words, np.cumsum(edges[:-1])) if not c]
                text_left = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(text_left).hexdigest(), text_left.decode("utf-8") if keep_text else None))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 + keep_text])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + keep_text])

    return both.mapInArrow(tidy(cut), schema)
