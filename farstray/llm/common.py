"""What the operators of this subpackage share: checkpoints, sized joins, byte-level word splitting."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side of at most this many rows may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 200_000

#: Bytes of an Arrow batch of texts; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is missing, a folder of this process is used and removed at its end; that is for local masters
    only, as executors elsewhere would not see it.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="checkpoints-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own_dir[0])
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint(eager=True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a checkpointed join side for broadcast if its counted rows are at most ``limit``."""
    return F.broadcast(df) if df.count() <= limit else df


def sized_bytes(df: DataFrame, column: str, limit: int = 1 << 20) -> DataFrame:
    """Mark a checkpointed join side for broadcast if its rows, of which ``column`` varies in length, take ``limit`` bytes at most."""
    size = df.agg(F.sum(F.octet_length(column)) + 64 * F.count("*")).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches hold at most so many rows and about ``BATCH_BYTES`` in this session.

    A batch of whole texts is held several times at once, by the JVM and by Python; smaller row limits of the session stay,
    and so does any byte limit but Spark's own.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's own
        spark.conf.set(name, BATCH_BYTES)


def row_key(docs: DataFrame) -> F.Column:
    """A 64-bit key of a row's doc_id and text; rows that repeat both share it."""
    return F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), docs["doc_id"].isNull(), docs["text"])


def crc_mod3(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def tidy(work, tables=None):
    """``work`` on Arrow batches, with ``release`` at the end of each task, when its own arrays are gone.

    ``tables`` is the key of its ``worker_tables``; those of other operators are given back before it begins.
    """

    def run(batches):
        give_back(tables)
        try:
            yield from work(batches)
        finally:
            release()

    return run


_held: dict = {}
_libc: list = []


def give_back(but=None) -> None:
    """Drop the worker tables of all operators but one.

    A task's own function travels with copies of the globals that it names; only what a function of this module names are this
    worker's tables.
    """
    if any(key != but for key in _held):
        _held.clear()
        release()


def release() -> None:
    """Give memory that is free in this Python worker back to the system; workers stay, and so would what they once took."""
    import pyarrow as pa

    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library
            _libc.append(lambda _: 0)
    pa.default_memory_pool().release_unused()
    _libc[0](0)


def worker_tables(key, make):
    """What ``make()`` gives, kept in this Python worker for later tasks until another operator begins here.

    Workers outlive a query, and the tables of one operator would take the memory of the next.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


# --- words of whole Arrow batches -------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
#: 64-bit mixing constants for bytes and for the places of words in a shingle; any fixed odd values do.
BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(np.ceil(np.log2(max(n, 1024))))
        for k, base in enumerate((_STEP, _STEP_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def slices(column, most_bytes: int = 256_000):
    """(first row, offsets, bytes) of runs of rows of an Arrow string column, null as empty.

    A run holds about ``most_bytes``; one longer text is a run of its own, so memory follows the longest text.
    """
    import pyarrow as pa

    _held.clear()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        end = min(end, n)
        yield at, (offsets[at : end + 1] - offsets[at]), data[offsets[at] : offsets[end]]
        at = end
    release()


def word_spans(offsets: np.ndarray, data: np.ndarray, is_gap: np.ndarray = ASCII_SPACE):
    """(start, end, row) of every word: a maximal run of bytes outside ``is_gap`` within one row."""
    if not len(data):
        return (np.zeros(0, dtype=np.int64),) * 3
    word = ~is_gap[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    closing = inner[inner > 0] - 1
    ends[closing] = word[closing]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes (polynomial over random byte codes, then mixed)."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit fingerprint of each run of ``size`` consecutive word fingerprints (rows are not looked at)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h *= _STEP
        h += words[k : k + n]
    return mix(h)
