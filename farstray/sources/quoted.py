"""CSV files whose fields hold line breaks, read by many tasks.

Whether a physical line begins within quotes depends on all lines before it.  So every line is first brought down to what it does to that state,
one of four ways (keep it, turn it, leave it open, leave it closed); tasks join the lines of their block of a file to what the block does, the
blocks of a file are joined in order, which tells each block's true begin, and the tasks then cut their own lines into records.  A record that
crosses blocks comes in pieces, which meet by record; all others stay where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a line does: bit 0 is whether it leaves quotes open if it begins outside, bit 1 if it begins within.
KEEP = 2

OUTSIDE, WITHIN, CLOSED = 0, 1, 2


def open_after(value: Column, within: bool) -> Column:
    """Whether quotes are open at the end of a line that begins outside or ``within`` them.

    A quote opens at the begin of a field only, and two within quotes are one.  The text between quotes is folded in order: after a
    closing quote another one at once takes it back.
    """
    between = F.split(value, '"')
    marked = F.transform(F.slice(between, 1, F.size(between) - 1), lambda s, i: F.struct(s.alias("s"), (i == 0).alias("first")))

    def quote(state: Column, part: Column) -> Column:
        opens = F.endswith(part["s"], F.lit(",")) | ((part["s"] == "") & part["first"])
        after = F.when(opens, WITHIN).otherwise(OUTSIDE)
        return F.when(state == WITHIN, CLOSED).when((state == CLOSED) & (part["s"] == ""), WITHIN).otherwise(after)

    return F.aggregate(marked, F.lit(WITHIN if within else OUTSIDE), quote) == WITHIN


def turn_of(value: Column) -> Column:
    """What a line does to the state, as a small number."""
    either = F.when(open_after(value, False), 1).otherwise(0) + F.when(open_after(value, True), 2).otherwise(0)
    return F.when(F.contains(value, F.lit('"')), either).otherwise(KEEP).cast("int")


def joined(turns: np.ndarray) -> np.ndarray:
    """What the first 1, 2, ... of ``turns`` do together."""
    fixed = (turns == 0) | (turns == 3)
    swaps = np.cumsum(turns == 1)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(turns)), -1))
    since = (swaps - np.where(last >= 0, swaps[last], 0)) % 2
    by_last = np.where((turns[last] == 3) ^ (since == 1), 3, 0)
    return np.where(last >= 0, by_last, np.where(since == 1, 1, KEEP))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    where = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), where.alias("block"))


def _runs(batch):
    """(begin, end) of the lines of one block within an Arrow batch."""
    block = batch.column("block").to_numpy()
    cuts = np.r_[np.flatnonzero(np.diff(block)) + 1, len(block)] if len(block) else np.zeros(0, dtype=int)
    return list(zip(np.r_[0, cuts[:-1]].tolist(), cuts.tolist())) if len(cuts) else []


@dataclass(frozen=True)
class QuoteStates:
    """For all blocks of the files: which there are, which begin within quotes; whether a file ends so, and whether any line turns the state."""

    known: np.ndarray
    within: np.ndarray
    open_end: bool
    turned: bool


def quote_states(spark: SparkSession, path: str) -> QuoteStates:
    """One pass that sends a row for each block of a file, and one composition of them by file."""

    def summed(batches):
        import pyarrow as pa

        held: list = []  # path, start, block, turn of the block under way
        for batch in batches:
            rows = []
            turns = batch.column("turn").to_numpy()
            for b, e in _runs(batch):
                block, turn = batch.column("block")[b].as_py(), int(joined(turns[b:e])[-1])
                if held and held[2] == block:
                    held[3] = int(joined(np.array([held[3], turn]))[-1])
                else:
                    if held:
                        rows.append(held)
                    held = [batch.column("path")[b].as_py(), batch.column("start")[b].as_py(), block, turn]
            yield made(rows)
        yield made([held] if held else [])

    def made(rows):
        import pyarrow as pa

        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32()))], names=["path", "start", "block", "turn"])

    lines = lines_of(spark, path).select("path", "start", "block", turn_of(F.col("value")).alias("turn"))
    blocks = lines.mapInArrow(summed, "path string, start long, block long, turn int")
    # blocks in order of their file: two numbers for each, composed by a fixed state's last place and the turns since
    in_file = Window.partitionBy("path").orderBy("start")
    fixed = F.when(F.col("turn").isin(0, 3), F.struct((F.col("turn") == 3).alias("open"), F.col("swaps").alias("swaps")))
    found = blocks.withColumn("swaps", F.sum((F.col("turn") == 1).cast("long")).over(in_file)).withColumn("fixed", F.last(fixed, True).over(in_file))
    ends = F.coalesce(F.col("fixed.open"), F.lit(False)) != (F.pmod(F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0)), F.lit(2)) == 1)
    found = found.withColumn("open", ends).withColumn("within", F.coalesce(F.lag("open").over(in_file), F.lit(False)))
    found = found.withColumn("last", F.lead("block").over(in_file).isNull()).select("block", "within", (F.col("last") & F.col("open")).alias("cut"), (F.col("turn") != KEEP).alias("turned"))
    rows = found.toArrow()  # some bytes for each block of the files
    block, within = rows["block"].to_numpy(), rows["within"].to_numpy(zero_copy_only=False).astype(bool)
    return QuoteStates(np.sort(block), np.sort(block[within]), bool(np.any(rows["cut"].to_numpy(zero_copy_only=False))), bool(np.any(rows["turned"].to_numpy(zero_copy_only=False))) or bool(within.any()))


PIECE, FIRST_RECORD = 1, 2


def _in(sorted_: np.ndarray, value: int) -> bool:
    at = int(np.searchsorted(sorted_, value))
    return at < len(sorted_) and sorted_[at] == value


def cut_records(lines: DataFrame, states) -> DataFrame:
    """record, path, start, part and kind of every record or piece of one; ``states`` is a broadcast ``QuoteStates``.

    ``part`` is 1 for a piece that goes on with a record of an earlier block and 2 for one that begins a record.  ``kind`` has the bits ``PIECE`` and
    ``FIRST_RECORD`` (of a file; blank lines before it are none).
    """

    def run(batches):
        known, inside = states.value.known, states.value.within
        block, text, is_open, begun, at_start = None, [], False, False, False
        out: list[tuple] = []
        path = start = None

        def close(kind: int, part: int):
            nonlocal at_start
            record = "\n".join(text)
            at_first, at_start = at_start and part != 1, at_start and not record.strip()
            out.append((record, path, start, part, kind | FIRST_RECORD * at_first))
            text.clear()

        def leave():
            """What a block ends with: a piece of a record that goes on in the next block, if any."""
            if block is not None and text:
                close(PIECE, 2 if begun else 1)

        for batch in batches:
            turns, values = batch.column("turn").to_numpy(), batch.column("value")
            for b, e in _runs(batch):
                now = batch.column("block")[b].as_py()
                if now != block:
                    leave()
                    if not _in(known, now):
                        raise ValueError("the files have been split in another way than when their quotes were counted; read them again")
                    block, path, start = now, batch.column("path")[b].as_py(), batch.column("start")[b].as_py()
                    is_open, begun = _in(inside, now), not _in(inside, now)
                    at_start = start == 0
                done = joined(turns[b:e])
                opened = np.where(is_open, done >= 2, done % 2 == 1)  # after each line
                for value, after in zip(values[b : e].to_pylist(), opened.tolist()):
                    text.append(value)
                    if after:
                        continue
                    if begun:
                        close(0, 0)
                    else:
                        close(PIECE, 1)
                        begun = True
                is_open = bool(opened[-1])
            yield made(out)
            out.clear()
        leave()
        yield made(out)

    def made(rows):
        import pyarrow as pa

        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()))], names=["record", "path", "start", "part", "kind"])

    shaped = lines.select("value", "path", "start", "block", turn_of(F.col("value")).alias("turn"))
    return shaped.mapInArrow(run, "record string, path string, start long, part int, kind int")


def records(spark: SparkSession, path: str, states: QuoteStates | None = None) -> DataFrame:
    """record and first (whether it is its file's first) of all records of the files, whatever lines they go over.  Blank lines are left out."""
    shared = spark.sparkContext.broadcast(states or quote_states(spark, path))
    cut = cut_records(lines_of(spark, path), shared)
    is_piece = F.col("kind").bitwiseAND(PIECE) != 0
    first = F.col("kind").bitwiseAND(FIRST_RECORD) != 0
    whole, pieces = cut.where(~is_piece).select("record", first.alias("first")), cut.where(is_piece)
    in_order = Window.partitionBy("path").orderBy("start", "part")  # two rows a block at most
    numbered = pieces.withColumn("of", F.sum((F.col("part") == 2).cast("long")).over(in_order))
    mended = numbered.groupBy("path", "of").agg(F.array_sort(F.collect_list(F.struct("start", "part", "record"))).alias("all"), F.bool_or(first).alias("first"))
    mended = mended.select(F.array_join(F.transform("all", lambda p: p["record"]), "\n").alias("record"), "first")
    both = whole.unionByName(mended).withColumn("record", F.rtrim(F.col("record"), F.lit("\r")))
    return both.where(F.trim("record") != "")
