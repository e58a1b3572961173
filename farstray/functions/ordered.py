"""Previous rows and running sums in a given order, without sorting a table in one task.

Rows are dealt into ranges of the order; each range is worked on alone, and one row for each range carries over what the next one needs.
Equal rows of the order stay in one range, so the order should name columns that tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farstray.functions.checkpoints import checkpointed

PART = "__range"


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with its range of the order (ascending, nulls first), checkpointed so that it stays."""
    return checkpointed(df.repartitionByRange(*(F.col(f"`{c}`") for c in order)).withColumn(PART, F.spark_partition_id()))


def _inside(order: list[str]):
    return Window.partitionBy(PART).orderBy(*(F.col(f"`{c}`") for c in order))


def with_previous(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Add ``previous_<column>``, each column's value in the row before (null in the first)."""
    ranged, inside = in_ranges(df, order), _inside(order)
    held = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    # a row for each range, in one small window: what the last row of the range before has
    last = ranged.groupBy(PART).agg(F.max_by(held, F.struct(*(F.col(f"`{c}`") for c in order))).alias("last"))
    carried = last.select(PART, F.lag("last").over(Window.orderBy(PART)).alias("carried"))
    joined = ranged.join(F.broadcast(carried), PART)  # as many rows as there are ranges
    previous = F.when(F.row_number().over(inside) == 1, F.col("carried")).otherwise(F.lag(held).over(inside))
    out = joined.withColumn("__previous", previous)
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"__previous.c{i}").alias(f"previous_{c}") for i, c in enumerate(columns)))


def with_running(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Add ``before_<column>``, the sum of each column over all earlier rows (0 in the first)."""
    ranged = in_ranges(df, order)
    earlier = _inside(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(PART).agg(*(F.sum(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    ranges = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(PART, *(F.coalesce(F.sum(f"c{i}").over(ranges), F.lit(0)).alias(f"__before{i}") for i in range(len(columns))))
    joined = ranged.join(F.broadcast(carried), PART)
    added = {f"before_{c}": F.coalesce(F.sum(f"`{c}`").over(earlier), F.lit(0)) + F.col(f"__before{i}") for i, c in enumerate(columns)}
    return joined.withColumns(added).select(*(F.col(f"`{c}`") for c in df.columns), *added)


def first_differences(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Add ``difference``: the column's value less that of the row before, null in the first row and beside nulls."""
    out = with_previous(df, order, [column])
    return out.withColumn("difference", F.col(f"`{column}`") - F.col(f"previous_{column}")).drop(f"previous_{column}")


def is_consecutive(df: DataFrame, columns: list[str], order: list[str]) -> dict[str, bool]:
    """Which columns go up by exactly one from each value that isn't null to the next; with fewer than two values none does."""
    found = {}
    for c in columns:
        tie = [*order, *([c] if c not in order else [])]
        values = df.where(F.col(f"`{c}`").isNotNull()).select(*(F.col(f"`{k}`") for k in tie)).withColumn("__value", F.col(f"`{c}`").cast("double"))
        r = first_differences(values, "__value", tie).agg(F.count("difference"), F.count_if(F.col("difference") != 1)).first()
        found[c] = r[0] > 0 and r[1] == 0
    return found


def auc(df: DataFrame, score: Column, truth: Column) -> float | None:
    """The area under the ROC curve: how often a true row's score is above a false row's, ties counting half; None without both kinds.

    Rows are counted by score before anything is sorted, and the counts are added up in ranges.
    """
    by_score = df.select(score.cast("double").alias("score"), truth.cast("boolean").alias("truth")).where("score IS NOT NULL AND truth IS NOT NULL")
    by_score = by_score.groupBy("score").agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    below = with_running(by_score, ["score"], ["neg"])
    r = below.agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)), F.sum("pos"), F.sum("neg")).first()
    return r[0] / (r[1] * r[2]) if r[1] and r[2] else None
