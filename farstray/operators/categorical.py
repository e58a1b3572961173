"""Rare categories: values whose frequency is far below what the column's other values have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farstray.functions import columns as C
from farstray.functions.checkpoints import checkpointed
from farstray.functions.sampling import uniform_sample

MOST_COLUMNS = 50
RELATIVE = 0.3
#: A column's frequency table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 8 << 20


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """column, value (as text, null kept), n: one shuffle for all columns, added up before it."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]
    return df.select(F.explode(F.array(*cells)).alias("s")).groupBy("s.column", "s.value").agg(F.count("*").alias("n")) if names else df.sparkSession.createDataFrame([], "column string, value string, n long")


def print_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """column, p1, p2 (a 128-bit fingerprint of the value's text, null for null), n: as ``value_counts``, but no text of the table is moved."""
    cells = []
    for i, c in enumerate(names):
        text = F.col(f"`{c}`").cast("string")
        p1, p2 = (F.when(text.isNotNull(), F.xxhash64(*salt, text)) for salt in ([], [F.lit(20_240_229)]))
        cells.append(F.struct(F.lit(i).alias("column"), p1.alias("p1"), p2.alias("p2")))
    found = df.select(F.explode(F.array(*cells)).alias("s")).groupBy("s.column", "s.p1", "s.p2").agg(F.count("*").alias("n"))
    return found.withColumn("column", F.element_at(F.array(*map(F.lit, names)), F.col("column") + 1))


def candidate_columns(counts: DataFrame, names: list[str], rows: int, ratio: float = 0.1, least: int = 10) -> list[str]:
    """Columns with at most ``max(least, rows * ratio)`` different values (null is one); the 50 with the fewest."""
    distinct = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count("*").alias("n")).collect()}
    few = [c for c in names if distinct.get(c, 0) <= max(least, int(rows * ratio))]
    return sorted(few, key=lambda c: (distinct.get(c, 0), names.index(c)))[:MOST_COLUMNS]


def frequencies(counts: DataFrame, names: list[str], rows: int) -> DataFrame:
    """column, value, n, freq of the non-null values; nulls count in the denominator only."""
    return counts.where(F.col("column").isin(names) & F.col("value").isNotNull()).withColumn("freq", F.col("n") / F.lit(rows)) if names else counts.limit(0).withColumn("freq", F.lit(0.0))


def sample_frequencies(df: DataFrame, names: list[str], sample_rows: int, keys: list[str] | None = None) -> DataFrame:
    """Frequencies in a uniform sample; a value that isn't in it has none."""
    sample = uniform_sample(df, sample_rows, keys)
    return frequencies(value_counts(sample, names), names, sample.count())


def rare_categories(
    df: DataFrame, names: list[str] | None = None, threshold: float = 0.01, ratio: float = 0.1, least: int = 10,
    freq: DataFrame | None = None, exclude=(), rows: int | None = None,
) -> DataFrame:
    """Add cat_anomaly_score (the largest rarity of a row's values, 0 to 1) and is_cat_outlier.

    A value is flagged if its frequency is below ``min(threshold, 0.3 / number of values)``.  Nulls have rarity 0 and are
    never flagged; a value without a frequency (unseen in a sample) is, with rarity 1 where frequencies differ.  Different values
    are counted by fingerprints first; texts are counted, in one more scan whose result is written, of columns with few values only.
    """
    names = C.categorical_columns(df, exclude) if names is None else names
    rows = df.count() if rows is None else rows
    none = {"cat_anomaly_score": F.lit(0.0), "is_cat_outlier": F.lit(False)}
    if not names or not rows:
        return df.withColumns(none)
    names = candidate_columns(print_counts(df, names), names, rows, ratio, least)
    if not names:
        return df.withColumns(none)
    freq = frequencies(checkpointed(value_counts(df, names)), names, rows) if freq is None else freq
    stats = {r["column"]: r for r in freq.groupBy("column").agg(F.min("freq").alias("low"), F.max("freq").alias("high"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 32).alias("bytes")).collect()}
    out, rarities, flags = df, [], []
    for i, c in enumerate(names):
        if c not in stats:  # only nulls
            continue
        s = stats[c]
        table = freq.where(F.col("column") == c).select(F.col("value").alias(f"__v{i}"), F.col("freq").alias(f"__f{i}"))
        table = F.broadcast(table) if s["bytes"] <= BROADCAST_BYTES else table
        out = out.join(table, F.col(f"`{c}`").cast("string") == F.col(f"__v{i}"), "left")
        f, known = F.coalesce(F.col(f"__f{i}"), F.lit(0.0)), F.col(f"`{c}`").isNotNull()
        span = s["high"] - s["low"]
        rarities.append(F.when(known & F.lit(span > 0), F.least(F.lit(1.0), (F.lit(s["high"]) - f) / F.lit(span or 1.0))).otherwise(F.lit(0.0)))
        flags.append(known & (f < F.lit(min(threshold, RELATIVE / s["n"]))))
    if not rarities:
        return df.withColumns(none)
    any_flag = flags[0]
    for f in flags[1:]:
        any_flag = any_flag | f
    out = out.withColumns({"cat_anomaly_score": F.round(C.greatest(rarities), 4) + F.lit(0.0), "is_cat_outlier": any_flag})
    return out.select(*(F.col(f"`{c}`") for c in df.columns), "cat_anomaly_score", "is_cat_outlier")
