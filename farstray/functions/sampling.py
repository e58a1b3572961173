"""Deterministic uniform samples, order-free: rows in the order of a hash of their key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of so many times the wanted rows is first cut to about ``SPARE`` times as many by the hash.
LARGE, SPARE = 50, 4


def sample_order(df: DataFrame, keys: list[str] | None = None):
    """md5 of the keys' texts, then the texts; keys default to all columns that have a text."""
    keys = keys or [f.name for f in df.schema.fields if f.dataType.simpleString() not in ("binary",) and not f.dataType.simpleString().startswith(("map", "array", "struct"))]
    text = F.concat_ws("\u0001", *(F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\u0002")) for k in keys))
    return [F.md5(text), text]


def uniform_sample(df: DataFrame, rows: int, keys: list[str] | None = None) -> DataFrame:
    """``rows`` rows (all, if fewer): the first in the order of the hash.

    Of a large table only rows with a small hash reach the top-n, so that a task sends a few of them, not ``rows`` each.
    Where too few rows have one, as many share a key, all take part.
    """
    order = sample_order(df, keys)
    total = df.count()
    if total > LARGE * rows:
        low = df.where(order[0] < F.lit(f"{int(SPARE * (rows + 100) / total * 16**8):08x}"))
        if low.count() >= rows:
            df = low
    return df.orderBy(*order).limit(rows)
