"""Thresholds, bounds and flags of scores that a detector gives."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farstray.functions import columns as C
from farstray.functions.quantiles import exact_quantiles

#: Raw scores are compared after rounding to so many places, so that the order of additions can't flip a flag.
PLACES = 10


def matrix(columns: pd.DataFrame) -> np.ndarray:
    """Feature columns of an Arrow batch, or the one column of arrays that holds them all, as rows of numbers."""
    if columns.shape[1] == 1 and len(columns) and isinstance(columns.iloc[0, 0], (list, np.ndarray)):
        return np.vstack(columns.iloc[:, 0].to_numpy()).astype(float)
    return columns.to_numpy(dtype=float)


def collected(sample: DataFrame, names: list[str]) -> np.ndarray:
    """The features of a bounded sample on the driver."""
    kinds = dict(sample.dtypes)
    return matrix(sample.select(*((F.col(f"`{c}`") if kinds[c].startswith("array") else F.col(f"`{c}`").cast("double")).alias(f"x{i}") for i, c in enumerate(names))).toPandas())


@dataclass(frozen=True)
class Bounds:
    low: float
    high: float
    threshold: float


def fit_bounds(scores: DataFrame, contamination: float, column: str = "raw") -> Bounds | None:
    """Least and largest score, and the score that the top ``contamination`` share reaches."""
    n, low, high = scores.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n:
        return None
    return Bounds(low, high, exact_quantiles(scores.select(column), [column], [1 - contamination], n)[column][0])


def flagged(df: DataFrame, bounds: Bounds | None, raw: str = "raw") -> DataFrame:
    """Add anomaly_score and is_outlier; without bounds, or where all scores are equal, nothing is flagged.

    A row without a raw score (its features were dropped) scores 0 and isn't flagged.
    """
    if bounds is None or bounds.low == bounds.high:
        return df.withColumns({"anomaly_score": F.lit(0.0), "is_outlier": F.lit(False)})
    score = C.normalised(F.col(raw), F.lit(bounds.low), F.lit(bounds.high))
    return df.withColumns({"anomaly_score": score, "is_outlier": F.coalesce(F.col(raw) >= F.lit(bounds.threshold), F.lit(False))})


def score_histogram(df: DataFrame, column: str = "anomaly_score", bins: int = 30) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def top_outliers(df: DataFrame, key: str, n: int = 500, text: int = 300) -> DataFrame:
    """The first ``n`` flagged rows by key, with long texts cut for the report."""
    cut = [F.substring(F.col(f"`{f.name}`"), 1, text).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.where("is_outlier OR is_cat_outlier").orderBy(key).limit(n).select(*cut)


def summary(df: DataFrame, algorithm: str = "") -> DataFrame:
    """One row: how many rows, numeric, categorical and combined outliers, and their shares in percent."""
    counts = df.agg(
        F.count("*").alias("total_rows"),
        F.count_if("is_outlier").alias("numeric_outliers"),
        F.count_if("is_cat_outlier").alias("categorical_outliers"),
        F.count_if(F.col("is_outlier") | F.col("is_cat_outlier")).alias("combined_outliers"),
    )
    share = {f"{k}_pct": F.coalesce(F.round(F.try_divide(100.0 * F.col(f"{k}_outliers"), F.col("total_rows")), 2), F.lit(0.0)) for k in ("numeric", "categorical", "combined")}
    return counts.withColumns(share | {"algorithm": F.lit(algorithm)})


def precision_recall(df: DataFrame, flag, truth) -> DataFrame:
    """Confusion counts of two boolean expressions, with precision, recall and F1 (null where undefined)."""
    r = df.select(flag.alias("f"), truth.alias("t")).where("f is not null and t is not null")
    r = r.agg(F.count_if(F.expr("f and t")).alias("tp"), F.count_if(F.expr("f and not t")).alias("fp"), F.count_if(F.expr("not f and t")).alias("fn"), F.count_if(F.expr("not f and not t")).alias("tn"))
    precision, recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return r.select("tp", "fp", "fn", "tn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))
