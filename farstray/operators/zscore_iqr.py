"""Outliers by z-score and distance beyond the quartile fences, the larger over a row's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farstray.functions import columns as C
from farstray.functions.quantiles import order_statistic
from farstray.operators.scoring import PLACES


def zscore_iqr(df: DataFrame, names: list[str], contamination: float = 0.05) -> DataFrame:
    """Add anomaly_score and is_outlier: the rows whose score reaches the ``floor(n (1 - contamination))``-th one.

    Quartiles are the values at ``floor(n / 4)`` and ``floor(3 n / 4)``, not interpolated; missing values are skipped.
    """
    if not names:
        raise ValueError("there is no numeric column")
    r = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    parts = []
    for i, c in enumerate(names):
        q1, q3 = (order_statistic(df, c, lambda n, p=p: int(n * p)) for p in (0.25, 0.75))
        if q1 is None:
            continue
        iqr, x = q3 - q1, F.col(f"`{c}`").cast("double")
        beyond = F.greatest(F.lit(q1 - 1.5 * iqr) - x, x - F.lit(q3 + 1.5 * iqr), F.lit(0.0)) / F.lit(iqr if iqr else 1.0)
        z = F.abs(x - F.lit(r[f"m{i}"])) / F.lit(r[f"s{i}"] or 1.0)
        parts.append(F.coalesce(0.6 * z + 0.4 * (beyond if iqr else F.lit(0.0)), F.lit(0.0)))
    if not parts:
        return df.withColumns({"anomaly_score": F.lit(0.0), "is_outlier": F.lit(False)})
    scored = df.withColumn("__raw", F.round(C.greatest(parts), PLACES))
    low, high, n = scored.agg(F.min("__raw"), F.max("__raw"), F.count("*")).first()
    cut = order_statistic(scored, "__raw", lambda n: int(n * (1 - contamination)))
    score = F.round((F.col("__raw") - F.lit(low)) / F.lit((high - low) or 1.0), 4) + F.lit(0.0)
    return scored.withColumns({"anomaly_score": score, "is_outlier": F.col("__raw") >= F.lit(cut)}).drop("__raw")
