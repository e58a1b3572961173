"""Where results go: Parquet with counters taken in the same pass, JSON explanations, and a JSON answer for a client."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from farstray.functions import columns as C
from farstray.operators.scoring import top_outliers


def write_scored(scored: DataFrame, path: str, began: float | None = None) -> dict:
    """Write all rows and count outliers on the way; the counters, their shares, where the rows are and the seconds since ``began`` (``time.perf_counter()``
    at the run's begin; else those of writing)."""
    began = time.perf_counter() if began is None else began
    seen = Observation()
    both = F.col("is_outlier") | F.col("is_cat_outlier")
    counted = scored.observe(seen, F.count(F.lit(1)).alias("total_rows"), F.count_if("is_outlier").alias("numeric_outliers"), F.count_if("is_cat_outlier").alias("categorical_outliers"), F.count_if(both).alias("combined_outliers"))
    counted.write.mode("overwrite").parquet(path)
    out = dict(seen.get)
    share = lambda n: round(100.0 * n / out["total_rows"], 2) if out["total_rows"] else 0.0
    shares = {f"{k}_pct": share(out[f"{k}_outliers"]) for k in ("numeric", "categorical", "combined")}
    return out | shares | {"runtime_seconds": round(time.perf_counter() - began, 2), "output_path": path}


def explanations_path(path: str) -> str:
    return (path[: -len(".parquet")] if path.endswith(".parquet") else path) + ".explanations.json"


def write_explanations(explanations: DataFrame, path: str) -> None:
    explanations.write.mode("overwrite").json(explanations_path(path))


def answer(scored: DataFrame, key: str, summary: dict, profile, explanations: DataFrame | None = None, rows: int = 500, explained: int = 200) -> str:
    """JSON of the profile, the summary, the first outliers and explanations; each list is bounded."""
    outliers = [json.loads(r[0]) for r in top_outliers(scored, key, rows).select(F.to_json(F.struct("*"))).collect()]
    if explanations is not None:
        multiple = lambda f: f.withField("multiple", C.multiple_text(f["actual_value"], f["median_value"]))
        explanations = explanations.withColumn("top_features", F.transform("top_features", multiple))
    texts = [json.loads(r[0]) for r in explanations.limit(explained).select(F.to_json(F.struct("*"))).collect()] if explanations is not None else []
    return json.dumps({"profile": profile, "summary": summary, "outliers": outliers, "explanations": texts}, default=str)
