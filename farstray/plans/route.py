"""Which detector suits a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farstray.config import Settings
from farstray.operators.profile import TableProfile


def route_column(size_mb: Column, rows: Column, dimensions: Column, skewness: Column, s: Settings = Settings()) -> Column:
    """As an expression over a table of profiles; the first rule that applies counts, all limits are exclusive."""
    return (
        F.when(size_mb > s.route_incremental_size_mb, "incremental")
        .when(rows > s.route_hbos_row_threshold, "hbos")
        .when(dimensions > s.route_high_dim_threshold, "iforest")
        .when(skewness > s.route_skewness_threshold, "lof")
        .otherwise("iforest")
    )


def choose_algorithm(profile: TableProfile, s: Settings = Settings()) -> str:
    if s.algorithm != "auto":
        return s.algorithm
    if profile.size_mb > s.route_incremental_size_mb:
        return "incremental"
    if profile.rows > s.route_hbos_row_threshold:
        return "hbos"
    if profile.usable_dimensions > s.route_high_dim_threshold:
        return "iforest"
    return "lof" if profile.mean_skewness > s.route_skewness_threshold else "iforest"
