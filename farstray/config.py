"""Settings of a detection run and their valid ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields

ALGORITHMS = ("auto", "iforest", "hbos", "lof", "cblof", "ocsvm", "ensemble", "incremental")
SCALINGS = ("robust", "standard", "minmax", "none")
IMPUTATIONS = ("median", "mean", "zero", "drop")
FREQUENCY_MODES = ("two-pass", "single-pass")

#: Inclusive ranges; None is open.
RANGES = {
    "contamination": (0.001, 0.20),
    "cat_rare_threshold": (0.001, 0.50),
    "cat_max_cardinality_ratio": (0.01, 1.0),
    "cat_min_cardinality": (1, None),
    "profiler_id_cardinality_ratio": (0.10, 1.0),
    "numeric_cast_threshold": (0.50, 1.0),
    "profiler_sample_rows": (100, 100_000),
    "global_sample_rows": (1000, 500_000),
    "lof_reference_rows": (2, 500_000),
    "ocsvm_sample_rows": (2, 500_000),
    "route_incremental_size_mb": (50, 10_000),
    "route_hbos_row_threshold": (10_000, None),
    "route_high_dim_threshold": (5, 1000),
    "route_skewness_threshold": (1.0, 20.0),
}
CHOICES = {"algorithm": ALGORITHMS, "scaling": SCALINGS, "impute": IMPUTATIONS, "cat_freq_mode": FREQUENCY_MODES, "on_datetime": ("passthrough", "ignore"), "on_error": ("raise", "zero")}


@dataclass(frozen=True)
class Settings:
    algorithm: str = "auto"
    contamination: float = 0.05
    scaling: str = "robust"
    impute: str = "median"
    output_path: str = "results/output.parquet"
    explain: bool = False
    max_explain_rows: int = 100
    cat_rare_threshold: float = 0.01
    cat_max_cardinality_ratio: float = 0.10
    cat_min_cardinality: int = 10
    cat_freq_mode: str = "two-pass"
    profiler_id_cardinality_ratio: float = 0.50
    numeric_cast_threshold: float = 0.80
    profile_sampled: bool = False
    profiler_sample_rows: int = 1000
    global_sample_rows: int = 50_000
    lof_reference_rows: int = 50_000
    ocsvm_sample_rows: int = 50_000
    route_incremental_size_mb: float = 500
    route_hbos_row_threshold: int = 1_000_000
    route_high_dim_threshold: int = 50
    route_skewness_threshold: float = 5.0
    exclude_columns: tuple[str, ...] = ()
    clip: bool = True
    on_datetime: str = "passthrough"
    on_error: str = "raise"

    def __post_init__(self) -> None:
        object.__setattr__(self, "exclude_columns", tuple(self.exclude_columns))
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")
        for name, (low, high) in RANGES.items():
            value = getattr(self, name)
            if value < low or high is not None and value > high:
                raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else "") + f", not {value}")

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]
