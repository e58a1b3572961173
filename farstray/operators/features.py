"""From raw columns to features: recover numbers, impute, sanitise, clip, drop constants, scale.

``fit`` runs a few aggregates; ``transform`` is expressions with the fitted statistics as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farstray.functions import columns as C
from farstray.functions.quantiles import exact_quantiles

HIGH_NULL = 0.90
LEAST_VARIANCE = 1e-10
LEAST_CLIP_ROWS = 10


def castable_columns(df: DataFrame, threshold: float = 0.80, exclude=()) -> list[str]:
    """String columns that hold numbers: more than ``threshold`` of the values parse, at most 10 % have a leading zero."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in set(exclude)]
    if not names:
        return []
    stats = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        stats += [F.count(col).alias(f"n{i}"), F.count_if(C.number_of(col).isNotNull()).alias(f"ok{i}"), F.count_if(C.leading_zero(col)).alias(f"zero{i}")]
    r = df.agg(*stats).first()
    return [c for i, c in enumerate(names) if r[f"n{i}"] and r[f"zero{i}"] <= 0.10 * r[f"n{i}"] and r[f"ok{i}"] > threshold * r[f"n{i}"]]


def cast_numeric_strings(df: DataFrame, threshold: float = 0.80, exclude=()) -> DataFrame:
    """Replace castable string columns by doubles; what doesn't parse becomes null."""
    return df.withColumns({c: C.number_of(F.col(f"`{c}`")) for c in castable_columns(df, threshold, exclude)})


@dataclass(frozen=True)
class FeatureModel:
    """Fitted statistics.  ``kept`` are the columns that vary; others are left out by ``transform``."""

    columns: tuple[str, ...]
    kept: tuple[str, ...]
    fill: dict[str, float]
    clip: dict[str, tuple[float, float]]
    scale: dict[str, tuple[float, float]]
    drop_nulls: bool

    def filled(self, name: str):
        col = F.col(f"`{name}`").cast("double")
        return col if self.drop_nulls else F.coalesce(col, F.lit(self.fill[name]))

    def cleaned(self, name: str):
        col = C.sanitized(self.filled(name))
        return C.clipped(col, *self.clip[name]) if name in self.clip else col

    def feature(self, name: str):
        center, divisor = self.scale.get(name, (0.0, 1.0))
        col = self.cleaned(name)
        return C.sanitized((col - F.lit(center)) / F.lit(divisor)) if name in self.scale else col

    def transform(self, df: DataFrame, prefix: str = "f_") -> DataFrame:
        """``df`` with a double column for each kept feature; with ``drop``, rows with a null feature have null there."""
        return df.withColumns({f"{prefix}{c}": self.feature(c) for c in self.kept}) if self.kept else df

    def complete(self):
        """Whether a row takes part in fitting (always, unless rows with nulls are dropped)."""
        if not self.drop_nulls or not self.columns:
            return F.lit(True)
        out = F.lit(True)
        for c in self.columns:
            out = out & F.col(f"`{c}`").isNotNull()
        return out


def fill_values(df: DataFrame, names: list[str], strategy: str) -> dict[str, float]:
    """What nulls become: the statistic of the finite values; 0 for a column with over 90 % nulls or no statistic."""
    if strategy not in ("median", "mean", "zero"):
        raise ValueError(f"unknown imputation {strategy!r}")
    if strategy == "zero" or not names:
        return dict.fromkeys(names, 0.0)
    stats = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        col = F.col(f"`{c}`").cast("double")
        stats += [F.count(col).alias(f"n{i}"), F.avg(col).alias(f"mean{i}"), F.max(F.isnan(col) | (F.abs(col) == float("inf"))).alias(f"odd{i}")]
    r = df.agg(*stats).first()
    finite = {}
    if strategy == "median":
        finite = exact_quantiles(df, [c for i, c in enumerate(names) if not r[f"odd{i}"]], [0.5], r["rows"])
    out = {}
    for i, c in enumerate(names):
        value = r[f"mean{i}"] if strategy == "mean" else (finite.get(c) or [None])[0]
        mostly_null = r["rows"] and r["rows"] - r[f"n{i}"] > HIGH_NULL * r["rows"]
        usable = value is not None and value == value and abs(value) != float("inf")
        out[c] = float(value) if usable and not mostly_null else 0.0
    return out


def impute(df: DataFrame, names: list[str], strategy: str) -> DataFrame:
    if strategy == "drop":
        return df.dropna(subset=names)
    fill = fill_values(df, names, strategy)
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill[c])) for c in names})


def drop_constant_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Those columns whose population variance is above 1e-10."""
    if not names:
        return []
    r = df.agg(*(F.var_pop(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(names))).first()
    return [c for i, c in enumerate(names) if (r[i] or 0.0) > LEAST_VARIANCE]


def fit_scale(df: DataFrame, names: list[str], scaling: str, rows: int) -> dict[str, tuple[float, float]]:
    """Center and divisor of each column; a spread of zero divides by one."""
    if scaling == "none" or rows < 2 or not names:
        return {}
    if scaling == "robust":
        q = exact_quantiles(df, names, [0.25, 0.5, 0.75], rows)
        pairs = {c: (q[c][1], q[c][2] - q[c][0]) for c in names}
    elif scaling in ("standard", "minmax"):
        stats = (F.avg, F.stddev_pop) if scaling == "standard" else (F.min, F.max)
        r = df.agg(*(f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in enumerate(stats))).first()
        pairs = {c: (r[f"0{i}"], r[f"1{i}"] if scaling == "standard" else r[f"1{i}"] - r[f"0{i}"]) for i, c in enumerate(names)}
    else:
        raise ValueError(f"unknown scaling {scaling!r}")
    return {c: (float(a), float(b) if b else 1.0) for c, (a, b) in pairs.items()}


def fit_features(df: DataFrame, names: list[str] | None = None, scaling: str = "robust", strategy: str = "median", exclude=(), clip: bool = True) -> FeatureModel:
    """Fit the whole chain on ``df``; ``names`` default to its numeric columns."""
    names = C.numeric_columns(df, exclude) if names is None else list(names)
    drop = strategy == "drop"
    fill = {} if drop else fill_values(df, names, strategy)
    model = FeatureModel(tuple(names), tuple(names), fill, {}, {}, drop)
    if not names:
        return model
    plain = [f"c{i}" for i in range(len(names))]
    taken = df.where(model.complete())
    clean = taken.select(*(model.cleaned(c).alias(p) for c, p in zip(names, plain)))
    rows = clean.count()
    bounds = {}
    if clip and rows >= LEAST_CLIP_ROWS:
        q = exact_quantiles(clean, plain, [0.01, 0.99], rows)
        bounds = {c: tuple(q[p]) for c, p in zip(names, plain) if q[p][0] < q[p][1]}
    model = FeatureModel(tuple(names), tuple(names), fill, bounds, {}, drop)
    clean = taken.select(*(model.cleaned(c).alias(p) for c, p in zip(names, plain)))
    varying = set(drop_constant_columns(clean, plain)) if rows else set()
    kept = [(c, p) for c, p in zip(names, plain) if p in varying]
    scale = fit_scale(clean, [p for _, p in kept], scaling, rows)
    return FeatureModel(tuple(names), tuple(c for c, _ in kept), fill, bounds, {c: scale[p] for c, p in kept if p in scale}, drop)
