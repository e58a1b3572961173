"""Features of tables with array columns: one array a row, and one grouped aggregate for all its places, however many there are.

The chain is that of ``features`` (impute, sanitise, clip, leave out what doesn't vary, scale), place by place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farstray.functions import columns as C
from farstray.functions.quantiles import DIRECT_ROWS, exact_quantiles
from farstray.operators.features import HIGH_NULL, LEAST_CLIP_ROWS, LEAST_VARIANCE

QUARTILES = [0.25, 0.5, 0.75]


def vector_columns(df: DataFrame, exclude=()) -> list[str]:
    """Columns that are arrays of numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, C.NUMERIC) and f.name not in set(exclude)]


def vector_widths(df: DataFrame, names: list[str]) -> dict[str, int]:
    """The length of each column's longest array."""
    r = df.agg(*(F.max(F.size(F.col(f"`{c}`"))).alias(f"w{i}") for i, c in enumerate(names))).first() if names else []
    return {c: max(r[i] or 0, 0) for i, c in enumerate(names)}


def _constant(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _of_length(array: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(array, i).cast("double"))


@dataclass(frozen=True)
class VectorFeatures:
    """Fitted statistics by place.  ``transform`` adds one array column, ``f_vector``, of the places that vary."""

    columns: tuple[str, ...]
    widths: tuple[int, ...]  # 0 for a plain number
    fill: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    center: tuple[float, ...]
    divisor: tuple[float, ...]
    places: tuple[int, ...]

    @property
    def kept(self) -> tuple[str, ...]:
        return ("vector",) if self.places else ()

    def assembled(self) -> Column:
        """All numbers of a row in one array; missing ones, and those of short arrays, are null, and numbers beyond the fitted length are left out."""
        parts = []
        for c, w in zip(self.columns, self.widths):
            parts.append(_of_length(F.col(f"`{c}`"), w) if w else F.array(F.col(f"`{c}`").cast("double")))
        return F.concat(*parts)

    def cleaned(self, vector: Column) -> Column:
        def clean(x: Column, i: Column) -> Column:
            x = C.sanitized(F.coalesce(x, F.get(_constant(self.fill), i)))
            return F.greatest(F.least(x, F.get(_constant(self.high), i)), F.get(_constant(self.low), i)) if self.low else x

        return F.transform(vector, clean)

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.places:
            return df
        cleaned = df.withColumn("f_vector", self.cleaned(self.assembled()))
        center, divisor = _constant(self.center), _constant(self.divisor)
        scaled = F.transform(_constant(self.places), lambda p: C.sanitized((F.get("f_vector", p) - F.get(center, p)) / F.get(divisor, p)))
        return cleaned.withColumn("f_vector", scaled)

    def complete(self) -> Column:
        return F.lit(True)


def _by_place(vectors: DataFrame, width: int, rows: int, probabilities: list[float]) -> list[dict]:
    """Statistics of each place of the arrays ``v``: one aggregate; quantiles of very many rows by refinement."""
    direct = rows <= DIRECT_ROWS
    stats = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.var_pop("x").alias("var"), F.min("x").alias("min"), F.max("x").alias("max"), F.max(F.isnan("x") | (F.abs("x") == float("inf"))).alias("odd")]
    if direct:
        stats.append(F.percentile("x", F.array(*map(F.lit, probabilities))).alias("q"))
    found = {r["p"]: r.asDict() for r in vectors.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(*stats).collect()}  # a row for each place
    nothing = dict.fromkeys(("mean", "std", "var", "min", "max", "odd", "q")) | {"n": 0}
    out = [found.get(i, nothing) for i in range(width)]
    if not direct:
        plain = [f"x{i}" for i in range(width) if not out[i]["odd"]]
        q = exact_quantiles(vectors.select(*(F.get("v", F.lit(int(c[1:]))).alias(c) for c in plain)), plain, probabilities, rows)
        for c in plain:
            out[int(c[1:])]["q"] = q[c]
    return out


def fit_vectors(df: DataFrame, names: list[str], scaling: str = "robust", strategy: str = "median", clip: bool = True) -> VectorFeatures:
    """Fit on all rows of ``df``; ``names`` are arrays of numbers or numbers.  Nulls are always imputed, as no row has all places."""
    widths = vector_widths(df, [c for c in names if c in vector_columns(df)])
    names = [c for c in names if widths.get(c, 1)]
    model = VectorFeatures(tuple(names), tuple(widths.get(c, 0) for c in names), (), (), (), (), (), ())
    width = sum(w or 1 for w in model.widths)
    if not names:
        return model
    raw = df.select(model.assembled().alias("v"))
    rows = raw.count()
    first = _by_place(raw, width, rows, [0.5])

    def filled(s: dict) -> float:
        value = None if strategy == "zero" or s["odd"] else s["mean"] if strategy == "mean" else (s["q"] or [None])[0]
        return float(value) if value is not None and rows - s["n"] <= HIGH_NULL * rows else 0.0

    model = VectorFeatures(model.columns, model.widths, tuple(map(filled, first)), (), (), (), (), ())
    if clip and rows >= LEAST_CLIP_ROWS:
        ends = [s["q"] for s in _by_place(raw.select(model.cleaned(F.col("v")).alias("v")), width, rows, [0.01, 0.99])]
        low, high = zip(*((a, b) if a < b else (float("-inf"), float("inf")) for a, b in ends))
        model = VectorFeatures(model.columns, model.widths, model.fill, low, high, (), (), ())
    last = _by_place(raw.select(model.cleaned(F.col("v")).alias("v")), width, rows, QUARTILES)
    pairs = []
    for s in last:
        if rows < 2 or scaling == "none" or not s["n"]:
            a, b = 0.0, 1.0
        elif scaling == "robust":
            a, b = s["q"][1], s["q"][2] - s["q"][0]
        elif scaling == "standard":
            a, b = s["mean"], s["std"]
        elif scaling == "minmax":
            a, b = s["min"], s["max"] - s["min"]
        else:
            raise ValueError(f"unknown scaling {scaling!r}")
        pairs.append((float(a), float(b) or 1.0))
    center, divisor = zip(*pairs)
    return VectorFeatures(model.columns, model.widths, model.fill, model.low, model.high, center, divisor, tuple(i for i, s in enumerate(last) if (s["var"] or 0.0) > LEAST_VARIANCE))
