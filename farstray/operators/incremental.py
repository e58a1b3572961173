"""Out-of-core one-class model: Nyström features of standardised columns and hashed categories, fitted by gradient passes.

Columns are clipped to their 1st and 99th percentile.  Each pass takes the margin that leaves the share ``nu`` of the rows
outside, an exact quantile, and adds the hinge gradient over all rows: tasks return one row of sums.  ``step`` does the
same with one micro-batch of a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farstray.functions import columns as C
from farstray.functions.quantiles import exact_quantiles
from farstray.functions.sampling import uniform_sample
from farstray.operators.ocsvm import kernel
from farstray.operators.scoring import PLACES

LANDMARKS, HASHED = 100, 20


def hashed_categories(names: list[str], size: int = HASHED) -> list[Column]:
    """How many of a row's ``column=value`` texts fall into each of ``size`` cells."""
    cells = [F.pmod(F.xxhash64(F.concat_ws("=", F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit("")))), F.lit(size)) for c in names]
    return [C.total([F.when(cell == i, 1.0).otherwise(0.0) for cell in cells]) for i in range(size)] if names else []


@dataclass(frozen=True)
class IncrementalModel:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    scale: tuple[tuple[float, float], ...]
    clips: tuple[tuple[float, float], ...]
    landmarks: np.ndarray
    whiten: np.ndarray
    gamma: float
    weights: np.ndarray
    offset: float
    nu: float
    steps: int = 0

    def state(self) -> dict:
        """All of it as plain numbers and texts, for JSON."""
        return {f.name: v.tolist() if isinstance(v := getattr(self, f.name), np.ndarray) else v for f in fields(self)}

    @classmethod
    def of(cls, state: dict) -> IncrementalModel:
        pairs = {c: tuple(map(tuple, state[c])) for c in ("scale", "clips")}
        names = {c: tuple(state[c]) for c in ("numeric", "categorical")}
        arrays = {c: np.array(state[c], dtype=float) for c in ("landmarks", "whiten", "weights")}
        return cls(**(state | pairs | names | arrays))

    def inputs(self) -> list[Column]:
        plain = []
        for c, (m, s), (low, high) in zip(self.numeric, self.scale, self.clips):
            x = C.sanitized(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)))
            plain.append((F.least(F.greatest(x, F.lit(low)), F.lit(high)) - F.lit(m)) / F.lit(s))
        return [c.alias(f"x{i}") for i, c in enumerate(plain + hashed_categories(list(self.categorical)))]

    def features(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.landmarks, self.gamma) @ self.whiten

    def pull(self, df: DataFrame) -> tuple[np.ndarray, int]:
        """The sum of the features of all rows outside the margin, and how many rows there are."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            model = shared.value
            g, n = np.zeros(len(model.weights)), 0
            for pdf in batches:
                z = model.features(pdf.to_numpy(dtype=float))
                g += z[z @ model.weights < model.offset].sum(axis=0)
                n += len(z)
            yield pd.DataFrame({"i": range(len(g)), "g": g, "n": n})

        sums = df.select(*self.inputs()).mapInPandas(run, "i int, g double, n long").groupBy("i").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
        rows = sums.orderBy("i").collect()  # a row for each landmark
        shared.destroy()
        return np.array([r["g"] for r in rows]), rows[0]["n"] if rows else 0

    def settled(self, df: DataFrame) -> IncrementalModel:
        """With the margin that leaves the share ``nu`` of the rows of ``df`` outside."""
        inner = df.select((-replace(self, offset=0.0).raw()).alias("inner")).persist()
        [offset] = exact_quantiles(inner, ["inner"], [self.nu])["inner"]
        inner.unpersist()
        return replace(self, offset=self.offset if offset is None else offset)

    def step(self, df: DataFrame) -> IncrementalModel:
        """One gradient step on the rows of ``df``: towards the rows that are outside, as each of them pulls."""
        return self.settled(df).moved(df)

    def moved(self, df: DataFrame) -> IncrementalModel:
        """The step of a model whose margin is that of the rows of ``df``."""
        outside, n = self.pull(df)
        if not n:
            return self
        rate = 1.0 / (self.steps + 2)
        weights = (1 - rate) * self.weights + rate * outside / (self.nu * n)
        return replace(self, weights=weights, steps=self.steps + 1).settled(df)

    def raw(self, names: list[str] | None = None, key: Column | None = None) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(columns: pd.DataFrame) -> pd.Series:
            return pd.Series(model.offset - model.features(columns.to_numpy(dtype=float)) @ model.weights)

        return F.round(score(F.struct(*self.inputs())), PLACES)


def begin(df: DataFrame, contamination: float, numeric: list[str], categorical: list[str], keys: list[str] | None = None) -> IncrementalModel | None:
    """Column statistics over all rows and landmarks from a bounded sample; None if there is nothing to fit."""
    if not numeric and not categorical:
        return None
    stats = df.agg(F.count("*").alias("n"), *(f(C.sanitized(F.col(f"`{c}`").cast("double"))).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if stats["n"] < 2:
        return None
    scale = tuple((stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 1.0) for i in range(len(numeric)))
    clean = df.select(*(C.sanitized(F.col(f"`{c}`").cast("double")).alias(c) for c in numeric))
    ends = exact_quantiles(clean, numeric, [0.01, 0.99], stats["n"])
    clips = tuple((m, m) if ends[c][0] is None else tuple(ends[c]) for c, (m, _) in zip(numeric, scale))
    empty = np.zeros((0, 0))
    model = IncrementalModel(tuple(numeric), tuple(categorical), scale, clips, empty, empty, 1.0, np.zeros(0), 0.0, contamination)
    points = uniform_sample(df, LANDMARKS, keys).select(*model.inputs()).toPandas().to_numpy(dtype=float)
    points = np.unique(points, axis=0)
    gamma = 1 / points.shape[1]
    values, vectors = np.linalg.eigh(kernel(points, points, gamma))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T
    model = replace(model, landmarks=points, whiten=whiten, gamma=gamma)
    return replace(model, weights=model.features(points).mean(axis=0))


def fit_incremental(df: DataFrame, contamination: float, numeric: list[str], categorical: list[str], passes: int = 3, keys: list[str] | None = None) -> IncrementalModel | None:
    model = begin(df, contamination, numeric, categorical, keys)
    if model is None or not passes:
        return model
    model = model.settled(df)
    for _ in range(passes):
        model = model.moved(df)  # which settles the margin for the next
    return model
