"""Histogram-based outlier scores: each feature's equal-width histogram, scores added over features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farstray.functions import columns as C
from farstray.operators.scoring import PLACES

BINS, ALPHA, TOLERANCE = 10, 0.1, 0.5


@dataclass(frozen=True)
class Histogram:
    low: float
    width: float
    density: tuple[float, ...]

    def score(self, x: Column) -> Column:
        """-log2(density + alpha); beyond the edges by over half a bin's width the lowest density counts."""
        place = (x - F.lit(self.low)) / F.lit(self.width)
        bin_ = F.greatest(F.lit(0), F.least(F.floor(place), F.lit(len(self.density) - 1))).cast("int")
        density = F.element_at(F.array(*map(F.lit, self.density)), bin_ + 1)
        outside = (place < -TOLERANCE) | (place > len(self.density) + TOLERANCE)
        return -F.log2(F.when(outside, F.lit(min(self.density))).otherwise(density) + F.lit(ALPHA))


@dataclass(frozen=True)
class HbosModel:
    histograms: tuple[Histogram, ...]

    def parts(self, names: list[str]) -> list[Column]:
        return [h.score(F.col(f"`{c}`")) for c, h in zip(names, self.histograms)]

    def raw(self, names: list[str], key: Column | None = None) -> Column:
        return F.round(C.total(self.parts(names)), PLACES)


def fit_hbos(sample: DataFrame, names: list[str], bins: int = BINS) -> HbosModel:
    """Two passes: bounds of every feature, then counts of every bin; features x bins rows come to the driver."""
    r = sample.agg(F.count("*").alias("n"), *(f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("low", F.min), ("high", F.max)))).first()
    n = r["n"]
    edges = [(r[f"low{i}"], ((r[f"high{i}"] - r[f"low{i}"]) / bins) or 1.0) for i in range(len(names))]
    cells = [F.struct(F.lit(i).alias("i"), F.least(F.floor((F.col(f"`{c}`") - low) / width), F.lit(bins - 1)).cast("int").alias("bin")) for i, (c, (low, width)) in enumerate(zip(names, edges))]
    counts = {(x["i"], x["bin"]): x["n"] for x in sample.select(F.explode(F.array(*cells)).alias("s")).groupBy("s.i", "s.bin").agg(F.count("*").alias("n")).collect()}
    return HbosModel(tuple(Histogram(low, width, tuple(counts.get((i, b), 0) / (n * width) for b in range(bins))) for i, (low, width) in enumerate(edges)))
