"""Cluster-based local outlier factor: distance to the own large cluster, or from a small one to the nearest large one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farstray.functions import columns as C
from farstray.operators.scoring import PLACES

LARGE_SHARE, LARGE_RATIO, SEED = 0.9, 5.0, 42


@dataclass(frozen=True)
class CblofModel:
    centers: tuple[tuple[float, ...], ...]
    large: tuple[bool, ...]

    def raw(self, names: list[str], key: Column | None = None) -> Column:
        """Distances are expressions: there are at most eight centers."""
        x = [F.col(f"`{c}`") for c in names]
        to = [F.sqrt(C.total([(v - F.lit(m)) * (v - F.lit(m)) for v, m in zip(x, center)])) for center in self.centers]
        nearest = F.least(*to) if len(to) > 1 else to[0]
        large = [d for d, big in zip(to, self.large) if big]
        to_large = F.least(*large) if len(large) > 1 else large[0]
        return F.round(F.when(nearest == to_large, nearest).otherwise(to_large), PLACES)


def large_clusters(sizes: list[int], share: float = LARGE_SHARE, ratio: float = LARGE_RATIO) -> list[bool]:
    """Clusters up to the first place, by size, where they hold the share or the next is smaller by the ratio, are large."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    total, seen = sum(sizes), 0
    large = [False] * len(sizes)
    for place, i in enumerate(order):
        large[i] = True
        seen += sizes[i]
        following = sizes[order[place + 1]] if place + 1 < len(order) else 0
        if seen >= share * total or following == 0 or sizes[i] / following >= ratio:
            break
    return large


def fit_cblof(sample: DataFrame, names: list[str], rows: int, seed: int = SEED) -> CblofModel:
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features").transform(sample.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names))).dropna())
    model = KMeans(k=min(8, max(2, rows // 50)), seed=seed).fit(vectors)
    return CblofModel(tuple(tuple(map(float, c)) for c in model.clusterCenters()), tuple(large_clusters(list(model.summary.clusterSizes))))
