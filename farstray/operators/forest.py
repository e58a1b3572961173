"""Isolation forest: trees grown in parallel tasks on bounded subsamples, scored in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farstray.operators.scoring import PLACES, collected, matrix

TREES, SUBSAMPLE, SEED = 100, 256, 42


def average_path(n: float) -> float:
    """The mean depth of an unsuccessful search in a binary tree of ``n`` leaves."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(data: np.ndarray, rng: np.random.Generator, limit: int):
    """Flat arrays of a tree: feature (-1 at leaves), cut, left child, right child, depth at leaves."""
    feature, cut, left, right, depth = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        for a in (feature, cut, left, right, depth):
            a.append(-1)
        low, high = data[rows].min(axis=0), data[rows].max(axis=0)
        open_ = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or not len(open_):
            depth[me] = level + average_path(len(rows))
            return me
        f = int(open_[rng.integers(len(open_))])
        c = rng.uniform(low[f], high[f])
        below = data[rows, f] < c
        if not below.any():
            below = data[rows, f] <= low[f]
        feature[me], cut[me] = f, c
        left[me] = node(rows[below], level + 1)
        right[me] = node(rows[~below], level + 1)
        return me

    node(np.arange(len(data)), 0)
    return feature, cut, left, right, depth


@dataclass(frozen=True)
class ForestModel:
    trees: object  # a broadcast list of flat trees
    subsample: int

    def raw(self, names: list[str], key: Column | None = None) -> Column:
        shared, size = self.trees, self.subsample

        @F.pandas_udf("double")
        def score(columns: pd.DataFrame) -> pd.Series:
            x = matrix(columns)
            depth = np.zeros(len(x))
            for feature, cut, left, right, leaf in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                live = np.arange(len(x))
                while len(live):
                    f = feature[at[live]]
                    live, f = live[f >= 0], f[f >= 0]
                    go = x[live, f] < cut[at[live]]
                    at[live] = np.where(go, left[at[live]], right[at[live]])
                depth += leaf[at]
            raw = 2.0 ** (-depth / len(shared.value) / max(average_path(size), 1e-12))
            return pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, raw))

        return F.nanvl(F.round(score(F.struct(*(F.col(f"`{c}`") for c in names))), PLACES), F.lit(None).cast("double"))


def fit_forest(sample: DataFrame, names: list[str], trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> ForestModel:
    """``sample`` is bounded; it is broadcast, and each task grows its trees from the rows that the tree's seed draws."""
    spark = sample.sparkSession
    rows = collected(sample, names)
    rows = rows[np.lexsort(rows.T[::-1])]  # the same forest whatever the order of rows
    size = min(subsample, len(rows))
    shared = spark.sparkContext.broadcast(rows)

    def build(batches):
        for pdf in batches:
            out = []
            for t in pdf["id"]:
                rng = np.random.default_rng([seed, int(t)])
                rows = rng.choice(len(shared.value), size=size, replace=False)
                out.append([int(t), *grow(shared.value[rows], rng, max(1, math.ceil(math.log2(max(size, 2)))))])
            yield pd.DataFrame(out, columns=["id", "feature", "cut", "left", "right", "depth"])

    schema = "id long, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"
    built = spark.range(trees, numPartitions=min(trees, 16)).mapInPandas(build, schema).orderBy("id").collect()
    flat = [tuple(np.array(r[c]) for c in ("feature", "cut", "left", "right", "depth")) for r in built]
    return ForestModel(spark.sparkContext.broadcast(flat), size)
