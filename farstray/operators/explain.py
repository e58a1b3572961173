"""Why rows were flagged: the three features that say most, as rows."""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farstray.functions import columns as C
from farstray.functions.quantiles import exact_quantiles
from farstray.functions.sampling import uniform_sample
from farstray.operators.forest import ForestModel, average_path
from farstray.operators.hbos import HbosModel

TOP, BACKGROUND = 3, 100
SCHEMA = "row_index string, method string, top_features array<struct<feature:string,value:double,actual_value:double,median_value:double>>"


def _top(df: DataFrame, key: str, names: list[str], features: list[str], values, medians: dict, method: str) -> DataFrame:
    """The ``TOP`` features by size of value, ties to the later column."""
    entries = [F.struct((-F.abs(F.round(v, 4))).alias("order"), F.lit(-i).alias("place"), F.struct(F.lit(n).alias("feature"), (F.round(v, 4) + F.lit(0.0)).alias("value"), (F.round(F.col(f"`{f}`"), 4) + F.lit(0.0)).alias("actual_value"), F.lit(round(medians[f], 4) + 0.0).alias("median_value")).alias("e")) for i, (n, f, v) in enumerate(zip(names, features, values))]
    top = F.transform(F.slice(F.array_sort(F.array(*entries)), 1, TOP), lambda e: e["e"])
    return df.select(F.col(f"`{key}`").cast("string").alias("row_index"), F.lit(method).alias("method"), top.alias("top_features"))


def _medians(background: DataFrame, features: list[str]) -> dict[str, float]:
    return {f: (q[0] if q[0] is not None else 0.0) for f, q in exact_quantiles(background, features, [0.5]).items()}


def explain_zscore(flagged: DataFrame, everything: DataFrame, key: str, names: list[str], features: list[str], rows: int = 100) -> DataFrame:
    """Distance from the median in standard deviations; these are not Shapley values and aren't called so."""
    medians = _medians(everything, features)
    r = everything.agg(*(F.stddev_pop(F.col(f"`{f}`")).alias(f"s{i}") for i, f in enumerate(features))).first()
    values = [F.abs(F.col(f"`{f}`") - F.lit(medians[f])) / F.lit(r[i] or 1.0) for i, f in enumerate(features)]
    return _top(flagged.orderBy(key).limit(rows), key, names, features, values, medians, "zscore_fallback")


def explain_hbos(flagged: DataFrame, everything: DataFrame, model: HbosModel, key: str, names: list[str], features: list[str], rows: int = 100) -> DataFrame:
    """Exact Shapley values: the score is a sum over features, so each one's share is its part less the mean part."""
    parts = model.parts(features)
    r = everything.agg(*(F.avg(p).alias(f"p{i}") for i, p in enumerate(parts))).first()
    values = [p - F.lit(r[i]) for i, p in enumerate(parts)]
    return _top(flagged.orderBy(key).limit(rows), key, names, features, values, _medians(everything, features), "shap")


def background_of(everything: DataFrame, features: list[str], keys: list[str] | None) -> np.ndarray:
    """The rows that stand for absent features: a bounded uniform sample, every one of which is averaged over."""
    return uniform_sample(everything, BACKGROUND, keys).select(*(F.col(f"`{f}`").cast("double") for f in features)).toPandas().to_numpy(dtype=float)


# --- isolation forest -------------------------------------------------------------------------------------------------


def leaf_boxes(tree, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, depth) of each leaf of a flat tree: it holds the points with low <= x < high in every column."""
    feature, cut, left, right, depth = tree
    low, high, found = np.full((len(feature), d), -np.inf), np.full((len(feature), d), np.inf), []
    for node in range(len(feature)):  # children come after their parent
        if feature[node] < 0:
            found.append(node)
            continue
        for child in (left[node], right[node]):
            low[child], high[child] = low[node], high[node]
        f = feature[node]
        high[left[node], f] = min(high[node, f], cut[node])
        low[right[node], f] = max(low[node, f], cut[node])
    return low[found], high[found], depth[found]


def path_weights(d: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``a`` columns that only the row and ``b`` that only the background row brings into a leaf: the share of orders of all columns in
    which one of the first comes last of them before any of the second, and the like for the second."""
    size = d + 1
    mine, theirs = np.zeros((size, size)), np.zeros((size, size))
    for a in range(size):
        for b in range(size - a):
            if a:
                mine[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                theirs[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b)
    return mine, theirs


def tree_shapley(trees, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Exact Shapley values of the mean depth of each row of ``x``, absent columns taken from each background row in turn.

    A leaf counts for a set of columns if the row brings those and the background row the others into it.  So only the numbers of columns that one of
    the two alone brings matter, and the work is rows x background rows x leaves x columns instead of all sets of columns.
    """
    d = x.shape[1]
    mine, theirs = path_weights(d)
    out = np.zeros(x.shape)
    for tree in trees:
        low, high, depth = leaf_boxes(tree, d)
        held = (background[:, None] >= low) & (background[:, None] < high)  # background row, leaf, column
        for i, row in enumerate(x):
            own = (row >= low) & (row < high)
            able = (own | held).all(axis=2)
            only, other = (own & ~held) & able[..., None], (~own & held) & able[..., None]
            a, b = only.sum(axis=2), other.sum(axis=2)
            out[i] += np.einsum("nld,nl->d", only, mine[a, b] * depth) - np.einsum("nld,nl->d", other, theirs[a, b] * depth)
    return out / len(trees) / len(background)


def explain_forest(flagged: DataFrame, everything: DataFrame, model: ForestModel, key: str, names: list[str], features: list[str], rows: int = 100, keys: list[str] | None = None) -> DataFrame:
    """Exact Shapley values of log2 of the raw score, which is the mean depth over trees but for a constant factor.

    They add up to log2 of the row's score less its mean over the background.
    """
    spark = flagged.sparkSession
    shared, scale = spark.sparkContext.broadcast(background_of(everything, features, keys)), -1 / max(average_path(model.subsample), 1e-12)
    chosen, trees = flagged.orderBy(key).limit(rows), model.trees
    values = _shares(chosen, key, features, lambda x: scale * tree_shapley(trees.value, x, shared.value))
    return _top(values, key, names, features, [F.col(f"s{i}") for i in range(len(features))], _medians(everything, features), "shap")


def _shares(chosen: DataFrame, key: str, features: list[str], share) -> DataFrame:
    """``chosen`` with s0, s1, ...: what ``share`` makes of the matrix of its features, a few rows a task."""
    kind = chosen.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame(np.column_stack([pdf["key"].to_numpy(dtype=object), share(pdf.drop(columns="key").to_numpy(dtype=float))]), columns=["key", *(f"s{i}" for i in range(len(features)))]).infer_objects()

    inputs = chosen.select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{f}`").cast("double") for f in features)).repartition(chosen.sparkSession.sparkContext.defaultParallelism)
    found = inputs.mapInPandas(run, f"key {kind}, " + ", ".join(f"s{i} double" for i in range(len(features))))
    return chosen.join(found, chosen[key] == found["key"]).drop(found["key"])


# --- any model --------------------------------------------------------------------------------------------------------


def coalitions(d: int, most: int, seed: int = 42) -> list[tuple[tuple[int, ...], float]]:
    """Sets of columns, neither none nor all, with their weights: every one if ``most`` allows, else whole sizes from the heaviest, and a
    drawn share of the others, each with its complement, that carries their whole weight."""
    weight = [0.0] + [(d - 1) / (s * (d - s)) for s in range(1, d)]  # of all sets of a size together
    out: list[tuple[tuple[int, ...], float]] = []
    sizes = sorted(range(1, d), key=lambda s: (min(s, d - s), s))
    while sizes:
        pair = [s for s in sizes if min(s, d - s) == min(sizes[0], d - sizes[0])]
        if len(out) + sum(comb(d, s) for s in pair) > most:
            break
        out += [(z, weight[s] / comb(d, s)) for s in pair for z in combinations(range(d), s)]
        sizes = [s for s in sizes if s not in pair]
    if sizes:
        rng, drawn = np.random.default_rng(seed), Counter()
        p = np.array([weight[s] for s in sizes])
        for _ in range(max(1, (most - len(out)) // 2)):
            s = int(rng.choice(sizes, p=p / p.sum()))
            z = tuple(sorted(int(i) for i in rng.choice(d, size=s, replace=False)))
            drawn[z] += 1
            drawn[tuple(i for i in range(d) if i not in z)] += 1
        out += [(z, p.sum() * n / drawn.total()) for z, n in sorted(drawn.items())]
    return out


def explain_kernel(flagged: DataFrame, everything: DataFrame, model, key: str, names: list[str], features: list[str], rows: int = 100, keys: list[str] | None = None, most: int = 256) -> DataFrame:
    """Shapley values of any model's raw score by weighted least squares over sets of columns (exact where all sets take part).

    Every set of columns of every explained row is scored with every background row, at most ``rows`` x ``most`` x ``BACKGROUND`` rows, and the
    right sides of the normal equations are sums over them; their left side is the same for all rows.
    """
    spark, d = flagged.sparkSession, len(features)
    background = background_of(everything, features, keys)
    plan = coalitions(d, most)
    present = np.zeros((len(plan), d))
    for i, (z, _) in enumerate(plan):
        present[i, list(z)] = 1
    weights = np.array([w for _, w in plan])
    # from the right sides to the values: the solution with a given sum
    inverse = np.linalg.pinv((present * weights[:, None]).T @ present) if plan else np.zeros((d, d))
    along = inverse.sum(axis=1) / inverse.sum() if plan else np.ones(d) / d
    solve = inverse - np.outer(along, inverse.sum(axis=0))

    sets = [(list(map(int, z)), float(w)) for z, w in plan] + [(list(range(d)), 0.0)]  # the last is the row itself
    tasks = spark.sparkContext.defaultParallelism
    drawn = spark.createDataFrame([(s, b, z, w, background[b].tolist()) for s, (z, w) in enumerate(sets) for b in range(len(background) if s < len(plan) else 1)], "s int, b int, present array<int>, w double, base array<double>").repartition(tasks)
    chosen = flagged.orderBy(key).limit(rows)
    light = chosen.select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)))
    mixed = drawn.crossJoin(F.broadcast(light))  # at most ``rows`` rows
    mixed = mixed.select("key", "s", "w", "present", *(F.when(F.array_contains("present", i), F.col(f"x{i}")).otherwise(F.get("base", F.lit(i))).alias(f"m{i}") for i in range(d)))
    scored = mixed.select("key", "s", "w", "present", model.raw([f"m{i}" for i in range(d)], F.lit(None)).alias("raw"))
    base = spark.createDataFrame([tuple(r) for r in background.tolist()], ", ".join(f"m{i} double" for i in range(d))).select(model.raw([f"m{i}" for i in range(d)], F.lit(None)).alias("raw")).agg(F.avg("raw")).first()[0]
    sides = [F.sum(F.when(F.array_contains("present", i), F.col("w") * (F.col("raw") - F.lit(base)))) / len(background) for i in range(d)]
    found = scored.groupBy("key").agg(*(F.coalesce(v, F.lit(0.0)).alias(f"b{i}") for i, v in enumerate(sides)), F.max(F.when(F.col("s") == len(plan), F.col("raw") - F.lit(base))).alias("whole"))
    values = found.select("key", *(C.total([F.col(f"b{j}") * float(solve[i, j]) for j in range(d)] + [F.col("whole") * float(along[i])]).alias(f"s{i}") for i in range(d)))
    joined = chosen.join(values, chosen[key] == values["key"]).drop(values["key"])
    return _top(joined, key, names, features, [F.col(f"s{i}") for i in range(d)], _medians(everything, features), "shap")
