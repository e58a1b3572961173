"""Local outlier factor: a model of a bounded reference sample (all rows, where they fit in it), and exact scores of all rows.

Neighbours are found by boxes (``neighbours``), so that most rows are compared with few others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farstray.functions.checkpoints import checkpointed
from farstray.operators.neighbours import BLOCK, Boxes, exact_neighbours
from farstray.operators.scoring import PLACES

NEIGHBOURS = 20
TINY = 1e-10
#: So many places with a score for most of their rows may be broadcast.
FEW = 100_000


def by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Means of the values of each of ``n`` rows."""
    return np.bincount(row, weights=values, minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)


def ordered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different names, and the number of each name among them."""
    return np.unique(names.astype(object), return_inverse=True)


@dataclass(frozen=True)
class LofModel:
    state: object  # broadcast (sorted keys, boxes of the reference rows, k-distances, densities, k)

    def raw(self, names: list[str], key: Column | None = None) -> Column:
        shared = self.state

        @F.pandas_udf("double")
        def score(own: pd.Series, columns: pd.DataFrame) -> pd.Series:
            known, boxes, far, density, k = shared.value
            x = columns.to_numpy(dtype=float)
            out, good = np.full(len(x), np.nan), ~np.isnan(x).any(axis=1)
            if good.any():
                keys = own.to_numpy()[good].astype(object)
                named = np.array([k is not None for k in keys])
                codes = np.full(len(keys), -1)  # a row that isn't among the reference leaves none out
                if named.any():
                    at = np.minimum(np.searchsorted(known, keys[named]), len(known) - 1)
                    codes[named] = np.where(known[at] == keys[named], at, -1)
                row, place, d = boxes.nearest(x[good], k, own=codes)
                n = int(good.sum())
                mine = 1 / (by_row(np.maximum(d, far[place]), row, n) + TINY)
                out[good] = by_row(density[place], row, n) / mine
            return pd.Series(out)

        own = F.lit(None).cast("string") if key is None else key.cast("string")
        return F.nanvl(F.round(score(own, F.struct(*(F.col(f"`{c}`") for c in names))), PLACES), F.lit(None).cast("double"))


    def own(self, key: Column) -> Column:
        """The key of a row of the reference, null of any other: all that a score depends on beside the features."""
        shared = self.state

        @F.pandas_udf("string")
        def known(key: pd.Series) -> pd.Series:
            return key.where(key.isin(shared.value[0]), None)

        return known(key.cast("string"))


def wanted(neighbours: int, n: int) -> int:
    """How many neighbours ``n`` rows can have."""
    return min(neighbours, max(1, n - 1))


def fit_lof(sample: DataFrame, names: list[str], key: Column, neighbours: int = NEIGHBOURS) -> LofModel:
    """``sample`` is bounded; its neighbours are found in tasks against its broadcast."""
    spark = sample.sparkSession
    plain = sample.select(key.cast("string").alias("key"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names))).dropna()
    rows = plain.toPandas().sort_values("key", kind="stable")
    known, codes = ordered(rows["key"].to_numpy())
    reference = rows.drop(columns="key").to_numpy(dtype=float)
    n, k = len(rows), wanted(neighbours, len(rows))
    boxes = Boxes(reference, codes)
    shared = spark.sparkContext.broadcast((boxes, reference, codes, k))

    def find(batches):
        boxes, reference, codes, k = shared.value
        for pdf in batches:
            ids = boxes.place[pdf["id"].to_numpy()]  # leaf by leaf: rows that are looked up together lie close together
            row, place, d = boxes.nearest(reference[ids], k, own=codes[ids])
            yield pd.DataFrame({"id": ids[row], "at": place, "d": d})

    found = spark.range(n, numPartitions=max(1, min(64, n // 256))).mapInPandas(find, "id long, at long, d double").toPandas()  # k rows a reference row
    row, at, d = found["id"].to_numpy(), found["at"].to_numpy(), found["d"].to_numpy()
    far = np.zeros(n)
    np.maximum.at(far, row, d)
    density = 1 / (by_row(np.maximum(d, far[at]), row, n) + TINY)
    return LofModel(spark.sparkContext.broadcast((known, boxes, far, density, k)))


def _mean(column) -> Column:
    """Of a group, added up in order of size, so that equal groups have equal means."""
    values = F.array_sort(F.collect_list(column))
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values)


def exact_lof(df: DataFrame, names: list[str], key: str, neighbours: int = NEIGHBOURS, block: int | None = None) -> DataFrame:
    """``key`` and lof of every row without nulls, among all of them; keys are distinct.

    Of the rows at one place only the first k + 1 keys can be anyone's neighbours, and all others have the same score: the next
    one stands for them.
    """
    points = df.select(F.col(f"`{key}`").alias("i"), F.col(f"`{key}`").cast("string").alias("name"), F.array(*(F.col(f"`{c}`").cast("double") for c in names)).alias("x")).where(~F.exists("x", F.isnull))
    k = wanted(neighbours, points.count())
    at = F.row_number().over(Window.partitionBy("x").orderBy("name"))
    few = checkpointed(points.select("name", "x", at.alias("at")).where(F.col("at") <= k + 2))
    near = exact_neighbours(few.select("name", "x"), k, len(names), block or BLOCK)
    # a row's k-distance is its last neighbour's
    best = checkpointed(near.where(F.size("near") > 0).select("name", "near", F.element_at("near", -1)["d"].alias("far")))
    links = best.select("name", F.explode("near").alias("e")).select("name", F.col("e.j").alias("j"), F.col("e.d").alias("d"))
    reach = links.join(best.select(F.col("name").alias("j"), "far"), "j").groupBy("name").agg((1 / (_mean(F.greatest("d", "far")) + TINY)).alias("density"))
    reach = checkpointed(reach)
    around = links.join(reach.select(F.col("name").alias("j"), F.col("density").alias("theirs")), "j").groupBy("name").agg(_mean(F.col("theirs")).alias("theirs"))
    scored = checkpointed(around.join(reach, "name").select("name", F.round(F.col("theirs") / F.col("density"), PLACES).alias("lof")))
    shared = checkpointed(few.where(F.col("at") == k + 2).join(scored, "name").select("x", F.col("lof").alias("shared")))
    n = shared.count()
    if not n:
        return points.join(scored, "name").select(F.col("i").alias(key), "lof")
    found = points.join(scored, "name", "left").join(F.broadcast(shared) if n <= FEW else shared, "x", "left")
    return found.select(F.col("i").alias(key), F.coalesce("lof", "shared").alias("lof")).where("lof IS NOT NULL")
