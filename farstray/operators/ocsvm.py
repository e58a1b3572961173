"""One-class support vector machine with an RBF kernel: a cascade of solves in tasks over a bounded sample."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farstray.functions.checkpoints import checkpointed
from farstray.operators.scoring import PLACES

#: Rows of a shard; how many shards are put together at a time; rows that join the last set at a time.
SHARD, MERGED, JOINED = 2000, 4, 500
#: Of the gap between the gradients of two rows, in shares of the whole weight.
TOLERANCE = 1e-5
CACHE_BYTES = 64 << 20


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


class Kernel:
    """Columns of the kernel matrix of ``x``, made when asked for; about ``CACHE_BYTES`` of the latest are kept."""

    def __init__(self, x: np.ndarray, gamma: float):
        self.x, self.gamma, self.held, self.most = x, gamma, OrderedDict(), max(2, CACHE_BYTES // max(8 * len(x), 1))

    def column(self, i: int) -> np.ndarray:
        if i not in self.held:
            if len(self.held) >= self.most:
                self.held.popitem(last=False)
            self.held[i] = kernel(self.x, self.x[i : i + 1], self.gamma)[:, 0]
        self.held.move_to_end(i)
        return self.held[i]

    def times(self, alpha: np.ndarray) -> np.ndarray:
        """The matrix times ``alpha``, in blocks of rows."""
        hold = alpha > 0
        return np.concatenate([kernel(self.x[i : i + 1000], self.x[hold], self.gamma) @ alpha[hold] for i in range(0, len(self.x), 1000)] or [np.zeros(0)])


def solve(x: np.ndarray, gamma: float, most: np.ndarray, alpha: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights between 0 and ``most`` with the sum of ``alpha`` that are optimal within ``tolerance``, and the offset.

    Steps move weight from one row to another: to the row with the smallest gradient, from the one that gains most by it.  ``alpha`` is where to begin.
    """
    k, total = Kernel(x, gamma), float(alpha.sum())
    alpha, gradient = alpha.astype(float).copy(), k.times(alpha)
    while True:
        up, down = alpha < most - 1e-12, alpha > 1e-12
        if not up.any() or not down.any():
            break
        i = int(np.argmin(np.where(up, gradient, np.inf)))
        gain = np.where(down, gradient - gradient[i], -np.inf)
        if gain.max() < tolerance * total:
            break
        mine = k.column(i)
        curve = np.maximum(2 - 2 * mine, 1e-12)
        j = int(np.argmax(np.where(gain > 0, gain**2 / curve, -np.inf)))
        step = min(gain[j] / curve[j], most[i] - alpha[i], alpha[j])
        alpha[i], alpha[j] = alpha[i] + step, alpha[j] - step
        gradient += step * (mine - k.column(j))
    return alpha, offset_of(alpha, most, gradient)


def offset_of(alpha: np.ndarray, most: np.ndarray, gradient: np.ndarray) -> float:
    free = (alpha > 1e-9) & (alpha < most - 1e-9)
    return float(gradient[free].mean() if free.any() else gradient[alpha > 1e-9].max())


@dataclass(frozen=True)
class OcsvmModel:
    state: object  # broadcast (support vectors, weights, offset, gamma)

    def raw(self, names: list[str], key: Column | None = None) -> Column:
        shared = self.state

        @F.pandas_udf("double")
        def score(columns: pd.DataFrame) -> pd.Series:
            support, weights, offset, gamma = shared.value
            x = columns.to_numpy(dtype=float)
            return pd.Series(offset - kernel(x, support, gamma) @ weights)

        return F.nanvl(F.round(score(F.struct(*(F.col(f"`{c}`") for c in names))), PLACES), F.lit(None).cast("double"))


ROWS = "x array<double>, most double, alpha double, offset double, shard long"


def _solved(gamma: float):
    """For a group of rows x, most, alpha: those that hold weight after it has been solved with the same sum of weights."""

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf["x"].to_numpy())
        order = np.lexsort(x.T[::-1])  # the same steps whatever the order of rows
        x, most = x[order], pdf["most"].to_numpy()[order]
        alpha, offset = solve(x, gamma, most, pdf["alpha"].to_numpy()[order])
        hold = alpha > 1e-9
        return pd.DataFrame({"x": list(x[hold]), "most": most[hold], "alpha": alpha[hold], "offset": offset, "shard": key[0]})

    return run


def fit_ocsvm(sample: DataFrame, names: list[str], contamination: float, shard: int = SHARD) -> OcsvmModel:
    """A cascade: tasks solve shards of ``sample``, then the rows that hold weight of a few shards together, until one set is left.

    A check of all rows against that set follows; rows that it leaves out wrongly join it and it is solved again, until there are none, so the result
    is optimal over all rows.  No task holds a matrix of all rows; what holds weight is about the share ``contamination`` of them.  Equal rows
    are one, that may hold as much weight as they are many.
    """
    spark = sample.sparkSession
    plain = sample.select(F.array(*(F.col(f"`{c}`").cast("double") for c in names)).alias("x")).where(~F.exists("x", F.isnull))
    plain = checkpointed(plain.groupBy("x").agg(F.count("*").cast("double").alias("most")))
    n, different = plain.agg(F.sum("most"), F.count("*")).first()
    gamma, nu = 1 / len(names), min(max(contamination, 1 / n), 1.0)
    shards = max(1, -(-different // shard))
    # equal shares of the weight begin everywhere, so the sum of a shard's weights is its share of the whole
    dealt = plain.select("x", "most", (F.col("most") * nu).alias("alpha"), F.pmod(F.xxhash64("x"), F.lit(shards)).alias("shard"))
    while True:
        solved = checkpointed(dealt.groupBy("shard").applyInPandas(_solved(gamma), ROWS))
        if shards == 1:
            break
        shards = -(-shards // MERGED)
        dealt = solved.select("x", "most", "alpha", F.pmod("shard", F.lit(shards)).alias("shard"))
    while True:
        found = solved.toPandas()  # what holds weight
        support, alpha, offset = np.vstack(found["x"].to_numpy()), found["alpha"].to_numpy(), float(found["offset"].iloc[0])
        shared = spark.sparkContext.broadcast((support, alpha, offset, gamma))
        left_out = _left_out(plain, shared, TOLERANCE * nu * n)
        if not left_out:
            break
        joined = solved.select("x", "most", "alpha").unionByName(spark.createDataFrame(left_out, "x array<double>, most double, alpha double"))
        solved = checkpointed(joined.withColumn("shard", F.lit(0).cast("long")).groupBy("shard").applyInPandas(_solved(gamma), ROWS))
        shared.destroy()
    whole = alpha.sum()
    return OcsvmModel(spark.sparkContext.broadcast((support, alpha / whole, offset / whole, gamma)))


def _left_out(plain: DataFrame, shared, slack: float) -> list[tuple]:
    """The rows farthest outside the margin that hold no weight, ``JOINED`` at most, with a weight of 0."""

    @F.pandas_udf("double")
    def outside(x: pd.Series) -> pd.Series:
        support, alpha, offset, gamma = shared.value
        rows = np.vstack(x.to_numpy())
        d = np.concatenate([offset - kernel(rows[i : i + 1000], support, gamma) @ alpha for i in range(0, len(rows), 1000)])
        known = {s.tobytes() for s in support}
        return pd.Series([0.0 if r.tobytes() in known else v for r, v in zip(rows, d)])

    far = plain.withColumn("outside", outside("x")).where(F.col("outside") > slack)
    return [(r["x"], r["most"], 0.0) for r in far.orderBy(F.desc("outside"), "x").limit(JOINED).collect()]
