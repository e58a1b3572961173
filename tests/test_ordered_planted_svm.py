"""Orders without one task, areas under curves, planted outliers and the cascade of support vector solves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farstray.config import Settings
from farstray.functions import ordered
from farstray.operators import ocsvm, planted
from farstray.operators.profile import profile
from farstray.plans import engine


@pytest.fixture
def apart(spark):
    """Small ranges are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_previous_rows_and_running_sums(spark, apart):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, rng.randrange(50)]), rng.choice([None, rng.randrange(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, at long, v long").repartition(5)
    assert ordered.in_ranges(df, ["at", "id"]).select(ordered.PART).distinct().count() > 2
    expected, before, total = {}, None, 0
    for i, _, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        expected[i] = (before, total)
        before, total = v, total + (v or 0)
    assert {r["id"]: r["previous_v"] for r in ordered.with_previous(df, ["at", "id"], ["v"]).collect()} == {i: e[0] for i, e in expected.items()}
    assert {r["id"]: r["before_v"] for r in ordered.with_running(df, ["at", "id"], ["v"]).collect()} == {i: e[1] for i, e in expected.items()}
    assert ordered.with_previous(df.limit(0), ["at"], ["v"]).count() == 0


def test_no_window_takes_the_whole_table(spark):
    """The only windows without a partition are over a row for each range."""
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    plan = ordered.first_differences(df, "v", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert len(windows) == 2 and sum("lag(last" in line for line in windows) == 1
    assert all("], [__range" in line for line in windows if "lag(last" not in line)


def test_consecutive_columns_need_their_order(spark, apart):
    rows = [(i, 500 - i, i // 2, None if i % 7 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long").repartition(4)
    assert ordered.is_consecutive(df, ["a", "b", "c", "d"], ["a"]) == {"a": True, "b": False, "c": False, "d": False}
    assert ordered.is_consecutive(df, ["a", "b"], ["b"]) == {"a": False, "b": True}
    assert ordered.is_consecutive(df.limit(1), ["a"], ["a"]) == {"a": False}
    assert profile(df).ids == ("a", "b") and profile(df, order=["a"]).ids == ("a",)


def test_auc_counts_ties_half(spark, apart):
    rng = random.Random(2)
    rows = [(rng.randrange(12) / 3, rng.random() < 0.3) for _ in range(400)] + [(None, True), (1.0, None)]
    df = spark.createDataFrame(rows, "s double, t boolean")
    pos, neg = [s for s, t in rows if t and s is not None], [s for s, t in rows if t is False]
    exact = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert ordered.auc(df, F.col("s"), F.col("t")) == pytest.approx(exact)
    assert ordered.auc(df.where("t"), F.col("s"), F.col("t")) is None


def test_planted_rows_follow_from_their_keys(spark):
    df = spark.createDataFrame([(i, 10.0 + i, None if i % 5 == 0 else 3.0) for i in range(3000)] + [(None, 1.0, 1.0)], "id long, x double, y double")
    one = planted.plant(df, ["x", "y"], "id")
    assert sorted(map(str, one.collect())) == sorted(map(str, planted.plant(df.repartition(7), ["x", "y"], "id").collect()))
    n = {r["kind"]: r["n"] for r in one.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(n) == {None, *planted.KINDS} and 30 <= sum(v for k, v in n.items() if k) <= 100
    for r in one.where("kind IS NOT NULL").collect():
        x, y = 10.0 + r["id"], None if r["id"] % 5 == 0 else 3.0
        off = {"point_moved": lambda v: v * 100, "sign_turned": lambda v: -v, "far_out": lambda v: v + 1e6, "stuck": lambda v: 0.0}[r["kind"]]
        assert (r["x"], r["y"]) in [(off(x), y), (x, y if y is None else off(y))]


@pytest.mark.parametrize("algorithm", ["iforest", "hbos", "lof", "cblof", "ocsvm", "ensemble", "incremental"])
def test_every_detector_tells_planted_outliers(spark, algorithm):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.gauss(50, 5), rng.gauss(20, 2)) for i in range(1500)], "id long, x double, y double").repartition(3)
    df = planted.plant(df, ["x", "y"], "id", per_mille=30)
    detector = engine.fit_detector(df.drop("kind"), algorithm, Settings(clip=False), ["x", "y"], "id")
    found = ordered.auc(detector.raw_scores(df), F.col("raw"), F.col("kind").isNotNull())
    # ten bins of equal width reach to the farthest value, so hbos can tell the rows far out only
    assert found > (0.6 if algorithm in ("hbos", "ocsvm", "incremental", "cblof") else 0.9)


# --- one-class support vectors ----------------------------------------------------------------------------------------


def direct(x, gamma, nu, tolerance=1e-7):
    """The same problem by steps on the pair that violates optimality most, over the whole matrix."""
    k = ocsvm.kernel(x, x, gamma)
    most = 1 / (nu * len(x))
    alpha = np.zeros(len(x))
    alpha[: int(nu * len(x))] = most
    alpha[int(nu * len(x))] += 1 - alpha.sum()
    g = k @ alpha
    while True:
        i, j = np.argmin(np.where(alpha < most - 1e-12, g, np.inf)), np.argmax(np.where(alpha > 1e-12, g, -np.inf))
        if g[j] - g[i] < tolerance:
            return alpha, g
        step = min((g[j] - g[i]) / max(2 - 2 * k[i, j], 1e-12), most - alpha[i], alpha[j])
        alpha[i] += step
        alpha[j] -= step
        g += step * (k[:, i] - k[:, j])


@pytest.mark.parametrize("shard", [250, 5000])
def test_cascade_is_the_direct_solve(spark, shard):
    x = np.random.default_rng(4).normal(size=(2000, 2))
    x[:40] *= 4
    alpha, g = direct(x, 0.5, 0.05)
    free = (alpha > 1e-9) & (alpha < 0.01 - 1e-9)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(3)
    model = ocsvm.fit_ocsvm(df, ["a", "b"], 0.05, shard)
    support, weights, offset, _ = model.state.value
    assert weights.sum() == pytest.approx(1) and offset == pytest.approx(g[free].mean(), abs=2e-5)
    # the dual objectives agree, and so do the flags but for rows on the margin
    assert weights @ ocsvm.kernel(support, support, 0.5) @ weights == pytest.approx(alpha @ g, abs=1e-5)
    raw = {(r["a"], r["b"]): r["raw"] for r in df.select("a", "b", model.raw(["a", "b"]).alias("raw")).collect()}
    clear = np.abs(g[free].mean() - g) > 1e-4
    assert all((raw[tuple(r)] > 0) == (v > 0) for r, v, c in zip(x.tolist(), g[free].mean() - g, clear) if c)


def test_many_equal_rows_are_one_with_their_weight(spark):
    x = np.random.default_rng(5).normal(size=(300, 2))
    x[:100] = [0.5, 0.5]
    alpha, g = direct(x, 0.5, 0.2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(3)
    support, weights, offset, _ = ocsvm.fit_ocsvm(df, ["a", "b"], 0.2, shard=50).state.value
    assert len(support) == len(np.unique(support, axis=0))
    assert weights @ ocsvm.kernel(support, support, 0.5) @ weights == pytest.approx(alpha @ g, abs=1e-4)


def test_only_some_columns_of_the_kernel_are_kept(monkeypatch):
    monkeypatch.setattr(ocsvm, "CACHE_BYTES", 8 * 500 * 20)
    k = ocsvm.Kernel(np.random.default_rng(6).normal(size=(500, 2)), 0.5)
    for i in range(200):
        k.column(i)
    assert len(k.held) == 20
