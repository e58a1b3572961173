"""Nearest neighbours by boxes against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farstray.config import Settings
from farstray.operators import lof
from farstray.operators import neighbours as nb
from farstray.plans import engine


def all_pairs(x, k, names, own=None, q=None, reach=None):
    q = x if q is None else q
    out = []
    for i, a in enumerate(q):
        d = np.sqrt(sum((a[c] - x[:, c]) ** 2 for c in range(x.shape[1])))
        rows = [(d[j], names[j], j) for j in range(len(x)) if (own is None or names[j] != own[i]) and (reach is None or d[j] <= reach[i])]
        out += [(i, j, e) for e, _, j in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("d, n, grid", [(1, 700, 0), (2, 900, 12), (2, 1500, 0), (6, 600, 0), (9, 400, 3)])
def test_boxes_find_what_all_pairs_find(d, n, grid):
    rng = np.random.default_rng(d * n)
    x = rng.integers(0, grid, size=(n, d)).astype(float) if grid else rng.normal(size=(n, d))
    x[: n // 3] = x[0]  # many at one place
    codes = rng.permutation(n)
    found = nb.Boxes(x, codes).nearest(x, 7, own=codes)
    assert list(zip(*(c.tolist() for c in found))) == all_pairs(x, 7, codes, own=codes)
    q, reach = rng.normal(size=(40, d)) * 2, rng.random(40) * 2
    found = nb.Boxes(x, codes).nearest(q, 5, reach)
    assert list(zip(*(c.tolist() for c in found))) == all_pairs(x, 5, codes, q=q, reach=reach)


def test_close_points_far_from_zero_are_told_apart():
    """Squares of large numbers would cancel."""
    x = 1e6 + np.random.default_rng(1).normal(size=(300, 9)) * 1e-3
    row, place, d = nb.Boxes(x, np.arange(300)).nearest(x, 1, own=np.arange(300))
    assert d.min() > 0 and list(zip(row, place)) == [(i, j) for i, j, _ in all_pairs(x, 1, np.arange(300), own=np.arange(300))]


@pytest.mark.parametrize("d, grid", [(1, 0), (2, 9), (3, 0), (8, 0)])
def test_neighbours_of_a_table_are_those_of_all_pairs(spark, d, grid):
    rng = random.Random(d)
    rows = [(str(i), [float(rng.randrange(grid)) if grid else rng.gauss(0, 1) * (1 + 30 * (i % 50 == 0)) for _ in range(d)]) for i in range(500)]
    rows += [(f"same{i}", [1.0] * d) for i in range(250)]  # a third at one place
    found = dict(nb.exact_neighbours(spark.createDataFrame(rows, "name string, x array<double>").repartition(5), 6, d, block=40).collect())
    x, names = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    expected = {n: [] for n, _ in rows}
    for i, j, e in all_pairs(x, 6, names, own=names):
        expected[names[i]].append((e, names[j]))
    assert {n: [(e["d"], e["j"]) for e in near] for n, near in found.items()} == expected


def test_fewer_rows_than_neighbours(spark):
    rows = [("a", [0.0]), ("b", [1.0]), ("c", [3.0])]
    found = dict(nb.exact_neighbours(spark.createDataFrame(rows, "name string, x array<double>"), 5, 1).collect())
    assert {n: [e["j"] for e in near] for n, near in found.items()} == {"a": ["b", "c"], "b": ["a", "c"], "c": ["b", "a"]}
    assert nb.exact_neighbours(spark.createDataFrame([], "name string, x array<double>"), 5, 1).count() == 0


def test_visited_blocks_grow_with_the_rows(spark, monkeypatch):
    """At four times the rows and blocks a row visits about as many blocks, where all pairs would be four times as many."""
    seen = []
    real = nb.visits_of

    def counted(*args):
        out = real(*args)
        seen[-1] += out.count()
        return out

    monkeypatch.setattr(nb, "visits_of", counted)
    for n in (2000, 8000):
        seen.append(0)
        rng = random.Random(n)
        df = spark.createDataFrame([(str(i), [rng.random(), rng.random()]) for i in range(n)], "name string, x array<double>").repartition(4)
        assert nb.exact_neighbours(df, 10, 2, block=100).where(F.size("near") == 10).count() == n
    assert seen[0] / 2000 < 4 and seen[1] / 8000 < 1.4 * seen[0] / 2000


def test_a_crowded_block_is_dealt_over_tasks(spark, monkeypatch):
    """All far rows visit the same block; their number there decides how many tasks share it."""
    monkeypatch.setattr(nb, "VISITORS", 30)
    rng = random.Random(8)
    rows = [(f"n{i}", [rng.random() * 0.01]) for i in range(60)] + [(f"f{i}", [1000.0 + 500 * i]) for i in range(80)]
    found = dict(nb.exact_neighbours(spark.createDataFrame(rows, "name string, x array<double>").repartition(3), 4, 1, block=20).collect())
    x, names = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    expected = {n: [] for n in names}
    for i, j, _ in all_pairs(x, 4, names, own=names):
        expected[names[i]].append(names[j])
    assert {n: [e["j"] for e in near] for n, near in found.items()} == expected


def test_model_and_exact_scores_agree(spark):
    """A reference of all rows gives each of them its exact score."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)], "id long, x double, y double").repartition(3)
    exact = dict(map(tuple, lof.exact_lof(df, ["x", "y"], "id", block=50).collect()))
    model = lof.fit_lof(df, ["x", "y"], F.col("id"))
    scored = dict(map(tuple, df.select("id", model.raw(["x", "y"], F.col("id"))).collect()))
    assert scored == pytest.approx(exact, abs=1e-9)


def test_rows_of_crowded_places_share_an_exact_score(spark):
    """Places with far more rows than neighbours, some with one more or less, repeated keys and rows without one."""
    rng = random.Random(6)
    rows = [(i, float(i % 3), 0.0) for i in range(120)] + [(200 + i, 5.0, float(i // n)) for n in (4, 5, 6, 7) for i in range(n)] + [(300 + i, rng.random(), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    keyed = df.withColumn("id", F.concat(F.col("id"), F.lit("-"), F.monotonically_increasing_id()))  # 200 and the next ones are there four times
    keyed = keyed.localCheckpoint()
    rows = [tuple(r) for r in keyed.collect()]
    near = {i: sorted((float(np.sqrt((x - a) ** 2 + (y - b) ** 2)), j) for j, a, b in rows if j != i)[:5] for i, x, y in rows}
    density = {i: 1 / (sum(max(d, near[j][-1][0]) for d, j in e) / 5 + 1e-10) for i, e in near.items()}
    expected = {i: round(sum(density[j] for _, j in e) / 5 / density[i], 10) for i, e in near.items()}
    found = dict(map(tuple, lof.exact_lof(keyed, ["x", "y"], "id", 5, block=30).collect()))
    assert found == pytest.approx(expected, rel=1e-9)
    odd = df.unionByName(spark.createDataFrame([(None, 0.0, 0.0), (None, 9.0, 9.0), (1, None, 3.0)], df.schema))
    flagged = engine.lof_of_all(odd, Settings(impute="drop", clip=False), ["x", "y"], "id").collect()
    assert len(flagged) == len(rows) + 3 and any(r["is_outlier"] for r in flagged)
    assert all(r["anomaly_score"] == 0 and not r["is_outlier"] for r in flagged if r["id"] is None or r["x"] is None)
