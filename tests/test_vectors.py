"""Array columns as features."""

import random

import pytest

from farstray.config import Settings
from farstray.operators import vectors
from farstray.operators.features import fit_features
from farstray.operators.profile import profile
from farstray.plans import engine
from farstray.plans.estimator import load_detector, save_detector


def rows(n=400, d=4, odd=True):
    rng = random.Random(3)
    out = []
    for i in range(n):
        v = [rng.gauss(0, 1) * (k + 1) for k in range(d - 1)] + [7.0]
        if odd:
            v = None if i == 5 else v[:2] if i == 6 else [None, *v[1:]] if i % 30 == 0 else [v[0], float("nan"), *v[2:]] if i == 8 else v
        out.append((i, v, rng.random()))
    return out


@pytest.mark.parametrize("scaling", ["robust", "standard", "minmax", "none"])
@pytest.mark.parametrize("direct", [True, False])
def test_places_are_prepared_as_columns_are(spark, monkeypatch, scaling, direct):
    if not direct:
        monkeypatch.setattr(vectors, "DIRECT_ROWS", 10)
    df = spark.createDataFrame(rows(), "id long, v array<double>, y double").repartition(3)
    model = vectors.fit_vectors(df, ["v", "y"], scaling)
    found = {r["id"]: r["f_vector"] for r in model.transform(df).collect()}
    wide = df.selectExpr("id", *(f"get(v, {i}) AS x{i}" for i in range(4)), "y")
    plain = fit_features(wide, ["x0", "x1", "x2", "x3", "y"], scaling)
    assert model.places == (0, 1, 2, 4) and plain.kept == ("x0", "x1", "x2", "y")  # the fourth is constant
    expected = {r["id"]: [r[f"f_{c}"] for c in plain.kept] for r in plain.transform(wide).collect()}
    assert found.keys() == expected.keys() and all(found[i] == pytest.approx(expected[i], abs=1e-9) for i in found)


def test_a_table_of_vectors_is_routed_by_its_dimensions(spark, tmp_path):
    rng = random.Random(5)
    data = [(i, [rng.gauss(0, 1) * (6 if i % 40 == 0 else 1) for _ in range(60)]) for i in range(400)]
    df = spark.createDataFrame(data, "id long, v array<float>").repartition(3)
    assert profile(df).usable_dimensions == 60
    found = engine.detect(df, Settings(contamination=0.025), key="id")
    assert found.algorithm == "iforest"
    assert {r["id"] for r in found.scored.where("is_outlier").collect()} == {i for i in range(400) if i % 40 == 0}
    save_detector(spark, found.detector, f"{tmp_path}/d")
    again = load_detector(spark, f"{tmp_path}/d").transform(df)
    assert sorted(map(str, again.select("id", "anomaly_score").collect())) == sorted(map(str, found.scored.select("id", "anomaly_score").collect()))


def test_no_rows_and_empty_arrays(spark):
    df = spark.createDataFrame([(1, []), (2, None)], "id long, v array<double>")
    assert vectors.fit_vectors(df, ["v"]).kept == () and vectors.fit_vectors(df.limit(0), ["v"]).kept == ()
    out = engine.detect(df, key="id").scored.collect()
    assert len(out) == 2 and not any(r["is_outlier"] for r in out)
