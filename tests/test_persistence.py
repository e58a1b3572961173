"""Detectors as stages of a pipeline, saved and loaded, and counts that move no text."""

import random
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from farstray.operators import categorical, profile
from farstray.plans.estimator import OutlierDetector, OutlierModel

LOADED = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from farstray.plans.estimator import OutlierModel
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
out = OutlierModel.load({path!r}).transform(spark.read.parquet({table!r}))
out.select("id", "anomaly_score", "is_outlier").write.parquet({out!r})
"""


def table(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1) * (9 if i % 50 == 0 else 1), None if i % 60 == 0 else rng.gauss(5, 2), rng.choice("ab")) for i in range(300)]
    return spark.createDataFrame(rows, "id long, x double, y double, kind string").repartition(3)


def scores(df):
    return sorted(map(tuple, df.select("id", "anomaly_score", "is_outlier").collect()))


@pytest.mark.parametrize("algorithm", ["iforest", "hbos", "lof", "cblof", "ocsvm", "ensemble", "incremental"])
def test_a_saved_model_gives_the_same_scores(spark, tmp_path, algorithm):
    df = table(spark)
    stage = OutlierDetector(algorithm=algorithm, key="id", inputCols=["x", "y"], settings='{"contamination": 0.04}')
    model = stage.fit(df)
    model.write().overwrite().save(f"{tmp_path}/model")
    again = OutlierModel.load(f"{tmp_path}/model")
    assert again.uid == model.uid and again.getOrDefault("algorithm") == algorithm
    assert scores(again.transform(df)) == scores(model.transform(df))


def test_another_session_loads_it(spark, tmp_path):
    df = table(spark)
    df.write.parquet(f"{tmp_path}/table")
    model = OutlierDetector(algorithm="ensemble", key="id", inputCols=["x", "y"]).fit(df)
    model.save(f"{tmp_path}/model")
    repo = __file__.rsplit("/tests/", 1)[0]
    code = LOADED.format(repo=repo, path=f"{tmp_path}/model", table=f"{tmp_path}/table", out=f"{tmp_path}/out")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    assert scores(spark.read.parquet(f"{tmp_path}/out")) == scores(model.transform(df))


def test_a_pipeline_holds_it(spark, tmp_path):
    df = table(spark)
    half = SQLTransformer(statement="SELECT *, x / 2 AS z FROM __THIS__")
    stage = OutlierDetector(algorithm="hbos", key="id", inputCols=["x", "z"])
    stage.save(f"{tmp_path}/stage")
    assert OutlierDetector.load(f"{tmp_path}/stage").getOrDefault("inputCols") == ["x", "z"]
    fitted = Pipeline(stages=[half, stage]).fit(df)
    fitted.save(f"{tmp_path}/pipeline")
    assert scores(PipelineModel.load(f"{tmp_path}/pipeline").transform(df)) == scores(fitted.transform(df))


def test_counts_of_different_values_move_no_text(spark):
    df = spark.createDataFrame([(i % 7, None if i % 11 == 0 else f"text {i % 23} " * 50, str(i)) for i in range(300)], "a long, b string, c string").repartition(3)
    counts = profile.null_counts(df)
    assert {r["column"]: (r["nulls"], r["n_unique"], r["rows"]) for r in counts.collect()} == {"a": (0, 7, 300), "b": (28, 24, 300), "c": (0, 300, 300)}
    assert categorical.print_counts(df, df.columns).schema.simpleString() == "struct<column:string,p1:bigint,p2:bigint,n:bigint>"
    grouped = [x for x in categorical.print_counts(df, df.columns)._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert len(grouped) == 1 and grouped[0].count("_groupingexpression") == 3  # the column's place and two numbers


def test_long_texts_with_many_values_are_not_counted_as_texts(spark, monkeypatch):
    asked = []
    real = categorical.value_counts
    monkeypatch.setattr(categorical, "value_counts", lambda df, names: asked.append(list(names)) or real(df, names))
    df = spark.createDataFrame([(i, f"long text {i}" * 20, "rare" if i == 7 else "abc"[i % 3]) for i in range(400)], "id long, text string, kind string")
    out = categorical.rare_categories(df, ["text", "kind"])
    assert [r["id"] for r in out.where("is_cat_outlier").collect()] == [7] and asked == [["kind"]]
    assert out.where(F.col("cat_anomaly_score") == 1).count() == 1
