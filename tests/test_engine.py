"""Detection runs, features, categories and CSV input on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from farstray.config import Settings
from farstray.functions import quantiles, sampling
from farstray.functions.quantiles import exact_quantiles
from farstray.operators import categorical, features, incremental, lof
from farstray.operators.profile import profile
from farstray.plans import cli, engine, route
from farstray.sources import csv_files, lines, results, synthetic
from farstray.streaming import score


def amounts(spark, partitions=3):
    rng = random.Random(1)
    rows = [(i, rng.gauss(50, 10), rng.choice("ABC")) for i in range(195)] + [(195 + k, v, "A") for k, v in enumerate((500.0, 600.0, 700.0, -100.0, -200.0))]
    return spark.createDataFrame(rows, "id long, amount double, category string").repartition(partitions)


@pytest.mark.parametrize("algorithm", ["iforest", "hbos", "lof", "cblof", "ocsvm", "ensemble", "incremental"])
def test_every_algorithm_flags_the_odd_rows(spark, algorithm):
    out = engine.detect(amounts(spark), Settings(algorithm=algorithm), key="id").scored.collect()
    assert len(out) == 200 and all(0 <= r["anomaly_score"] <= 1 for r in out)
    flagged = {r["id"] for r in out if r["is_outlier"]}
    if algorithm in ("iforest", "hbos", "lof", "ensemble", "incremental"):  # the others need not flag any of so few rows
        assert len(flagged & set(range(195, 200))) >= 3
    if algorithm != "hbos":
        assert len(flagged) <= 40


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_results_do_not_depend_on_partitions(spark, partitions):
    found = engine.detect(amounts(spark, partitions), Settings(algorithm="hbos"), key="id").scored
    one = engine.detect(amounts(spark, 1), Settings(algorithm="hbos"), key="id").scored
    assert sorted(found.select("id", "anomaly_score", "is_outlier").collect()) == sorted(one.select("id", "anomaly_score", "is_outlier").collect())


@pytest.mark.parametrize("algorithm", ["hbos", "lof"])
def test_bounds_and_histograms_cover_more_rows_than_the_sample(spark, algorithm):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.gauss(50, 10)) for i in range(2500)], "id long, amount double").repartition(3)
    detector = lambda rows: engine.fit_detector(df, algorithm, Settings(global_sample_rows=rows, clip=False), ["amount"], "id")
    few, scores = detector(1000), [r["raw"] for r in detector(1000).raw_scores(df).collect()]
    assert (few.bounds.low, few.bounds.high) == (min(scores), max(scores))
    assert few.bounds.threshold == pytest.approx(sorted(scores)[int(0.95 * 2499)], abs=0.05)
    if algorithm == "hbos":
        assert few.model == detector(50_000).model


def test_lof_of_all_rows_is_exact(spark, monkeypatch):
    monkeypatch.setattr(lof, "BLOCK", 30)
    rng = random.Random(4)
    rows = [(i, float(rng.randrange(40)), rng.random()) for i in range(150)]
    found = dict(map(tuple, lof.exact_lof(spark.createDataFrame(rows + [(900, None, 1.0)], "id long, x double, y double").repartition(3), ["x", "y"], "id").collect()))
    near = {}
    for i, x, y in rows:
        near[i] = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, str(j), j) for j, a, b in rows if j != i)[:20]
    density = {i: 1 / (sum(max(d, near[j][-1][0]) for d, _, j in e) / 20 + 1e-10) for i, e in near.items()}
    assert found == pytest.approx({i: sum(density[j] for *_, j in e) / 20 / density[i] for i, e in near.items()})


@pytest.mark.parametrize("rows, schema", [([("a",), ("b",), ("c",)], "name string"), ([(42.0,)], "val double"), ([(None,)] * 3, "val double"), ([], "val double")])
def test_degenerate_tables_are_not_flagged(spark, rows, schema):
    out = engine.detect(spark.createDataFrame(rows, schema)).scored.collect()
    assert len(out) == len(rows) and not any(r["is_outlier"] for r in out)


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(i, float(i % 7), 1) for i in range(60)], "id long, x double, IS_OUTLIER int")
    out = engine.detect(df, Settings(algorithm="hbos"), key="id").scored
    assert {"IS_OUTLIER__input", "is_outlier"} <= set(out.columns) and out.count() == 60


def test_settings_are_checked():
    for bad in ({"contamination": 0.5}, {"algorithm": "nope"}, {"scaling": "x"}, {"profiler_sample_rows": 1}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_imputation_and_constant_columns(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0), (2, 20.0, 5.0), (3, None, 5.0), (4, 40.0, 5.0), (5, 50.0, 5.0)], "id int, amount double, constant double")
    value = lambda s: {r["id"]: r["amount"] for r in features.impute(df, ["amount"], s).collect()}
    assert value("median")[3] == 30.0 and value("mean")[3] == 30.0 and value("zero")[3] == 0.0 and 3 not in value("drop")
    assert features.drop_constant_columns(df, ["amount", "constant"]) == ["amount"]


def test_quantiles_by_refinement_are_exact(spark):
    df = spark.range(1000).select((F.pmod(F.col("id") * 7919, F.lit(1009)) / 3.0).alias("x"))
    p = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    direct, refined = exact_quantiles(df, ["x"], p)["x"], exact_quantiles(df, ["x"], p, direct_rows=10)["x"]
    assert refined == pytest.approx(direct)


def test_quantiles_of_several_columns_are_refined_together(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 5)
    monkeypatch.setattr(quantiles, "BINS", 64)
    rng = random.Random(6)
    rows = [(rng.gauss(0, 1e6), float(rng.randrange(3)), 1.0, None if i % 3 else rng.random() * 5e-324) for i in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    p = [0.0, 0.01, 0.25, 0.5, 0.995, 1.0]
    direct, refined = exact_quantiles(df, df.columns, p), exact_quantiles(df, df.columns, p, direct_rows=10)
    assert refined == {c: pytest.approx(q) for c, q in direct.items()}
    assert exact_quantiles(df.where("false"), ["a"], p, direct_rows=-1) == {"a": [None] * 6}


@pytest.mark.parametrize("keys", [["id"], ["same"], None])
def test_samples_of_large_tables_are_the_first_by_hash(spark, keys):
    df = spark.range(9000).select("id", (F.col("id") % 2).alias("same"), F.lit(1.5).alias("x")).repartition(5)
    expected = df.orderBy(*sampling.sample_order(df, keys)).limit(100)
    names = ["id"] if keys != ["same"] else ["same"]
    assert sorted(map(tuple, sampling.uniform_sample(df, 100, keys).select(names).collect())) == sorted(map(tuple, expected.select(names).collect()))


def test_incremental_detector_on_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.gauss(10, 2), rng.gauss(0, 1), rng.choice("ab")) for i in range(900)] + [(900 + i, 200.0 + i, -50.0, "a") for i in range(20)]
    schema = "id long, x double, y double, kind string"
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    fitter = score.StreamFitter(incremental.begin(df, 0.05, ["x", "y"], ["kind"]))
    fitter.start(stream(), f"{tmp_path}/fit").awaitTermination()
    assert fitter.model.steps == 3
    flagged = {r["id"] for r in df.withColumn("raw", fitter.model.raw()).orderBy(F.desc("raw")).limit(46).collect()}
    assert set(range(900, 920)) <= flagged
    detector = engine.fit_detector(df, "hbos", Settings(), ["x", "y"], "id")
    query = score.score_stream(stream(), detector).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/scored").trigger(availableNow=True).start()
    query.awaitTermination()
    order = lambda d: sorted(d.select("id", "anomaly_score", "is_outlier").collect())
    assert order(spark.read.parquet(f"{tmp_path}/out")) == order(detector.transform(df))


def test_profile_of_a_sample(spark):
    df = spark.range(5000).select("id", (F.col("id") % 97).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"))
    found = engine.detect(df, Settings(algorithm="hbos", profile_sampled=True, profiler_sample_rows=200), key="id").profile
    assert found.rows == 5000 and found.details["x"]["n_unique"] <= 97 and found.details["kind"]["cardinality_ratio"] == pytest.approx(0.01)


def test_synthetic_table_has_what_it_says(spark):
    df = synthetic.synthetic_table(spark, 6000, contamination=0.2).cache()
    assert df.repartition(7).agg(F.bit_xor(F.xxhash64("*"))).first() == synthetic.synthetic_table(spark, 6000, contamination=0.2).agg(F.bit_xor(F.xxhash64("*"))).first()
    kinds = {r["kind"]: r["n"] for r in synthetic.outlier_breakdown(df).collect()}
    assert set(kinds) == {*synthetic.NUMERIC, *synthetic.CATEGORICAL, *synthetic.SINGLE} and 900 < sum(kinds.values()) < 1500
    assert df.where("is_planted = 0 AND (least(parcels_small, parcels_medium, parcels_large, kg_small, kg_medium, kg_large) < 1 OR state = '?' OR region = 'nowhere' OR signed = 'maybe')").isEmpty()
    assert df.where("kind = 'nothing' AND parcels_small + kg_large <> 0").isEmpty() and df.where("kind = 'own_stop'").groupBy("stop").count().where("count > 1").isEmpty()


BROKEN = b"a,b,c\r\n1,2,3\n1,2\n\xff\xfe,2,3\n1,\"x\ny\",3\n1,\"p\"\"q\",3\nx\"y,2,3\n1,\x00,3\n'\"a\"',2,3\n"


def test_lines_of_a_csv_file(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_bytes(BROKEN)
    found = sorted((r["line"], r["type"]) for r in lines.validate_csv(spark, str(path)).collect())
    expected = [(3, "Wrong field count"), (4, "Invalid encoding"), (5, "Multiline record"), (5, "Wrong field count"), (6, "Multiline record"), (6, "Wrong field count"), (6, "Invalid quoting"), (6, "Invalid quoting")]
    expected += [(7, "Broken quoted field"), (7, "Invalid quoting"), (8, "Multiline record"), (8, "Invalid quoting"), (9, "NULL byte"), (10, "Invalid quoting")]
    assert found == sorted(expected)
    relaxed = {(r["line"], r["type"]) for r in lines.validate_csv(spark, str(path), strict=False).collect()}
    assert (7, "Broken quoted field") not in relaxed and (3, "Wrong field count") in relaxed and (8, "Invalid quoting") not in relaxed
    assert (10, "Invalid quoting") in {(r["line"], r["type"]) for r in lines.validate_csv(spark, str(path), strict=False, mixed=True).collect()}
    assert {r["line"] for r in lines.validate_csv(spark, str(path), max_lines=4).collect()} == {3, 4}
    assert csv_files.count_lines(spark, str(path)) == 9


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("".join(f"{i}\n" for i in range(1, 60_001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = lines.numbered_lines(spark, str(path))
        assert rows.where(F.col("line") != F.col("value").cast("long")).isEmpty() and rows.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_validation_reports_and_exit_code(spark, tmp_path, capsys):
    path, out = tmp_path / "broken.csv", str(tmp_path / "r.parquet")
    path.write_bytes(BROKEN)
    assert cli.main(["-i", str(path), "--validate-only", "--output-path", out], spark) == 1
    assert "8 lines" in capsys.readouterr().out
    report = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{out}.validation/csv")
    assert report.columns == ["line", "type", "description", "raw_content"] and report.count() == 14
    assert spark.read.text(f"{out}.validation/text").where("value LIKE 'Line %'").count() == 8
    good = tmp_path / "good.csv"
    good.write_text("a,b\n1,2\n")
    assert cli.main(["-i", str(good), "--validate-only", "--output-path", out], spark) == 0


def test_answer_of_the_command_line(spark, tmp_path, capsys):
    path = tmp_path / "t.csv"
    path.write_text("id,amount,kind\n" + "".join(f"{i},{50 + i % 9},{'ab'[i % 2]}\n" for i in range(200)) + "200,9000,a\n201,,\"x\ny\"\n")
    assert csv_files.read_csv(spark, str(path)).count() == 202  # a field over two lines
    assert cli.main(["-i", str(path), "--output-path", str(tmp_path / "o.parquet"), "--key", "id", "--algorithm", "hbos", "--explain", "--answer"], spark) == 0
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found["profile"]["rows"] == 202 and found["summary"]["total_rows"] == 202 and found["outliers"]
    assert all("multiple" in f for e in found["explanations"] for f in e["top_features"]) and found["explanations"]
    assert spark.read.json(results.explanations_path(str(tmp_path / "o.parquet"))).count() == len(found["explanations"])


def test_profile_finds_ids_and_quality(spark):
    p = profile(spark.createDataFrame([(i, float(i * i), "AB"[i % 2]) for i in range(1, 101)], "id int, amount double, category string"))
    assert p.rows == 100 and "id" in p.ids and "amount" not in p.ids and 0 <= p.quality <= 100
    assert route.choose_algorithm(p, Settings()) == "iforest"


def test_rare_categories(spark):
    df = spark.createDataFrame([("A",)] * 95 + [("B",)] * 4 + [("RARE",)], "cat string")
    flagged = categorical.rare_categories(df, ["cat"], threshold=0.02).where("is_cat_outlier")
    assert [r["cat"] for r in flagged.collect()] == ["RARE"]
    even = spark.createDataFrame([("A",), ("B",)] * 50, "cat string")
    assert categorical.rare_categories(even, ["cat"]).where("is_cat_outlier").isEmpty()


def test_csv_input_and_command_line(spark, tmp_path, capsys):
    with pytest.raises(csv_files.CsvError):
        csv_files.validate_file(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(csv_files.CsvError):
        csv_files.read_csv(spark, str(tmp_path / "empty.csv"))
    rows = [f"{i},{50 + 0.5 * i},{'AB'[i % 2]}" for i in range(50)] + ["50,999,A", "51,1000,B", "52,-500,C"]
    path = tmp_path / "t.csv"
    path.write_text("id,amount,category\n" + "\n".join(rows) + "\n")
    assert csv_files.read_csv(spark, str(path)).count() == 53
    assert cli.main(["-i", str(path), "--output-path", str(tmp_path / "out.parquet"), "--key", "id", "--algorithm", "iforest"], spark) == 0
    assert "iforest" in capsys.readouterr().out


def test_values_that_a_sample_lacks_are_rare(spark):
    df = spark.createDataFrame([(i, "aab"[i % 3]) for i in range(900)] + [(5000, "odd"), (5001, None)], "id long, kind string")
    freq = categorical.sample_frequencies(df.where("id < 900"), ["kind"], 200, ["id"])
    out = {r["id"]: (r["cat_anomaly_score"], r["is_cat_outlier"]) for r in categorical.rare_categories(df, ["kind"], freq=freq).collect()}
    assert out[5000] == (1.0, True) and out[5001] == (0.0, False) and not any(flag for i, (_, flag) in out.items() if i < 900)
    once = engine.detect(df, Settings(algorithm="hbos", cat_freq_mode="single-pass"), key="id").scored
    assert once.where("is_cat_outlier AND id < 900").isEmpty()


def test_several_columns_take_the_largest_rarity(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "x" if i else "y") for i in range(400)], "id long, even string, odd string")
    [row] = categorical.rare_categories(df, ["even", "odd"]).where("is_cat_outlier").collect()
    assert row["id"] == 0 and row["cat_anomaly_score"] == 1.0


def test_columns_with_the_fewest_values_are_looked_at(spark):
    counts = spark.createDataFrame([(f"c{i}", str(v), 1) for i in range(60) for v in range(1 + i % 12)], "column string, value string, n long")
    names = categorical.candidate_columns(counts, [f"c{i}" for i in range(60)], 100)
    assert len(names) == categorical.MOST_COLUMNS and names[:5] == ["c0", "c12", "c24", "c36", "c48"] and "c11" not in names


def test_explanations_are_the_fitted_detectors(spark):
    assert engine.detect(amounts(spark), Settings(algorithm="incremental", explain=True), key="id").explanations is None
    found = engine.detect(amounts(spark), Settings(algorithm="hbos", explain=True, max_explain_rows=5), key="id")
    rows = found.explanations.collect()
    assert 0 < len(rows) <= 5 and {r["method"] for r in rows} == {"shap"} and {r["top_features"][0]["feature"] for r in rows} == {"amount"}


def test_a_fitted_detector_scores_other_tables(spark):
    detector = engine.fit_detector(amounts(spark), "iforest", Settings(), ["amount"], "id")
    other = spark.createDataFrame([(1, 50.0, "A"), (2, 650.0, "B"), (3, None, "C")], "id long, amount double, category string")
    out = {r["id"]: r for r in detector.transform(other).collect()}
    assert out[2]["is_outlier"] and not out[1]["is_outlier"] and out[2]["anomaly_score"] > out[1]["anomaly_score"] and len(out) == 3


def test_bytes_that_are_no_text_are_read(spark, tmp_path):
    path = tmp_path / "bytes.csv"
    path.write_bytes(b"name,x\n\xff\xfeab,1\nplain,2\n")
    rows = csv_files.read_csv(spark, str(path)).collect()
    assert len(rows) == 2 and "\ufffd" in rows[0]["name"] and rows[0]["x"] == "1"


@pytest.mark.parametrize("algorithm", ["lof", "ensemble", "iforest"])
def test_rows_at_one_place_are_scored_once(spark, algorithm):
    rows = [(i, float(i % 13), float(i % 7) ** 2 if i % 50 else None) for i in range(900)] + [(900, 40.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    detector = engine.fit_detector(df, algorithm, Settings(clip=False, lof_reference_rows=60), ["x", "y"], "id")
    places = detector.places.collect()
    assert sum(p["__rows"] for p in places) == 901 and len(places) <= 13 * 8 + 1 + 60
    order = lambda found: sorted(found.select("id", "anomaly_score", "is_outlier").collect())
    looked_up, anew = order(detector.transform(df)), order(detector.transform(df.select("*")))
    assert len(looked_up) == 901 and looked_up == anew
    assert len({r["is_outlier"] for r in looked_up}) == 2
