"""CSV records over several lines, Shapley values against enumeration, and incremental fitting that survives a restart."""

import csv
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from farstray.config import Settings
from farstray.operators import explain, incremental
from farstray.plans import engine
from farstray.sources import csv_files, quoted
from farstray.streaming.score import StreamFitter
from farstray.streaming.state import EpochStore

# --- CSV --------------------------------------------------------------------------------------------------------------


def written(path, rows, header=("id", "a b", 'c"\nd')):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(header)
        out.writerows(rows)
    return str(path)


@pytest.fixture
def split(spark):
    """Sets how large a piece of a file a task reads."""
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def csv_rows(seed, n=300):
    rng = random.Random(seed)
    field = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", "x y", "é", '\n"', '""', " ", '",', ',"']) for _ in range(rng.choice([0, 1, 3, 8, 60])))
    rows = [(str(i), field(), field()) for i in range(n)]
    return rows[:5] + [("5", "z\n" * 2000, "over many blocks")] + rows[6:]


@pytest.mark.parametrize("size", [700, 5000, 1 << 27])
def test_fields_over_several_lines_are_read_by_many_tasks(spark, tmp_path, split, size):
    rows = csv_rows(1)
    path = written(tmp_path / "x.csv", rows)
    split(size)
    assert quoted.lines_of(spark, path).rdd.getNumPartitions() >= min(8, os.path.getsize(path) // size)
    df = csv_files.read_csv(spark, path)
    assert df.columns == ["id", "a b", 'c"\nd']
    assert sorted(map(tuple, df.collect())) == sorted((a, b or None, c or None) for a, b, c in rows)


def test_headers_of_several_files_and_blank_lines(spark, tmp_path, split):
    folder = tmp_path / "all.csv"
    folder.mkdir()
    for i in range(3):
        path = written(folder / f"{i}.csv", [(f"{i}-{k}", "a\nb", "c") for k in range(30)])
        if i == 1:
            with open(path) as f:
                text = f.read()
            with open(path, "w") as f:
                f.write("\n\n" + text.replace("1-7,", "\n1-7,"))
    split(200)
    found = csv_files.read_csv(spark, str(folder)).collect()
    assert sorted(r["id"] for r in found) == sorted(f"{i}-{k}" for i in range(3) for k in range(30)) and {r["a b"] for r in found} == {"a\nb"}


def test_what_a_line_does_to_the_state(spark):
    lines = ["", "a,b", 'a,"b', '"', '""', '"""', 'a"b', 'a,b"', '"a""b', '"a"",b"', 'x",y', '"a",b,"', '","', 'a,"b","', '"a" ,"b']

    def after(line, state):
        first, just_closed, last = True, False, ""
        for c in line:
            if state:
                if c == '"':
                    state, just_closed = False, True
            elif c == '"' and (just_closed or first or last == ","):
                state, just_closed = True, False
            else:
                just_closed = False
            first, last = False, c
        return state

    df = spark.createDataFrame([(x,) for x in lines], "v string").select("v", quoted.turn_of(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == {x: after(x, False) + 2 * after(x, True) for x in lines}


def test_turns_are_joined_in_order():
    rng = np.random.default_rng(2)
    for _ in range(200):
        turns = rng.integers(0, 4, size=rng.integers(1, 12))
        for begin in (0, 1):
            state, states = begin, []
            for t in turns:
                state = t >> state & 1
                states.append(state)
            assert [j >> begin & 1 for j in quoted.joined(turns)] == states


def test_a_file_that_ends_within_quotes_is_refused_with_its_issues(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,2\n3,"4\n5,6,7' + "x" * 1000 + "\n")
    with pytest.raises(csv_files.CsvError) as e:
        csv_files.read_csv(spark, str(path))
    found = {(i["line"], i["type"]) for i in e.value.issues}
    assert (3, "Multiline record") in found and (4, "Wrong field count") in found
    assert all(len(i["raw_content"]) <= 300 for i in e.value.issues)


# --- Shapley values ---------------------------------------------------------------------------------------------------


def by_enumeration(value, d):
    """Shapley values of a function of sets of columns."""
    out = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for s in range(d):
            share = math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d)
            out[i] += sum(share * (value({*z, i}) - value(set(z))) for z in itertools.combinations(rest, s))
    return out


def table(spark, d, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, *(rng.gauss(0, 1) * (8 if i % 40 == 0 and c == i % d else 1) for c in range(d))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"x{c} double" for c in range(d))).repartition(3)


def columns(d):
    return [f"x{c}" for c in range(d)]


def depth_of(trees, x):
    total = 0.0
    for feature, cut, left, right, depth in trees:
        node = 0
        while feature[node] >= 0:
            node = left[node] if x[feature[node]] < cut[node] else right[node]
        total += depth[node]
    return total / len(trees)


@pytest.mark.parametrize("d", [1, 3, 6])
def test_tree_shapley_is_that_of_all_sets(spark, d):
    detector = engine.fit_detector(table(spark, d), "iforest", Settings(clip=False), columns(d), "id")
    trees = detector.model.trees.value[:5]
    rng = np.random.default_rng(d)
    x, background = rng.normal(size=(3, d)) * 2, rng.normal(size=(4, d))
    for row, found in zip(x, explain.tree_shapley(trees, x, background)):
        value = lambda z: np.mean([depth_of(trees, [row[c] if c in z else b[c] for c in range(d)]) for b in background])  # noqa: B023, E731
        assert found == pytest.approx(by_enumeration(value, d), abs=1e-9)
        assert found.sum() == pytest.approx(value(set(range(d))) - value(set()), abs=1e-9)


def shares(explanations):
    return {int(r["row_index"]): {f["feature"]: f["value"] for f in r["top_features"]} for r in explanations.collect()}


def test_explained_forest_adds_up_to_the_score(spark):
    df = table(spark, 3)
    detector = engine.fit_detector(df, "iforest", Settings(), columns(3), "id")
    found = shares(engine.explained(detector, df, "id", 20))
    wide = detector.raw_scores(df)
    background = explain.background_of(wide, detector.names, ["id"])
    base = np.mean([math.log2(r["raw"]) for r in spark.createDataFrame(background.tolist(), detector.names).select(detector.model.raw(detector.names).alias("raw")).collect()])
    raw = {r["id"]: r["raw"] for r in wide.collect()}
    assert len(found) == min(20, detector.transform(df).where("is_outlier").count())
    for i, parts in found.items():
        assert sum(parts.values()) == pytest.approx(math.log2(raw[i]) - base, abs=3e-4)


@pytest.mark.parametrize("algorithm", ["lof", "ocsvm", "cblof", "ensemble"])
def test_kernel_shapley_of_all_sets_is_exact(spark, algorithm, monkeypatch):
    monkeypatch.setattr(explain, "BACKGROUND", 6)
    df, d = table(spark, 3, 120), 3
    detector = engine.fit_detector(df, algorithm, Settings(), columns(d), "id")
    found = shares(engine.explained(detector, df, "id", 3))
    wide = detector.raw_scores(df)
    background = explain.background_of(wide, detector.names, ["id"])
    rows = {r["id"]: [r[c] for c in detector.names] for r in wide.collect() if r["id"] in found}
    sets = [set(z) for s in range(d + 1) for z in itertools.combinations(range(d), s)]
    asked = [(i, k, *(row[c] if c in z else float(b[c]) for c in range(d))) for i, row in rows.items() for k, z in enumerate(sets) for b in background]
    scored = spark.createDataFrame(asked, ["i", "k", *detector.names]).select("i", "k", detector.model.raw(detector.names, F.lit(None)).alias("raw")).groupBy("i", "k").avg("raw").collect()
    value = {(r["i"], r["k"]): r[2] for r in scored}
    for i, parts in found.items():
        exact = by_enumeration(lambda z: value[i, sets.index(z)], d)  # noqa: B023
        assert [parts[f"x{c}"] for c in range(d)] == pytest.approx(exact, abs=6e-5)


def test_sampled_coalitions_add_up(spark):
    """With twelve columns not all sets take part; the values still add up, and a linear function gets its own weights."""
    plan = explain.coalitions(12, 200)
    assert len(plan) <= 200 and sum(w for _, w in plan) == pytest.approx(sum(11 / (s * (12 - s)) for s in range(1, 12)))
    assert {z for z, _ in plan if len(z) in (1, 11)} == {z for s in (1, 11) for z in itertools.combinations(range(12), s)}
    assert {z for z, _ in plan} == {tuple(i for i in range(12) if i not in z) for z, _ in plan}

    class Linear:
        def raw(self, names, key=None):
            return sum((F.col(c) * float(i + 1) for i, c in enumerate(names)), F.lit(0.0))

    df = table(spark, 12, 60)
    names = [f"x{c}" for c in range(12)]
    found = explain.explain_kernel(df.where("id < 3"), df, Linear(), "id", names, names, 3, ["id"], most=120).collect()
    means = explain.background_of(df, names, ["id"]).mean(axis=0)
    rows = {str(r["id"]): r for r in df.where("id < 3").collect()}
    for r in found:
        exact = {f"x{c}": (c + 1) * (rows[r["row_index"]][f"x{c}"] - means[c]) for c in range(12)}
        top = sorted(exact, key=lambda c: -abs(exact[c]))[:3]
        assert [f["feature"] for f in r["top_features"]] == top and [f["value"] for f in r["top_features"]] == pytest.approx([exact[c] for c in top], abs=1e-3)


# --- streams ----------------------------------------------------------------------------------------------------------


def stream_files(spark, folder, first, last):
    rng = random.Random(11)
    for i in range(last):
        rows = [(i * 100 + k, rng.gauss(0, 1), rng.gauss(5, 2), rng.choice("ab")) for k in range(100)]
        if i >= first:
            spark.createDataFrame(rows, "id long, x double, y double, kind string").coalesce(1).write.mode("append").parquet(str(folder))


def same(a, b):
    return a.steps == b.steps and np.allclose(a.weights, b.weights, atol=1e-12) and math.isclose(a.offset, b.offset, abs_tol=1e-9)


def test_fitting_goes_on_after_a_restart_and_a_replay(spark, tmp_path):
    schema = "id long, x double, y double, kind string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_files(spark, tmp_path / "in", 0, 2)
    first = incremental.begin(spark.read.parquet(f"{tmp_path}/in"), 0.05, ["x", "y"], ["kind"], ["id"])

    broken = StreamFitter(first)
    broken.start(stream(), f"{tmp_path}/fit").awaitTermination()
    assert broken.model.steps == 2
    stream_files(spark, tmp_path / "in", 2, 4)
    again = StreamFitter(first)  # a new process knows the first model and the checkpoint only
    again.start(stream(), f"{tmp_path}/fit").awaitTermination()
    assert again.model.steps == 4

    whole = StreamFitter(first)
    whole.start(stream(), f"{tmp_path}/whole").awaitTermination()
    assert same(again.model, whole.model)

    # a failure between the model and the commit of its epoch: Spark hands out the epoch again
    for name in ("3", ".3.crc"):
        if os.path.exists(f"{tmp_path}/fit/commits/{name}"):
            os.remove(f"{tmp_path}/fit/commits/{name}")
    replayed = StreamFitter(first)
    replayed.start(stream(), f"{tmp_path}/fit").awaitTermination()
    assert same(replayed.model, whole.model)


def test_a_half_written_epoch_does_not_count(spark, tmp_path):
    store = EpochStore(spark, f"{tmp_path}/model")
    assert store.epochs() == []
    for e in range(5):
        store.save(e, {"n": e})
    assert store.epochs() == [2, 3, 4] and store.load(4) == {"n": 4}
    os.remove(f"{tmp_path}/model/epoch=000000000004/_SUCCESS")
    assert store.epochs() == [2, 3]
    store.save(4, {"n": 5})
    assert store.load(4) == {"n": 5}
