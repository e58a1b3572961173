"""What a client gets: a rounded profile, a whole summary, and the issues of a file that can't be read."""

import json

from farstray.operators.profile import profile
from farstray.plans import cli
from farstray.sources import lines, results


def test_profile_is_rounded_and_says_whether_it_is_of_a_sample(spark):
    df = spark.createDataFrame([(i, i / 3 + 0.123456789, None if i % 3 else "a") for i in range(60)], "id long, x double, kind string")
    whole, part = profile(df, size_mb=1.23456).report(), profile(df, true_rows=1000).report()
    assert (whole["rows"], whole["sample_rows"], whole["stats_are_sampled"], whole["size_mb"]) == (60, 60, False, 1.23)
    assert (part["rows"], part["sample_rows"], part["stats_are_sampled"]) == (1000, 60, True)
    x = whole["details"]["x"]
    assert x["mean"] == 9.9568 and x["std"] == round(x["std"], 4) and x["min"] == 0.123456789
    assert whole["null_pct"] == 22.22 and whole["details"]["kind"]["null_pct"] == 66.67 and whole["details"]["kind"]["cardinality_ratio"] == 0.0333
    json.dumps(whole)


def test_summary_has_time_and_place(spark, tmp_path):
    df = spark.createDataFrame([(1, True, False), (2, False, True), (3, True, True)], "id long, is_outlier boolean, is_cat_outlier boolean")
    out = results.write_scored(df, f"{tmp_path}/out.parquet")
    assert (out["total_rows"], out["combined_outliers"], out["numeric_pct"]) == (3, 3, 66.67)
    assert out["output_path"] == f"{tmp_path}/out.parquet" and out["runtime_seconds"] >= 0


def test_the_command_line_returns_the_issues_of_a_broken_file(spark, tmp_path, capsys):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,2\n3,"4\n')
    assert cli.main(["-i", str(path), "--output-path", str(tmp_path / "o.parquet")], spark) == 2
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert "quotes" in found["error"] and [i["line"] for i in found["issues"]] == [3]


def test_the_command_line_prints_the_whole_summary(spark, tmp_path, capsys):
    path = tmp_path / "x.csv"
    path.write_text("id,x\n" + "".join(f"{i},{i % 7 + (900 if i == 50 else 0)}\n" for i in range(100)))
    assert cli.main(["-i", str(path), "--output-path", str(tmp_path / "o.parquet"), "--key", "id", "--algorithm", "hbos", "--answer"], spark) == 0
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found["summary"]["output_path"].endswith("o.parquet") and found["summary"]["runtime_seconds"] > 0
    assert found["profile"]["stats_are_sampled"] is False and found["profile"]["details"]["x"]["median"] == 3.0


def test_a_line_that_the_parser_gives_up_on_is_a_parse_error(spark):
    long = "x" * 200_000  # above the parser's limit of a field
    rows = [(1, "a,b"), (2, f"1,{long}"), (3, "1,2")]
    found = lines.validate_lines(spark.createDataFrame(rows, "line long, value string")).collect()
    assert [(r["line"], r["type"]) for r in found] == [(2, lines.PARSE)] and len(found[0]["raw_content"]) == 200_002
