"""Every engine query with SQL against DuckDB, and the others against what they promise."""

import functools
import os

import pytest

from farstray import queries
from farstray.config import Settings
from farstray.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents conversations labels embeddings".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(rows):
    out = []
    for row in rows:
        cells = [round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row]
        out.append(tuple(str(c) for c in cells))
    return sorted(out)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", SF])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    expected = con.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(found.select(*columns).collect()) == plain(expected.select(quoted).fetchall())


@pytest.mark.parametrize("name", ["iforest_outliers", "lof_outliers", "cblof_outliers", "ocsvm_outliers", "ensemble_outliers", "incremental_outliers"])
def test_detectors_score_every_part(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count()
    assert all(0 <= r["anomaly_score"] <= 1 for r in rows) and 0 < sum(r["is_outlier"] for r in rows) < len(rows) / 3


def test_lof_outliers_take_neighbours_from_all_parts(spark, monkeypatch):
    """Whatever bound there is on a model's reference rows."""
    monkeypatch.setattr(queries, "Settings", functools.partial(Settings, lof_reference_rows=100, global_sample_rows=1000))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    found = QUERIES["lof_outliers"](spark, SF).select("anomaly_score", "is_outlier", "p_partkey").collect()
    assert plain(found) == plain(con.sql(f"SELECT anomaly_score, is_outlier, p_partkey FROM ({ORACLES['lof_outliers']})").fetchall())


def test_forest_explains_as_many_rows_as_the_settings_say(spark):
    flagged = QUERIES["iforest_outliers"](spark, SF).where("is_outlier").count()
    assert flagged > 20 and QUERIES["explain_iforest_shapley"](spark, SF).select("row_index").distinct().count() == min(flagged, 100)
