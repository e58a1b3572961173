"""The registered queries of the engine, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farstray.config import Settings
from farstray.functions import columns as C
from farstray.functions import ordered
from farstray.functions.checkpoints import shared_folder
from farstray.functions.quantiles import exact_quantiles
from farstray.functions.sampling import uniform_sample
from farstray.operators import categorical, explain, features, hbos, incremental, lof, planted, profile, scoring, vectors, zscore_iqr
from farstray.plans import engine, route
from farstray.sources import csv_files, lines
from farstray.streaming.score import StreamFitter

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *keep: str, places: int = 4) -> DataFrame:
    return df.select(*(c if c in keep else (F.round(F.col(c), places) + F.lit(0.0)).alias(c) for c in df.columns))


# --- profiles ---------------------------------------------------------------------------------------------------------

_MOMENTS = """
    SELECT '{c}' AS "column", count(x) AS n, round(avg(x), 4) + 0.0 AS mean, round(quantile_cont(x, 0.5), 4) + 0.0 AS median,
           round(stddev_pop(x), 4) + 0.0 AS std, round(min(x), 4) + 0.0 AS min, round(max(x), 4) + 0.0 AS max,
           round(quantile_cont(x, 0.25), 4) + 0.0 AS q1, round(quantile_cont(x, 0.75), 4) + 0.0 AS q3,
           round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) + 0.0 AS iqr,
           round(avg(pow(x - m, 3)) / pow(stddev_pop(x), 3), 4) + 0.0 AS skewness,
           round(avg(pow(x - m, 4)) / pow(stddev_pop(x), 4) - 3, 4) + 0.0 AS kurtosis
    FROM (SELECT CAST({c} AS DOUBLE) AS x, (SELECT avg({c}) FROM {t}) AS m FROM {t})"""


@query(" UNION ALL ".join(_MOMENTS.format(c=c, t=t) for t, c in (("events", "value"), ("part", "p_size"), ("part", "p_retailprice"), ("customer", "c_acctbal"))))
def profile_numeric(spark, sf_dir):
    out = profile.numeric_profile(table(spark, sf_dir, "events"), ["value"])
    out = out.unionByName(profile.numeric_profile(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))
    return out.unionByName(profile.numeric_profile(table(spark, sf_dir, "customer"), ["c_acctbal"]))


@query(" UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) - count(x) AS nulls, count(DISTINCT x) + CAST(max(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique,
           count(*) AS rows, round((count(DISTINCT x) + max(CASE WHEN x IS NULL THEN 1 ELSE 0 END)) / count(*), 4) AS cardinality_ratio
    FROM (SELECT CASE WHEN l_orderkey % {k} <> 0 THEN {c} END AS x FROM lineitem)""" for c, k in (("l_quantity", 7), ("l_returnflag", 5), ("l_suppkey", 1_000_000_007))))
def profile_nulls_unique(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    df = df.select(*(F.when(F.col("l_orderkey") % k != 0, F.col(c)).alias(c) for c, k in (("l_quantity", 7), ("l_returnflag", 5), ("l_suppkey", 1_000_000_007))))
    return profile.null_counts(df)


@query(" UNION ALL ".join(f"""
    SELECT * FROM (
        SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank, {c} AS value, count(*) AS count,
               round(100.0 * count(*) / (SELECT count(*) FROM {t}), 2) AS pct FROM {t} GROUP BY {c}) WHERE rank <= 5""" for t, c in (("documents", "source"), ("conversations", "role"))))
def profile_top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "documents"), ["source"]).unionByName(profile.top_values(table(spark, sf_dir, "conversations"), ["role"]))


@query(" UNION ALL ".join([
    f"""SELECT '{c}' AS "column" FROM {t} HAVING count(DISTINCT {c}) = count(*) AND max({c}) - min({c}) = count(*) - 1""" for t, c in (("customer", "c_custkey"), ("customer", "c_nationkey"), ("part", "p_partkey"), ("part", "p_size"))
] + [
    f"""SELECT '{c}' AS "column" FROM {t} HAVING count(DISTINCT {c}) > greatest(10, 0.5 * count(*))""" for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"))
]))
def id_columns(spark, sf_dir):
    found = [c for t in ("customer", "part") for c in profile.profile(table(spark, sf_dir, t)).ids]
    return spark.createDataFrame([(c,) for c in found], "column string")


_PROFILED = {"part": ("p_partkey", "p_size", "p_retailprice"), "supplier": ("s_suppkey", "s_nationkey", "s_acctbal"), "customer": ("c_custkey", "c_nationkey", "c_acctbal")}
_SKEW = "abs(avg(pow(CAST({c} AS DOUBLE) - m{i}, 3)) / pow(stddev_pop({c}), 3))"


def _quality_sql(t: str, columns: tuple[str, ...]) -> str:
    means = ", ".join(f"avg({c}) OVER () AS m{i}" for i, c in enumerate(columns))
    skew = " + ".join(f"coalesce({_SKEW.format(c=c, i=i)}, 0)" for i, c in enumerate(columns))
    return f"""
        SELECT '{t}' AS "table", n AS rows, CAST(100 - CASE WHEN n < 50 THEN 20 WHEN n < 500 THEN 10 ELSE 0 END - CASE WHEN s > 5 THEN 15 WHEN s > 2 THEN 5 ELSE 0 END AS INTEGER) AS quality,
               CASE WHEN n > 1000000 THEN 'hbos' WHEN s > 5 THEN 'lof' ELSE 'iforest' END AS algorithm
        FROM (SELECT count(*) AS n, ({skew}) / {len(columns)} AS s FROM (SELECT *, {means} FROM {t}))"""


@query(" UNION ALL ".join(_quality_sql(t, c) for t, c in _PROFILED.items()))
def quality_and_route(spark, sf_dir):
    rows = []
    for t in _PROFILED:
        p = profile.profile(table(spark, sf_dir, t))
        rows.append((t, p.rows, p.quality, route.choose_algorithm(p)))
    return spark.createDataFrame(rows, "table string, rows long, quality int, algorithm string")


@query("""
    SELECT size_mb, rows, dims, skew, CASE WHEN size_mb > 500 THEN 'incremental' WHEN rows > 1000000 THEN 'hbos' WHEN dims > 50 THEN 'iforest' WHEN skew > 5 THEN 'lof' ELSE 'iforest' END AS algorithm
    FROM (SELECT CAST(p_size * 20 AS DOUBLE) AS size_mb, CAST(p_partkey * 900 AS BIGINT) AS rows, CAST(p_size + 5 AS INTEGER) AS dims, p_retailprice / 200 AS skew FROM part)""")
def route_algorithm(spark, sf_dir):
    df = table(spark, sf_dir, "part").select((F.col("p_size") * 20).cast("double").alias("size_mb"), (F.col("p_partkey") * 900).alias("rows"), (F.col("p_size") + 5).cast("int").alias("dims"), (F.col("p_retailprice") / 200).alias("skew"))
    return df.withColumn("algorithm", route.route_column(F.col("size_mb"), F.col("rows"), F.col("dims"), F.col("skew")))


# --- features ---------------------------------------------------------------------------------------------------------

@query("""
    SELECT o_orderkey, try_cast(left(o_orderpriority, 1) AS DOUBLE) AS priority,
           lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS padded, o_orderstatus AS status FROM orders""")
def cast_numeric_strings(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("priority"), F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("padded"), F.col("o_orderstatus").alias("status"))
    return features.cast_numeric_strings(df)


def _holed(spark, sf_dir, k: int = 7) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    keep = F.col("o_orderkey") % k != 0 if k > 0 else F.col("o_orderkey") % -k == 0
    return df.select("o_orderkey", F.when(keep, F.col("o_totalprice")).alias("x"))


_HOLED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS x FROM orders)"


def _imputed(name: str, strategy: str, sql: str) -> None:
    def run(spark, sf_dir):
        return rounded(features.impute(_holed(spark, sf_dir), ["x"], strategy), "o_orderkey")

    QUERIES[name], ORACLES[name] = run, sql


_imputed("impute_median", "median", f"SELECT o_orderkey, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM {_HOLED})), 4) AS x FROM {_HOLED}")
_imputed("impute_mean", "mean", f"SELECT o_orderkey, round(coalesce(x, (SELECT avg(x) FROM {_HOLED})), 4) AS x FROM {_HOLED}")
_imputed("impute_zero", "zero", f"SELECT o_orderkey, round(coalesce(x, 0.0), 4) AS x FROM {_HOLED}")
_imputed("impute_drop", "drop", f"SELECT o_orderkey, round(x, 4) AS x FROM {_HOLED} WHERE x IS NOT NULL")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN round(o_totalprice, 4) ELSE 0.0 END AS x FROM orders")
def impute_high_null(spark, sf_dir):
    return rounded(features.impute(_holed(spark, sf_dir, -20), ["x"], "median"), "o_orderkey")


_ODD = """(SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN event_id % 13 = 0 THEN 0.0 ELSE value END AS x FROM events)"""


@query(f"""
    SELECT event_id, round(greatest(least(x, (SELECT quantile_cont(x, 0.99) FROM {_ODD})), (SELECT quantile_cont(x, 0.01) FROM {_ODD})), 4) + 0.0 AS x FROM {_ODD}""")
def sanitize_clip(spark, sf_dir):
    odd = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    df = table(spark, sf_dir, "events").select("event_id", C.sanitized(odd).alias("x"))
    low, high = exact_quantiles(df, ["x"], [0.01, 0.99])["x"]
    return rounded(df.select("event_id", C.clipped(F.col("x"), low, high).alias("x")), "event_id")


@query("SELECT 'p_size' AS kept UNION ALL SELECT 'p_retailprice'")
def drop_constant(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("same", F.lit(7.0))
    return spark.createDataFrame([(c,) for c in features.drop_constant_columns(df, ["p_size", "same", "p_retailprice"])], "kept string")


def _scaled(name: str, scaling: str, center: str, divisor: str) -> None:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
        a, b = features.fit_scale(df, ["x"], scaling, df.count())["x"]
        return rounded(df.select("c_custkey", ((F.col("x") - a) / b).alias("x")), "c_custkey")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT c_custkey, round((c_acctbal - (SELECT {center} FROM customer)) / (SELECT {divisor} FROM customer), 4) + 0.0 AS x FROM customer"


_scaled("scale_robust", "robust", "quantile_cont(c_acctbal, 0.5)", "quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)")
_scaled("scale_standard", "standard", "avg(c_acctbal)", "stddev_pop(c_acctbal)")
_scaled("scale_minmax", "minmax", "min(c_acctbal)", "max(c_acctbal) - min(c_acctbal)")

_PART = ("p_size", "p_retailprice")


def _part_features(places: int = 17) -> str:
    """CTEs up to f: p_partkey and the scaled features of part."""
    clip = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.01) AS l{i}, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS h{i}" for i, c in enumerate(_PART))
    cut = ", ".join(f"greatest(least(CAST({c} AS DOUBLE), h{i}), l{i}) AS x{i}" for i, c in enumerate(_PART))
    scale = ", ".join(f"quantile_cont(x{i}, 0.5) AS m{i}, quantile_cont(x{i}, 0.75) - quantile_cont(x{i}, 0.25) AS d{i}" for i in (0, 1))
    return f"""
        q AS (SELECT {clip} FROM part), c AS (SELECT p_partkey, {cut} FROM part, q), s AS (SELECT {scale} FROM c),
        f AS (SELECT p_partkey, (x0 - m0) / d0 AS f0, (x1 - m1) / d1 AS f1 FROM c, s)"""


_HBOS = """
        b AS (SELECT min(f0) AS lo0, (max(f0) - min(f0)) / 10 AS w0, min(f1) AS lo1, (max(f1) - min(f1)) / 10 AS w1, count(*) AS n FROM f),
        k AS (SELECT p_partkey, f0, f1, least(CAST(floor((f0 - lo0) / w0) AS INTEGER), 9) AS b0, least(CAST(floor((f1 - lo1) / w1) AS INTEGER), 9) AS b1 FROM f, b),
        c0 AS (SELECT b0, count(*) / (any_value(n) * any_value(w0)) AS d0 FROM k, b GROUP BY b0), c1 AS (SELECT b1, count(*) / (any_value(n) * any_value(w1)) AS d1 FROM k, b GROUP BY b1),
        p AS (SELECT p_partkey, f0, f1, -log2(d0 + 0.1) AS s0, -log2(d1 + 0.1) AS s1 FROM k JOIN c0 USING (b0) JOIN c1 USING (b1)),
        r AS (SELECT *, round(s0 + s1, 10) AS raw FROM p), t AS (SELECT min(raw) AS lo, max(raw) AS hi, quantile_cont(raw, 0.95) AS cut FROM r)"""


@query(f"WITH {_part_features()} SELECT p_partkey, round(f0, 4) + 0.0 AS f_p_size, round(f1, 4) + 0.0 AS f_p_retailprice FROM f")
def prepare_matrix(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return rounded(features.fit_features(df, list(_PART)).transform(df).select("p_partkey", "f_p_size", "f_p_retailprice"), "p_partkey")


@query("""
    WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    e AS (SELECT place, quantile_cont(x, 0.01) AS l, quantile_cont(x, 0.99) AS h FROM v GROUP BY place),
    c AS (SELECT vec_id, place, greatest(least(x, h), l) AS x FROM v JOIN e USING (place)),
    s AS (SELECT place, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS d FROM c GROUP BY place)
    SELECT vec_id, CAST(place AS INTEGER) AS place, round((x - m) / d, 4) + 0.0 AS feature FROM c JOIN s USING (place)""")
def prepare_vectors(spark, sf_dir):
    """The scaled features of a column of arrays, place by place."""
    df = table(spark, sf_dir, "embeddings")
    model = vectors.fit_vectors(df, ["embedding"])
    return model.transform(df).select("vec_id", F.posexplode("f_vector").alias("place", "x")).select("vec_id", "place", (F.round("x", 4) + F.lit(0.0)).alias("feature"))


# --- scores and detectors ---------------------------------------------------------------------------------------------

@query("""
    SELECT event_id, value >= (SELECT quantile_cont(value, 0.95) FROM events) AS is_outlier,
           round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 4) + 0.0 AS anomaly_score FROM events""")
def threshold_and_normalise(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("raw"))
    return scoring.flagged(df, scoring.fit_bounds(df, 0.05)).select("event_id", "is_outlier", "anomaly_score")


def _detector(spark, sf_dir, algorithm: str, t: str = "part", names=_PART, key: str = "p_partkey", **settings):
    df = table(spark, sf_dir, t)
    return df, engine.fit_detector(df, algorithm, Settings(**settings), list(names), key)


@query(f"WITH {_part_features()}, {_HBOS} SELECT p_partkey, round(raw, 4) + 0.0 AS raw FROM r")
def hbos_scores(spark, sf_dir):
    df, d = _detector(spark, sf_dir, "hbos")
    return rounded(d.raw_scores(df).select("p_partkey", "raw"), "p_partkey")


@query(f"WITH {_part_features()}, {_HBOS} SELECT p_partkey, round((raw - lo) / (hi - lo), 4) + 0.0 AS anomaly_score, raw >= cut AS is_outlier FROM r, t")
def hbos_outliers(spark, sf_dir):
    df, d = _detector(spark, sf_dir, "hbos")
    return d.transform(df).select("p_partkey", "anomaly_score", "is_outlier")


_LOF = """
    WITH d AS (
        SELECT a.c_custkey AS i, b.c_custkey AS j, sqrt((a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal)) AS d
        FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey
    ), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, CAST(j AS VARCHAR)) <= 20),
    far AS (SELECT i, max(d) AS kd FROM k GROUP BY i),
    den AS (SELECT k.i, 1 / (avg(greatest(k.d, far.kd)) + 1e-10) AS den FROM k JOIN far ON far.i = k.j GROUP BY k.i)
    SELECT k.i AS c_custkey, round(avg(o.den) / any_value(m.den), 4) + 0.0 AS lof FROM k JOIN den o ON o.i = k.j JOIN den m ON m.i = k.i GROUP BY k.i"""


@query(None)
def lof_scores(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return lof.exact_lof(df, ["c_acctbal"], "c_custkey").select("c_custkey", (F.round("lof", 4) + F.lit(0.0)).alias("lof"))


ORACLES["lof_scores"] = _LOF


def _by_algorithm(algorithm: str):
    def run(spark, sf_dir):
        df, d = _detector(spark, sf_dir, algorithm)
        return d.transform(df).select("p_partkey", "anomaly_score", "is_outlier")

    QUERIES[f"{algorithm}_outliers"] = run


for _a in ("iforest", "cblof", "ocsvm", "ensemble", "incremental"):
    _by_algorithm(_a)

_LOF_OF_F = """
    k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, CAST(j AS VARCHAR)) <= 20),
    far AS (SELECT i, max(d) AS kd FROM k GROUP BY i),
    den AS (SELECT k.i, 1 / (avg(greatest(k.d, far.kd)) + 1e-10) AS den FROM k JOIN far ON far.i = k.j GROUP BY k.i),
    r AS (SELECT k.i AS p_partkey, round(avg(o.den) / any_value(m.den), 10) AS raw FROM k JOIN den o ON o.i = k.j JOIN den m ON m.i = k.i GROUP BY k.i),
    t AS (SELECT min(raw) AS lo, max(raw) AS hi, quantile_cont(raw, 0.95) AS cut FROM r)
    SELECT p_partkey, round((raw - lo) / (hi - lo), 4) + 0.0 AS anomaly_score, raw >= cut AS is_outlier FROM r, t"""


@query(f"""
    WITH {_part_features()},
    d AS (SELECT a.p_partkey AS i, b.p_partkey AS j, sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)) AS d FROM f a JOIN f b ON b.p_partkey <> a.p_partkey),""" + _LOF_OF_F)
def lof_outliers(spark, sf_dir):
    """Every part's neighbours are looked up among all parts."""
    return engine.lof_of_all(table(spark, sf_dir, "part"), Settings(), list(_PART), "p_partkey").select("p_partkey", "anomaly_score", "is_outlier")


#: Neighbours are looked up among the first rows in the order of the sample's hash, as many as the settings say.
_LOF_OF_REFERENCE = f"""
    WITH {_part_features()},
    ref AS (SELECT p_partkey AS j, f0 AS b0, f1 AS b1 FROM f ORDER BY md5(CAST(p_partkey AS VARCHAR)), CAST(p_partkey AS VARCHAR) LIMIT {Settings().lof_reference_rows}),
    d AS (SELECT p_partkey AS i, j, sqrt((f0 - b0) * (f0 - b0) + (f1 - b1) * (f1 - b1)) AS d FROM f JOIN ref ON j <> p_partkey),""" + _LOF_OF_F


@query("""
    WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM events),
    o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM events),
    q AS (SELECT (SELECT value FROM o, s WHERE i = floor(n * 0.25)) AS q1, (SELECT value FROM o, s WHERE i = floor(n * 0.75)) AS q3),
    r AS (SELECT event_id, round(0.6 * (abs(value - m) / sd) + 0.4 * (greatest(q1 - 1.5 * (q3 - q1) - value, value - (q3 + 1.5 * (q3 - q1)), 0.0) / (q3 - q1)), 10) AS raw FROM events, s, q),
    ro AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS i FROM r),
    t AS (SELECT min(raw) AS lo, max(raw) AS hi, (SELECT raw FROM ro, s WHERE i = CAST(floor(n * 0.95) AS BIGINT)) AS cut FROM r)
    SELECT event_id, round((raw - lo) / (hi - lo), 4) + 0.0 AS anomaly_score, raw >= cut AS is_outlier FROM r, t""")
def zscore_iqr_outliers(spark, sf_dir):
    return zscore_iqr.zscore_iqr(table(spark, sf_dir, "events"), ["value"]).select("event_id", "anomaly_score", "is_outlier")


ORACLES["score_histogram"] = f"SELECT CAST(least(floor(anomaly_score * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM ({ORACLES['zscore_iqr_outliers']}) GROUP BY 1"


@query(ORACLES["score_histogram"])
def score_histogram(spark, sf_dir):
    return scoring.score_histogram(zscore_iqr_outliers(spark, sf_dir))


# --- categories -------------------------------------------------------------------------------------------------------

@query("""SELECT 'role' AS "column", role AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM conversations), 6) AS freq FROM conversations GROUP BY role""")
def cat_freq_two_pass(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    return categorical.frequencies(categorical.value_counts(df, ["role"]), ["role"], df.count()).withColumn("freq", F.round("freq", 6))


@query("""
    WITH s AS (SELECT role FROM conversations ORDER BY md5(CAST(conv_id AS VARCHAR) || chr(1) || CAST(turn AS VARCHAR)), CAST(conv_id AS VARCHAR) || chr(1) || CAST(turn AS VARCHAR) LIMIT 200)
    SELECT 'role' AS "column", role AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS freq FROM s GROUP BY role""")
def cat_freq_single_pass(spark, sf_dir):
    return categorical.sample_frequencies(table(spark, sf_dir, "conversations"), ["role"], 200, ["conv_id", "turn"]).withColumn("freq", F.round("freq", 6))


def _rare_sql(source: str, key: str, value: str, threshold: float) -> str:
    return f"""
        WITH d AS (SELECT {key}, {value} AS v FROM {source}), n AS (SELECT count(*) AS n FROM d),
        f AS (SELECT v, count(*) / any_value(n) AS f FROM d, n WHERE v IS NOT NULL GROUP BY v),
        s AS (SELECT min(f) AS lo, max(f) AS hi, count(*) AS k, count(*) + (SELECT CAST(count(*) > 0 AS INTEGER) FROM d WHERE v IS NULL) <= greatest(10, floor((SELECT n FROM n) * 0.1)) AS ok FROM f)
        SELECT {key}, CASE WHEN NOT ok OR v IS NULL OR hi = lo THEN 0.0 ELSE round((hi - f) / (hi - lo), 4) + 0.0 END AS cat_anomaly_score,
               ok AND v IS NOT NULL AND f < least({threshold}, 0.3 / k) AS is_cat_outlier
        FROM d LEFT JOIN f USING (v), s"""


@query(_rare_sql("conversations", "conv_id, turn", "role", 0.05))
def cat_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return categorical.rare_categories(df, ["role"], threshold=0.05).select("conv_id", "turn", "cat_anomaly_score", "is_cat_outlier")


@query(_rare_sql("documents", "doc_id", "CASE WHEN doc_id % 7 <> 0 THEN lang || '/' || source END", 0.01))
def cat_outliers_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.concat_ws("/", "lang", "source")).alias("kind"))
    return categorical.rare_categories(df, ["kind"]).select("doc_id", "cat_anomaly_score", "is_cat_outlier")


_DOCS_Z = ORACLES["zscore_iqr_outliers"].replace("event_id", "doc_id").replace("value", "n_chars").replace("events", "documents")
_DOCS_RARE = _rare_sql("documents", "doc_id", "lang || '/' || source", 0.01)


def _scored_documents(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.concat_ws("/", "lang", "source").alias("kind"))
    return categorical.rare_categories(zscore_iqr.zscore_iqr(df, ["n_chars"]), ["kind"])


@query(f"""
    SELECT count(*) AS total_rows, count(*) FILTER (is_outlier) AS numeric_outliers, count(*) FILTER (is_cat_outlier) AS categorical_outliers,
           count(*) FILTER (is_outlier OR is_cat_outlier) AS combined_outliers, round(100.0 * count(*) FILTER (is_outlier) / count(*), 2) AS numeric_pct,
           round(100.0 * count(*) FILTER (is_cat_outlier) / count(*), 2) AS categorical_pct, round(100.0 * count(*) FILTER (is_outlier OR is_cat_outlier) / count(*), 2) AS combined_pct,
           'zscore_iqr' AS algorithm
    FROM ({_DOCS_Z}) JOIN ({_DOCS_RARE}) USING (doc_id)""")
def detection_summary(spark, sf_dir):
    return scoring.summary(_scored_documents(spark, sf_dir), "zscore_iqr")


@query(f"""
    SELECT doc_id, n_chars, anomaly_score, is_outlier, cat_anomaly_score, is_cat_outlier
    FROM documents JOIN ({_DOCS_Z}) USING (doc_id) JOIN ({_DOCS_RARE}) USING (doc_id) WHERE is_outlier OR is_cat_outlier ORDER BY doc_id LIMIT 500""")
def top_outliers(spark, sf_dir):
    return scoring.top_outliers(_scored_documents(spark, sf_dir).drop("kind"), "doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR) LIMIT 500")
def uniform_sample_rows(spark, sf_dir):
    return uniform_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 500, ["o_orderkey"])


@query("SELECT o_orderkey, 0.0::DOUBLE AS anomaly_score, false AS is_outlier, 0.0::DOUBLE AS cat_anomaly_score, false AS is_cat_outlier FROM orders")
def datetime_passthrough(spark, sf_dir):
    found = engine.detect(table(spark, sf_dir, "orders"), key="o_orderkey").scored
    return found.select("o_orderkey", "anomaly_score", "is_outlier", "cat_anomaly_score", "is_cat_outlier")


# --- explanations, lines, quality of detection ------------------------------------------------------------------------

def _flat(explanations: DataFrame) -> DataFrame:
    return explanations.select("row_index", "method", F.posexplode("top_features").alias("place", "f")).select("row_index", "method", "place", "f.*")


_TOP = """
    SELECT row_index, '{m}' AS method, CAST(place AS INTEGER) AS place, feature, value, actual_value, median_value FROM (
        SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY abs(value) DESC, i DESC) - 1 AS place FROM (
            SELECT CAST(p_partkey AS VARCHAR) AS row_index, 0 AS i, 'p_size' AS feature, round({v0}, 4) + 0.0 AS value, round(f0, 4) + 0.0 AS actual_value, round(a0, 4) + 0.0 AS median_value FROM e
            UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, 'p_retailprice', round({v1}, 4) + 0.0, round(f1, 4) + 0.0, round(a1, 4) + 0.0 FROM e)) WHERE place < 3"""
_EXPLAINED = f"""
    WITH {_part_features()}, {_HBOS},
    g AS (SELECT quantile_cont(f0, 0.5) AS a0, quantile_cont(f1, 0.5) AS a1, stddev_pop(f0) AS e0, stddev_pop(f1) AS e1, avg(s0) AS g0, avg(s1) AS g1 FROM p),
    e AS (SELECT * FROM r, t, g WHERE raw >= cut ORDER BY p_partkey LIMIT 100)"""


def _explained_parts(spark, sf_dir):
    df, d = _detector(spark, sf_dir, "hbos")
    return d.features.transform(df), d.features.transform(d.transform(df).where("is_outlier")), d


@query(_EXPLAINED + _TOP.format(m="zscore_fallback", v0="abs(f0 - a0) / e0", v1="abs(f1 - a1) / e1"))
def explain_zscore(spark, sf_dir):
    everything, flagged, d = _explained_parts(spark, sf_dir)
    return _flat(explain.explain_zscore(flagged, everything, "p_partkey", list(_PART), d.names))


@query(_EXPLAINED + _TOP.format(m="shap", v0="s0 - g0", v1="s1 - g1"))
def explain_hbos_shapley(spark, sf_dir):
    everything, flagged, d = _explained_parts(spark, sf_dir)
    return _flat(explain.explain_hbos(flagged, everything, d.model, "p_partkey", list(_PART), d.names))


@query(None)
def explain_iforest_shapley(spark, sf_dir):
    df, d = _detector(spark, sf_dir, "iforest")
    return _flat(engine.explained(d, df, "p_partkey", Settings().max_explain_rows))


#: Values of sets of columns: the mean factor over the background rows with the set's columns taken from the explained row.
ORACLES["explain_lof_shapley"] = f"""
    WITH {_part_features()},
    ref AS (SELECT p_partkey AS j, f0 AS b0, f1 AS b1 FROM f ORDER BY md5(CAST(p_partkey AS VARCHAR)), CAST(p_partkey AS VARCHAR) LIMIT {Settings().lof_reference_rows}),
    dr AS (SELECT a.j AS i, b.j AS j, sqrt((a.b0 - b.b0) * (a.b0 - b.b0) + (a.b1 - b.b1) * (a.b1 - b.b1)) AS d FROM ref a JOIN ref b ON a.j <> b.j),
    kr AS (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, CAST(j AS VARCHAR)) <= 20),
    far AS (SELECT i, max(d) AS kd FROM kr GROUP BY i),
    den AS (SELECT kr.i, 1 / (avg(greatest(kr.d, far.kd)) + 1e-10) AS den FROM kr JOIN far ON far.i = kr.j GROUP BY kr.i),
    bg AS (SELECT f0 AS g0, f1 AS g1 FROM f ORDER BY md5(CAST(p_partkey AS VARCHAR)), CAST(p_partkey AS VARCHAR) LIMIT 100),
    e AS (SELECT f.* FROM f JOIN ({_LOF_OF_REFERENCE}) o USING (p_partkey) WHERE o.is_outlier ORDER BY p_partkey LIMIT 100),
    m AS (SELECT p_partkey, 0 AS z, g0 AS x0, g1 AS x1 FROM e, bg UNION ALL SELECT p_partkey, 1, f0, g1 FROM e, bg UNION ALL SELECT p_partkey, 2, g0, f1 FROM e, bg UNION ALL SELECT p_partkey, 3, f0, f1 FROM e),
    p AS (SELECT row_number() OVER () AS id, x0, x1 FROM (SELECT DISTINCT x0, x1 FROM m)),
    k AS (SELECT id, j, sqrt((x0 - b0) * (x0 - b0) + (x1 - b1) * (x1 - b1)) AS d FROM p, ref QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt((x0 - b0) * (x0 - b0) + (x1 - b1) * (x1 - b1)), CAST(j AS VARCHAR)) <= 20),
    r AS (SELECT k.id, round(avg(den) * (avg(greatest(k.d, kd)) + 1e-10), 10) AS raw FROM k JOIN far ON far.i = k.j JOIN den ON den.i = k.j GROUP BY k.id),
    v AS (SELECT p_partkey, avg(raw) FILTER (z = 0) AS v0, avg(raw) FILTER (z = 1) AS v1, avg(raw) FILTER (z = 2) AS v2, avg(raw) FILTER (z = 3) AS v3 FROM m JOIN p USING (x0, x1) JOIN r USING (id) GROUP BY p_partkey),
    a AS (SELECT quantile_cont(f0, 0.5) AS a0, quantile_cont(f1, 0.5) AS a1 FROM f),
    sh AS (SELECT e.*, a.*, (v1 - v0 + v3 - v2) / 2 AS s0, (v2 - v0 + v3 - v1) / 2 AS s1 FROM e JOIN v USING (p_partkey), a)""" + _TOP.format(m="shap", v0="s0", v1="s1").replace("FROM e)", "FROM sh)").replace("FROM e\n", "FROM sh\n")


@query(ORACLES["explain_lof_shapley"])
def explain_lof_shapley(spark, sf_dir):
    """Kernel SHAP of the LOF detector: both columns' shares of the factor of the first flagged parts."""
    df, d = _detector(spark, sf_dir, "lof")
    return _flat(engine.explained(d, df, "p_partkey", Settings().max_explain_rows))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents""")
def csv_multiline_rows(spark, sf_dir):
    """Documents written as CSV, texts with their line breaks within quotes, and read again by as many tasks as the files have pieces."""
    path = shared_folder(spark, "documents") + "/rows.csv"
    table(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    text = F.coalesce("text", F.lit(""))
    return csv_files.read_csv(spark, path).select("doc_id", "lang", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


@query(None)
def stream_fit_outliers(spark, sf_dir):
    """Events as a stream of micro-batches that fit the incremental model, then scored by it."""
    path = f"{sf_dir}/events.parquet"
    df = spark.read.parquet(path)
    first = incremental.begin(df, Settings().contamination, ["value"], ["event_type"], ["event_id"])
    fitter = StreamFitter(first)
    stream = spark.readStream.schema(df.schema).parquet(f"{path}*")  # a pattern may be a file or a folder
    fitter.start(stream, shared_folder(spark, "events")).awaitTermination()
    raw = df.withColumn("raw", fitter.model.raw())
    return scoring.flagged(raw, scoring.fit_bounds(raw.select("raw"), Settings().contamination)).select("event_id", "anomaly_score", "is_outlier")


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(replace(text, 'th', '"'), chr(10))) AS v FROM documents),
    c AS (SELECT doc_id, CASE WHEN (length(v) - length(replace(v, '"', ''))) % 2 = 1 THEN 'Multiline record' END AS a,
                 CASE WHEN contains(v, '""') THEN 'Broken quoted field' END AS b, CASE WHEN contains(v, chr(0)) THEN 'NULL byte' END AS z FROM l)
    SELECT doc_id, type, count(*) AS n FROM (SELECT doc_id, unnest([a, b, z]) AS type FROM c) WHERE type IS NOT NULL GROUP BY doc_id, type""")
def csv_line_checks(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("th"), F.lit('"')), "\n")).alias("value"))
    found = df.select("doc_id", F.explode(lines.quote_checks(F.col("value"))).alias("x"))
    return found.groupBy("doc_id", "x.type").agg(F.count("*").alias("n"))


@query("""
    WITH t AS (
        SELECT CASE WHEN k = 1 THEN [] WHEN k % 10 = 0 THEN ['Wrong field count'] WHEN k % 11 = 0 THEN ['Multiline record', 'Invalid quoting']
                    WHEN k % 13 = 0 THEN ['Broken quoted field', 'Invalid quoting'] WHEN k % 17 = 0 THEN ['NULL byte'] ELSE [] END AS types FROM (SELECT c_custkey + 1 AS k FROM customer))
    SELECT type, count(*) AS n FROM (SELECT unnest(types) AS type FROM t) GROUP BY type""")
def csv_lines_validated(spark, sf_dir):
    """The line validator on customers written as CSV lines, some of them broken in a way that their key tells."""
    k, name, segment = F.col("c_custkey") + 1, F.translate("c_name", '"', ""), F.translate("c_mktsegment", '"', "")
    broken = (
        F.when(k == 1, F.concat_ws(",", k.cast("string"), name, segment))
        .when(k % 10 == 0, F.concat_ws(",", k.cast("string"), name, segment, F.lit("more")))
        .when(k % 11 == 0, F.concat_ws(",", k.cast("string"), F.concat(name, F.lit('"x')), segment))
        .when(k % 13 == 0, F.concat_ws(",", k.cast("string"), F.concat(F.lit('"a""'), name, F.lit('"')), segment))
        .when(k % 17 == 0, F.concat_ws(",", k.cast("string"), F.concat(name, F.lit("\0")), segment))
    )
    rows = table(spark, sf_dir, "customer").select(k.alias("line"), F.coalesce(broken, F.concat_ws(",", k.cast("string"), name, segment)).alias("value"))
    return lines.validate_lines(rows).groupBy("type").agg(F.count("*").alias("n"))


@query("""
    WITH c AS (SELECT n_chars > 2000 AS f, toxic = 1 AS t FROM documents JOIN labels USING (doc_id)),
    k AS (SELECT count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (NOT f AND t) AS fn, count(*) FILTER (NOT f AND NOT t) AS tn FROM c)
    SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1 FROM k""")
def precision_recall(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return scoring.precision_recall(joined, F.col("n_chars") > 2000, F.col("toxic") == 1)


#: A table with planted outliers: kind, and the number changed as the kind says.
_HASH = "CAST(concat('0x', substr(md5(concat('{salt}:', CAST(o_orderkey AS VARCHAR))), 1, 7)) AS BIGINT)"
_PLANTED = f"""
    SELECT o_orderkey, kind, CASE kind WHEN 'point_moved' THEN v * 100 WHEN 'sign_turned' THEN -v WHEN 'far_out' THEN v + 1000000 WHEN 'stuck' THEN 0 ELSE v END AS value
    FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS v, CASE WHEN {_HASH.format(salt="planted")} % 1000 < 20 THEN ['{"', '".join(planted.KINDS)}'][{_HASH.format(salt="kind")} % {len(planted.KINDS)} + 1] END AS kind FROM orders)"""
_PLANTED_SCORES = ORACLES["zscore_iqr_outliers"].replace("event_id", "o_orderkey").replace("FROM events", f"FROM ({_PLANTED})")


def _planted_orders(spark, sf_dir) -> DataFrame:
    """Orders with outliers in their price, and the detector's scores."""
    df = planted.plant(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value")), ["value"], "o_orderkey")
    return zscore_iqr.zscore_iqr(df, ["value"])


@query(f"SELECT kind, count(*) AS n, count(*) FILTER (is_outlier) AS n_flagged FROM ({_PLANTED}) JOIN ({_PLANTED_SCORES}) USING (o_orderkey) WHERE kind IS NOT NULL GROUP BY kind")
def synthetic_outliers(spark, sf_dir):
    """Outliers of known kinds in a given table, and how many of each kind are found."""
    return planted.breakdown(_planted_orders(spark, sf_dir))


@query(f"""
    WITH s AS (SELECT anomaly_score AS s, kind IS NOT NULL AS t FROM ({_PLANTED}) JOIN ({_PLANTED_SCORES}) USING (o_orderkey)),
    c AS (SELECT s, count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS n FROM s GROUP BY s),
    b AS (SELECT p, n, sum(n) OVER (ORDER BY s) - n AS below FROM c)
    SELECT 'zscore_iqr' AS algorithm, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM b""")
def planted_auc(spark, sf_dir):
    """How well scores tell planted outliers from the other orders, whatever the threshold."""
    found = ordered.auc(_planted_orders(spark, sf_dir), F.col("anomaly_score"), F.col("kind").isNotNull())
    return spark.createDataFrame([("zscore_iqr", None if found is None else round(found, 6))], "algorithm string, auc double")


@query("SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey), 2) + 0.0 AS difference FROM orders")
def ordered_differences(spark, sf_dir):
    """Each order's price less that of the order before, by date."""
    df = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return ordered.first_differences(df, "o_totalprice", ["o_orderdate", "o_orderkey"]).select("o_orderkey", (F.round("difference", 2) + F.lit(0.0)).alias("difference"))


_SEQUENTIAL = """SELECT '{o}' AS row_order, '{c}' AS "column", count(d) > 0 AND count(*) FILTER (d <> 1) = 0 AS consecutive FROM (SELECT {c} - lag({c}) OVER (ORDER BY {o}, {c}) AS d FROM orders)"""


@query(" UNION ALL ".join(_SEQUENTIAL.format(o=o, c=c) for o in ("o_orderkey", "o_orderdate") for c in ("o_orderkey", "o_custkey")))
def consecutive_columns(spark, sf_dir):
    """Which keys of orders count up by one in the order of their own numbers and of their dates."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = [(o, c, v) for o in ("o_orderkey", "o_orderdate") for c, v in ordered.is_consecutive(df, ["o_orderkey", "o_custkey"], [o]).items()]
    return spark.createDataFrame(rows, "row_order string, column string, consecutive boolean")


def _several_rare_sql(source: str, key: str, values: tuple[str, ...], threshold: float = 0.01) -> str:
    """Rarities of several columns; one with too many values, as the settings say, takes no part."""
    parts, rarity, rare, joins = [], [], [], ""
    for i, v in enumerate(values):
        parts.append(f"f{i} AS (SELECT {v} AS v, count(*) / any_value(n) AS f FROM {source}, n WHERE {v} IS NOT NULL GROUP BY {v})")
        parts.append(f"s{i} AS (SELECT min(f) AS lo, max(f) AS hi, count(*) AS k, count(*) + (SELECT count(*) > 0 FROM {source} WHERE {v} IS NULL)::INT <= greatest(10, floor(any_value(n) * 0.1)) AS ok FROM f{i}, n)")
        joins += f" LEFT JOIN f{i} ON f{i}.v = {source}.{v} CROSS JOIN s{i}"
        rarity.append(f"CASE WHEN s{i}.ok AND {v} IS NOT NULL AND s{i}.hi > s{i}.lo THEN (s{i}.hi - f{i}.f) / (s{i}.hi - s{i}.lo) ELSE 0 END")
        rare.append(f"(s{i}.ok AND {v} IS NOT NULL AND f{i}.f < least({threshold}, 0.3 / s{i}.k))")
    return f"WITH n AS (SELECT count(*) AS n FROM {source}), {', '.join(parts)} SELECT {key}, round(greatest({', '.join(rarity)}), 4) + 0.0 AS cat_anomaly_score, {' OR '.join(rare)} AS is_cat_outlier FROM {source}{joins}"


@query(f"""
    SELECT p_partkey, anomaly_score, is_outlier, cat_anomaly_score, is_cat_outlier
    FROM ({ORACLES["hbos_outliers"]}) JOIN ({_several_rare_sql("part", "p_partkey", ("p_name", "p_brand", "p_type"))}) USING (p_partkey)""")
def detect_all(spark, sf_dir):
    """The whole engine on part: profile, route, detector, rare categories."""
    return engine.detect(table(spark, sf_dir, "part"), Settings(algorithm="hbos"), key="p_partkey").scored.select("p_partkey", "anomaly_score", "is_outlier", "cat_anomaly_score", "is_cat_outlier")
