"""Column profiles: types, nulls, distinct values, moments, quantiles, identifiers, quality, the commonest values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farstray.functions import columns as C
from farstray.functions.ordered import is_consecutive
from farstray.functions.quantiles import exact_quantiles
from farstray.operators.categorical import print_counts, value_counts
from farstray.operators.vectors import vector_columns, vector_widths

TOP_VALUES = 5


@dataclass(frozen=True)
class TableProfile:
    rows: int
    columns: int
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    datetime: tuple[str, ...]
    ids: tuple[str, ...]
    constant: tuple[str, ...]
    nulls: int
    mean_skewness: float
    quality: int
    size_mb: float = 0.0
    details: dict[str, dict] = field(default_factory=dict)
    vectors: dict[str, int] = field(default_factory=dict)  # array columns and how long they are
    sample_rows: int = 0  # how many rows the statistics are of

    @property
    def usable_dimensions(self) -> int:
        return len([c for c in self.numeric if c not in self.ids and c not in self.constant]) + sum(self.vectors.values())


    def report(self) -> dict:
        """For a client: percentages to two places, statistics to four, least and largest values as they are; says whether a sample was profiled."""
        cells = self.sample_rows * self.columns
        rounded = {"null_pct": 2} | dict.fromkeys(("mean", "median", "std", "q1", "q3", "iqr", "skewness", "kurtosis", "cardinality_ratio"), 4)
        columns = {}
        for name, d in self.details.items():
            d = d | {"null_pct": 100.0 * d["nulls"] / self.sample_rows if self.sample_rows else 0.0}
            columns[name] = {k: round(v, rounded[k]) if k in rounded and v is not None else v for k, v in d.items()}
        return {
            "rows": self.rows, "sample_rows": self.sample_rows, "stats_are_sampled": self.sample_rows < self.rows, "size_mb": round(self.size_mb, 2), "columns": self.columns,
            "numeric": list(self.numeric), "categorical": list(self.categorical), "datetime": list(self.datetime), "ids": list(self.ids), "constant": list(self.constant),
            "nulls": self.nulls, "null_pct": round(100.0 * self.nulls / cells, 2) if cells else 0.0, "quality": self.quality, "mean_skewness": round(self.mean_skewness, 4),
            "usable_dimensions": self.usable_dimensions, "details": columns,
        }


def null_counts(df: DataFrame) -> DataFrame:
    """column, nulls, n_unique (null is a value), rows, cardinality_ratio of every column with a text form."""
    names = [f.name for f in df.schema.fields]
    found = print_counts(df, names).groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("p1").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("*").alias("n_unique"), F.sum("n").alias("rows"))
    return found.withColumn("cardinality_ratio", F.round(F.col("n_unique") / F.col("rows"), 4))


def numeric_stats(df: DataFrame, names: list[str]) -> list[dict]:
    """For each column: mean, median, std (population), min, max, quartiles, iqr, skewness and excess kurtosis (population).

    Over non-null values, NaN and infinities as zero.  Skewness needs three and kurtosis four values and a spread, else null.
    """
    if not names:
        return []
    clean = df.select(*(C.sanitized(F.col(f"`{c}`").cast("double")).alias(f"x{i}") for i, c in enumerate(names)))
    plain = [f"x{i}" for i in range(len(names))]
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "skewness": F.skewness, "kurtosis": F.kurtosis}
    found = {}
    for at in range(0, len(plain), 40):
        part = plain[at : at + 40]
        found |= clean.agg(*(f(p).alias(f"{k}_{p}") for p in part for k, f in stats.items())).first().asDict()
    quantiles = exact_quantiles(clean, plain, [0.25, 0.5, 0.75])
    out = []
    for c, p in zip(names, plain):
        r = {k: found[f"{k}_{p}"] for k in stats}
        q1, median, q3 = quantiles[p]
        varied = r["std"] is not None and r["std"] > 0
        out.append({
            "column": c, "n": r["n"], "mean": r["mean"], "median": median, "std": r["std"], "min": r["min"], "max": r["max"], "q1": q1, "q3": q3,
            "iqr": None if q1 is None else q3 - q1, "skewness": r["skewness"] if varied and r["n"] >= 3 else None, "kurtosis": r["kurtosis"] if varied and r["n"] >= 4 else None,
        })
    return out


STATS_SCHEMA = "column string, n long, mean double, median double, std double, min double, max double, q1 double, q3 double, iqr double, skewness double, kurtosis double"


def numeric_profile(df: DataFrame, names: list[str], places: int = 4) -> DataFrame:
    rounded = [{k: round(v, places) + 0.0 if isinstance(v, float) else v for k, v in r.items()} for r in numeric_stats(df, names)]
    return df.sparkSession.createDataFrame(rounded, STATS_SCHEMA)


def top_values(df: DataFrame, names: list[str], n: int = TOP_VALUES) -> DataFrame:
    """column, rank, value, count, pct: the commonest values, ties to the smaller text."""
    counts = value_counts(df, names)
    rows = df.count()
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= n)
    return top.select("column", "rank", "value", F.col("n").alias("count"), F.round(100.0 * F.col("n") / F.lit(max(rows, 1)), 2).alias("pct"))


def id_columns(df: DataFrame, distinct: dict[str, int], rows: int, ratio: float = 0.5, by_name_only: tuple[str, ...] = (), order: list[str] | None = None) -> list[str]:
    """Strings with very many values; numbers that are all different and consecutive (integers, or an identifier's name).

    Without an ``order`` of rows, consecutive means as many values as rows and as wide a range; with one, each value is one more than the
    value before.  ``by_name_only`` are columns that were numbers spelled as text, for which the type says nothing.
    """
    out = [c for c in C.categorical_columns(df) if distinct.get(c, 0) > max(10, rows * ratio)]
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, C.INTEGRAL)} - set(by_name_only)
    maybe = [c for c in C.numeric_columns(df) if rows > 1 and distinct.get(c) == rows and (c in whole or C.looks_like_id(c))]
    if maybe and order:
        found = is_consecutive(df, maybe, order)
        out += [c for c in maybe if found[c]]
    elif maybe:
        r = df.agg(*(x for i, c in enumerate(maybe) for x in ((F.max(f"`{c}`").cast("double") - F.min(f"`{c}`").cast("double")).alias(f"r{i}"), F.count_if(F.col(f"`{c}`").cast("double") != F.floor(F.col(f"`{c}`").cast("double"))).alias(f"w{i}"), F.count(f"`{c}`").alias(f"n{i}")))).first()
        out += [c for i, c in enumerate(maybe) if r[f"n{i}"] == rows and r[f"r{i}"] == rows - 1 and r[f"w{i}"] == 0]
    return [c for c in df.columns if c in set(out)]


def quality_score(rows: int, cells: int, nulls: int, columns: int, constant: int, skewness: float) -> int:
    """100 less deductions for nulls, constant columns, few rows and skew; 0 to 100."""
    score = 100 - min(30, int(100 * nulls / cells) if cells else 0) - int(constant / columns * 20 if columns else 0)
    score -= 20 if rows < 50 else 10 if rows < 500 else 0
    score -= 15 if skewness > 5 else 5 if skewness > 2 else 0
    return max(0, min(100, score))


def profile(df: DataFrame, id_ratio: float = 0.5, size_mb: float = 0.0, true_rows: int | None = None, order: list[str] | None = None) -> TableProfile:
    """Profile a table; ``true_rows`` is the whole table's count where ``df`` is a sample, ``order`` the columns that order its rows."""
    counted = {r["column"]: r for r in null_counts(df).collect()} if df.columns else {}
    rows = max((r["rows"] for r in counted.values()), default=0)
    distinct = {c: r["n_unique"] for c, r in counted.items()}
    numeric = C.numeric_columns(df)
    stats = {r["column"]: r for r in numeric_stats(df, numeric)}
    constant = [c for c in numeric if distinct.get(c, 0) <= 1]
    skews = [abs(r["skewness"]) for r in stats.values() if r["skewness"] is not None]
    skew = sum(skews) / len(skews) if skews else 0.0
    nulls = sum(r["nulls"] for r in counted.values())
    true = rows if true_rows is None else true_rows
    quality = quality_score(true, rows * len(df.columns), nulls, len(df.columns), len(constant), skew)
    details = {c: {"nulls": r["nulls"], "n_unique": r["n_unique"], "cardinality_ratio": r["cardinality_ratio"]} | {k: v for k, v in stats.get(c, {}).items() if k not in ("column", "n")} for c, r in counted.items()}
    return TableProfile(true, len(df.columns), tuple(numeric), tuple(C.categorical_columns(df)), tuple(C.datetime_columns(df)), tuple(id_columns(df, distinct, rows, id_ratio, order=order)), tuple(constant), nulls, skew, quality, size_mb, details, vector_widths(df, vector_columns(df)), rows)
