"""Which columns are features, and expressions on single columns.  Nothing here runs a job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that a detection adds.
OUTPUTS = ("anomaly_score", "is_outlier", "cat_anomaly_score", "is_cat_outlier", "explanation")
#: Names (trimmed, any case) that hold ground truth and are never features.
TRUTH_NAMES = frozenset({"is_outlier", "outlier_type", "ground_truth", "label", "target"})
#: A column of one of these names, or with one as its first or last part, looks like an identifier.
ID_NAMES = ("id", "idx", "index", "row_id", "row_num", "serial", "record_id", "row_index", "rowid", "pk", "key")
NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)
INTEGRAL = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: Text that is a number, after trimming and in any case; both engines that we compare read these alike.
NUMBER = r"^(?i)([+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)|nan)$"


def is_truth(name: str) -> bool:
    return name.strip().lower() in TRUTH_NAMES


def _free(name: str, exclude: Iterable[str]) -> bool:
    return name not in OUTPUTS and not is_truth(name) and name not in set(exclude)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and _free(f.name, exclude)]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and _free(f.name, exclude)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME)]


def looks_like_id(name: str) -> bool:
    plain = name.strip().lower().replace(" ", "_")
    return any(plain == t or plain.startswith(t + "_") or plain.endswith("_" + t) for t in ID_NAMES)


def merged_excludes(exclude: Iterable[str], ids: Iterable[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*exclude, *ids]))


def without_collisions(df: DataFrame, added: Iterable[str] = OUTPUTS) -> DataFrame:
    """Rename input columns whose name is that of an added column but for its case, or the same."""
    lower = {a.lower() for a in added}
    return df.select(*(F.col(f"`{c}`").alias(f"{c}__input" if c.lower() in lower else c) for c in df.columns))


def sanitized(column: Column) -> Column:
    """NaN and infinities as zero; null stays null."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(0.0)).otherwise(column)


def clipped(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(column, F.lit(high)), F.lit(low))


def normalised(score: Column, low: Column, high: Column) -> Column:
    """Scores between two bounds as 0 to 1, to four places; 0 where the bounds are equal."""
    part = F.try_divide(score - low, high - low)
    return F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)), 4), F.lit(0.0)) + F.lit(0.0)


def number_of(text: Column) -> Column:
    """The double that a text spells, else null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def leading_zero(text: Column) -> Column:
    trimmed = F.trim(text)
    return (F.length(trimmed) > 1) & trimmed.startswith("0") & (F.substring(trimmed, 2, 1) != ".")


def multiple_text(actual: Column, median: Column) -> Column:
    """How many times its median a value is, as text; a dash where the median is zero."""
    ratio = F.try_divide(F.abs(actual), F.abs(median))
    return F.when(ratio.isNull(), F.lit("—")).otherwise(F.format_string("%.1fx", ratio))


def greatest(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out
