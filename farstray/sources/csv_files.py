"""CSV input: checks of the file, an all-text scan, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farstray.functions import columns as C
from farstray.sources import lines, quoted


class CsvError(ValueError):
    """A CSV file can't be used; ``issues`` are rows of the line validator, where it was asked."""

    def __init__(self, message: str, issues: list[dict] | None = None):
        super().__init__(message)
        self.issues = issues or []


def _status(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, where


def file_size_mb(spark: SparkSession, path: str) -> float:
    """Size in MB of a file or folder in any store that Spark reads; 0 if it isn't there."""
    store, where = _status(spark, path)
    return store.getContentSummary(where).getLength() / 1048576 if store.exists(where) else 0.0


def validate_file(spark: SparkSession, path: str) -> None:
    store, where = _status(spark, path)
    if not store.exists(where):
        raise CsvError(f"{path} does not exist")
    if not path.lower().endswith(".csv"):
        raise CsvError(f"{path} is not a .csv file")
    if not store.getContentSummary(where).getLength():
        raise CsvError(f"{path} is empty")


#: What a report of a file that can't be read looks at, and how much of it is kept.
ISSUE_LINES, ISSUES, ISSUE_CHARS = 100_000, 200, 300


def issues_of(spark: SparkSession, path: str) -> list[dict]:
    """The first issues that the line validator finds in the first lines of a file, with long lines cut."""
    found = lines.validate_csv(spark, path, max_lines=ISSUE_LINES).orderBy("line", "type", "description").limit(ISSUES)
    return [r.asDict() for r in found.withColumn("raw_content", F.substring("raw_content", 1, ISSUE_CHARS)).collect()]


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Every column as text; bytes that are not UTF-8 become replacement characters.

    Fields within quotes may hold line breaks; files are split among tasks even so.  ``multi_line=False`` says beforehand that none does, which
    saves the pass that looks for open quotes.  A file without rows or one that ends within quotes is refused, with what the line validator says of it.
    """
    validate_file(spark, path)
    states = None if multi_line is False else quoted.quote_states(spark, path)
    if states and states.open_end:
        raise CsvError(f"{path} ends within quotes", issues_of(spark, path))
    reader = spark.read.option("header", True).option("escape", '"')
    if states is None or not states.turned:
        df = reader.csv(path)
    else:
        names = reader.option("multiLine", True).csv(path).columns
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        rows = quoted.records(spark, path, states).where(~F.col("first"))
        parsed = rows.select(F.from_csv("record", F.lit(schema), {"escape": '"'}).alias("r"))
        df = parsed.select(*(F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)))
    if not df.columns or df.isEmpty():
        raise CsvError(f"{path} has no rows", issues_of(spark, path))
    return df


def count_rows(df: DataFrame) -> int:
    return df.count()


def count_lines(spark: SparkSession, path: str) -> int:
    """Physical lines after the header; more than rows where fields hold line breaks or lines are blank."""
    return max(0, spark.read.option("lineSep", "\n").text(path).count() - 1)


def null_share(df: DataFrame) -> DataFrame:
    """One row: cells, null cells, and whether more than half are null."""
    nulls = C.total([F.col(f"`{c}`").isNull().cast("long") for c in df.columns])
    r = df.agg((F.count("*") * len(df.columns)).alias("cells"), F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"))
    return r.withColumn("mostly_null", F.col("nulls") > 0.5 * F.col("cells"))
