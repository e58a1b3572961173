"""``python -m farstray.plans.cli -i data.csv -o results/output.parquet``"""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from farstray.config import CHOICES, Settings
from farstray.plans.engine import detect
from farstray.sources import csv_files, lines, results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Find outliers in a CSV file.")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("--validate-only", action="store_true", help="check the file's lines and stop; exit code 1 if anything is wrong")
    p.add_argument("--answer", action="store_true", help="print profile, counters, first outliers and explanations as JSON")
    p.add_argument("--key", help="the column that identifies a row")
    for f in fields(Settings):
        name = "--" + f.name.replace("_", "-")
        if f.name == "exclude_columns":
            p.add_argument(name, nargs="*", default=[])
        elif f.type == "bool":
            p.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            p.add_argument(name, type=type(f.default), default=f.default, choices=CHOICES.get(f.name))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = vars(parser().parse_args(argv))
    began = time.perf_counter()
    spark = spark or SparkSession.builder.appName("farstray").getOrCreate()
    path, only, key, whole = (args.pop(k) for k in ("input", "validate_only", "key", "answer"))
    settings = Settings(**args)
    csv_files.validate_file(spark, path)
    if only:
        issues = lines.validate_csv(spark, path)
        lines.write_reports(issues, settings.output_path + ".validation")
        wrong = issues.agg(F.count_distinct("line")).first()[0]
        print(f"{wrong} lines with issues")
        return int(wrong > 0)
    try:
        table = csv_files.read_csv(spark, path)
    except csv_files.CsvError as e:
        print(json.dumps({"error": str(e), "issues": e.issues}))
        return 2
    if not key:
        table, key = table.withColumn("_row_id", F.xxhash64(*table.columns)), "_row_id"
        settings = Settings(**args | {"exclude_columns": [*args["exclude_columns"], key]})
    share = csv_files.null_share(table).first()
    if share["mostly_null"]:
        print(f"more than half of the cells are empty ({share['nulls']} of {share['cells']})", file=sys.stderr)
    found = detect(table, settings, key, size_mb=csv_files.file_size_mb(spark, path))
    counters = results.write_scored(found.scored, settings.output_path, began)
    if whole:
        print(results.answer(found.scored, key, counters, found.profile.report(), found.explanations))
    else:
        print(json.dumps({"algorithm": found.algorithm} | counters))
    if found.explanations is not None:
        results.write_explanations(found.explanations, settings.output_path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
