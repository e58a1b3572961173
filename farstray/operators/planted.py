"""Known outliers in a given table: some rows, by a hash of their key, get one number that is off in a known way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ways in which a number can be off: a decimal point moved by two places, a sign turned, a value from far out, and a constant.
KINDS = ("point_moved", "sign_turned", "far_out", "stuck")


def hashed(key: Column, salt: str) -> Column:
    """A number from 0 to 16^7 - 1, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")


def plant(df: DataFrame, columns: list[str], key: str, per_mille: int = 20, far: float = 1e6) -> DataFrame:
    """``df`` with ``kind`` (null in ordinary rows) and, in rows that have one, one of ``columns`` changed accordingly.

    Whether, how and where follow from hashes of the key.  Null numbers stay null, whatever the kind says; a null key is an ordinary row.
    """
    k = F.col(f"`{key}`")
    chosen = F.pmod(hashed(k, "planted"), F.lit(1000)) < per_mille
    kind = F.when(chosen, F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(hashed(k, "kind"), F.lit(len(KINDS))) + 1).cast("int")))
    place = F.pmod(hashed(k, "column"), F.lit(len(columns)))
    out = df.withColumn("kind", kind)
    changed = {}
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        off = F.when(F.col("kind") == "point_moved", v * 100).when(F.col("kind") == "sign_turned", -v).when(F.col("kind") == "far_out", v + F.lit(far)).when(F.col("kind") == "stuck", v * 0)
        changed[c] = F.when(F.col("kind").isNotNull() & (place == i), off).otherwise(v)
    return out.withColumns(changed)


def breakdown(scored: DataFrame) -> DataFrame:
    """kind, n, n_flagged: how many rows of each kind there are and how many of them ``is_outlier`` flags."""
    return scored.where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("n_flagged"))
