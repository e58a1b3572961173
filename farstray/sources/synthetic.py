"""Tables of deliveries with known outliers, for tests and demonstrations.

Every value is drawn by whole-number arithmetic on the row number and the seed, the same on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = 2_147_483_647
REGIONS = ("north", "east", "south", "west", "centre", "coast", "islands")
STATES = ("delivered", "returned", "on the way", "lost")
#: Numbers and the largest ordinary value of each; parcels and weights of a size belong together.
SIZES = ("small", "medium", "large")
NUMBERS = {"parcels_small": 120, "parcels_medium": 60, "parcels_large": 24, "kg_small": 90, "kg_medium": 240, "kg_large": 480}
NUMERIC = ("huge", "below_zero", "light", "nothing", "shifted")
CATEGORICAL = ("bad_state", "bad_region", "bad_flag")
SINGLE = ("own_stop", "own_route")
#: Shares of the kinds of outliers, in hundredths.
NUMERIC_SHARE, SINGLE_SHARE = 60, 10


def draw(salt: int, n: int, seed: int) -> Column:
    """A number from 0 to n - 1 for each row: three rounds of multiplication modulo a prime."""
    prime = F.lit(PRIME)
    x = F.pmod((F.col("id") + F.lit(1 + seed + 7919 * salt)) * F.lit(48271), prime)
    x = F.pmod(x * x + F.lit(69621 * (salt + 1)), prime)
    x = F.pmod(x * F.lit(16807) + F.lit(salt), prime)
    return F.pmod(F.floor(F.pmod(x * x, prime) / F.lit(64)), F.lit(n)).cast("int")


def _pick(values, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), place + 1)


def synthetic_table(spark: SparkSession, rows: int, contamination: float = 0.02, seed: int = 42) -> DataFrame:
    """id, names, numbers, flags, is_planted and kind (empty for ordinary rows) of ``rows`` deliveries.

    Numeric kinds: one number far too large or below zero, weights too light for their parcels, all numbers zero, a decimal
    point lost in one.  Categorical kinds: a state, region or flag that doesn't exist.  Single ones: a stop or route of its own.
    """
    df = spark.range(rows)
    hundred = draw(2, 100, seed)
    kind = F.when(hundred < NUMERIC_SHARE, _pick(NUMERIC, draw(3, len(NUMERIC), seed))).when(hundred < NUMERIC_SHARE + SINGLE_SHARE, _pick(SINGLE, draw(4, len(SINGLE), seed))).otherwise(_pick(CATEGORICAL, draw(5, len(CATEGORICAL), seed)))
    planted = draw(1, 100_000, seed) < F.lit(int(contamination * 100_000))
    df = df.select("id", F.when(planted, kind).otherwise("").alias("kind"), draw(6, len(NUMBERS), seed).alias("__number"), _pick(SIZES, draw(7, len(SIZES), seed)).alias("__size"))
    k, named = F.col("kind"), lambda word, n, salt: F.concat(F.lit(word + " "), draw(salt, n, seed).cast("string"))
    out = {
        "region": F.when(k == "bad_region", "nowhere").otherwise(_pick(REGIONS, draw(8, len(REGIONS), seed))),
        "depot": named("depot", 40, 9),
        "route": F.when(k == "own_route", F.concat(F.lit("route x"), F.col("id").cast("string"))).otherwise(named("route", 500, 10)),
        "stop": F.when(k == "own_stop", F.concat(F.lit("stop x"), F.col("id").cast("string"))).otherwise(named("stop", 5000, 11)),
    }
    for i, (name, most) in enumerate(NUMBERS.items()):
        plain, mine = 1 + draw(20 + i, most, seed), F.col("__number") == i
        value = F.when((k == "huge") & mine, 40 * most + draw(30 + i, 100 * most, seed)).when((k == "below_zero") & mine, -plain).when((k == "shifted") & mine, 100 * plain).when(k == "nothing", 0)
        light = (k == "light") & (F.col("__size") == name.split("_")[1])
        out[name] = value.when(light, most if name.startswith("parcels") else 1).otherwise(plain)
    out["state"] = F.when(k == "bad_state", "?").otherwise(_pick(STATES, draw(12, len(STATES), seed)))
    out |= {f: F.when((k == "bad_flag") & F.lit(f == "signed"), "maybe").otherwise(_pick(("yes", "no"), draw(salt, 2, seed))) for f, salt in (("signed", 13), ("insured", 14))}
    return df.select("id", *(v.alias(c) for c, v in out.items()), (k != "").cast("int").alias("is_planted"), "kind")


def outlier_breakdown(df: DataFrame) -> DataFrame:
    """How many rows of each kind of outlier."""
    return df.where("is_planted = 1").groupBy("kind").agg(F.count("*").alias("n"))


def write_quoted_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
