"""Exact quantiles of any number of columns.

Up to ``DIRECT_ROWS`` values Spark's ``percentile`` sorts them in one aggregate.  Beyond, that aggregate would gather all
distinct values in one task, so the wanted ranks are located by histograms that are refined over the data until the
interval that holds a rank has few values; only those are sorted.  Both are exact and interpolate linearly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT_ROWS = 2_000_000
BINS = 4096
FEW = 50_000
#: Rows of counts that may reach the driver in a round.
MOST_ROWS = 200_000


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], rows: int | None = None, direct_rows: int = DIRECT_ROWS) -> dict[str, list[float | None]]:
    """Quantiles of each column's non-null values; None for a column without any.  Values must not be NaN or infinite."""
    if not columns:
        return {}
    rows = df.count() if rows is None else rows
    if rows <= direct_rows:
        out: dict[str, list[float | None]] = {}
        for at in range(0, len(columns), 40):  # wider aggregates outgrow generated code
            part = columns[at : at + 40]
            found = df.agg(*(F.percentile(F.col(f"`{c}`").cast("double"), F.array(*map(F.lit, probabilities))).alias(f"q{i}") for i, c in enumerate(part))).first()
            out |= {c: list(found[i]) if found[i] is not None else [None] * len(probabilities) for i, c in enumerate(part)}
        return out
    values = df.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    ends = values.agg(*(f(f"x{i}") for i in range(len(columns)) for f in (F.count, F.min, F.max))).first()
    wanted, spans = {}, {}
    for i in range(len(columns)):
        n, low, high = ends[3 * i : 3 * i + 3]
        for p in probabilities if n else ():
            for r in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1)):
                spans[i, r] = Span(i, r, n, low, high)
            wanted[i, p] = n
    found = _kth(values, spans)

    def value(i: int, p: float) -> float | None:
        if (i, p) not in wanted:
            return None
        n = wanted[i, p]
        at = p * (n - 1)
        a, b = found[i, int(at)], found[i, min(int(at) + 1, n - 1)]
        return a + (b - a) * (at - int(at))

    return {c: [value(i, p) for p in probabilities] for i, c in enumerate(columns)}


@dataclass
class Span:
    """The value of ``rank`` among the ``n`` values of a column between two bounds."""

    column: int
    rank: int
    n: int
    low: float
    high: float


def _kth(values: DataFrame, spans: dict) -> dict:
    """The value of each span; all spans of all columns are refined in the same scans (columns x0, x1, ...)."""
    while True:
        open_ = {(s.column, s.low, s.high) for s in spans.values() if s.n > FEW and s.low < s.high}
        if not open_:
            break
        cuts = {k: i for i, k in enumerate(sorted(open_))}
        bins = max(64, min(BINS, MOST_ROWS // len(cuts)))
        cells = []
        for (c, low, high), i in cuts.items():
            x, width = F.col(f"x{c}"), (high - low) / bins
            # between neighbouring doubles there are at most as many values as bins
            bin_ = x if width <= 0 or low + width == low else F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("double")
            cells.append(F.when(x.between(low, high), F.struct(F.lit(i).alias("cut"), bin_.alias("bin"), x.alias("x"))))
        rows = values.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).groupBy("s.cut", "s.bin")
        counts: dict[int, list] = {}
        for r in rows.agg(F.count("*").alias("n"), F.min("s.x").alias("low"), F.max("s.x").alias("high")).collect():  # at most MOST_ROWS or 64 a span
            counts.setdefault(r["cut"], []).append((r["bin"], r["n"], r["low"], r["high"]))
        for s in spans.values():
            for _, n, low, high in sorted(counts[cuts[s.column, s.low, s.high]]) if (s.column, s.low, s.high) in cuts else ():
                if s.rank < n:
                    s.n, s.low, s.high = n, low, high
                    break
                s.rank -= n
    few = {(s.column, s.low, s.high) for s in spans.values() if s.low < s.high}
    held = {}
    if few:
        cuts = {k: i for i, k in enumerate(sorted(few))}
        cells = [F.when(F.col(f"x{c}").between(low, high), F.struct(F.lit(i).alias("cut"), F.col(f"x{c}").alias("x"))) for (c, low, high), i in cuts.items()]
        rows = values.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).groupBy("s.cut").agg(F.sort_array(F.collect_list("s.x")).alias("x"))  # FEW values each
        want = {i: sorted({s.rank for s in spans.values() if (s.column, s.low, s.high) == k}) for k, i in cuts.items()}
        ranks = F.create_map(*(F.lit(v) if k == 0 else F.array(*map(F.lit, v)) for pair in want.items() for k, v in enumerate(pair)))
        got = {r["cut"]: r["x"] for r in rows.select("cut", F.transform(F.element_at(ranks, F.col("cut")), lambda k: F.get("x", k)).alias("x")).collect()}
        held = {(k, rank): v for k, i in cuts.items() for rank, v in zip(want[i], got[i])}
    return {k: s.low if s.low == s.high else held[(s.column, s.low, s.high), s.rank] for k, s in spans.items()}


def order_statistic(df: DataFrame, column: str, rank) -> float | None:
    """The value at ``rank(n)`` (from 0) of the column's ``n`` sorted non-null values."""
    values = df.select(F.col(f"`{column}`").cast("double").alias("x0")).where("x0 is not null")
    n, low, high = values.agg(F.count("*"), F.min("x0"), F.max("x0")).first()
    return _kth(values, {0: Span(0, min(max(int(rank(n)), 0), n - 1), n, low, high)})[0] if n else None
