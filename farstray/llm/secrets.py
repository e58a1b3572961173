"""Secrets in texts by patterns and by a battery of randomness tests, in DataFrame operations only.

Strings of 20 or more key characters that mix letters and digits (or cases, as no words do) are tested for being random in the alphabet they seem
to be written in: chi-squared uniformity of its characters, runs above and below the middle of the alphabet, runs of
characters of one kind (small or capital letters, digits, signs), and correlation of neighbours.  "It is random" is the hypothesis; within each length class (powers of two, as long strings
give the tests more power) the Benjamini-Hochberg procedure says which strings are not, and the others are secrets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of the known kinds: a pattern, the group whose length counts, its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}
#: The same texts and no fewer, as a quick test.
SCREEN = {"assign": KINDS["assign"][0], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Key characters, with padding at the end only: of NAME=value each side is a candidate of its own.
CANDIDATE = r"([A-Za-z0-9+/_-]+(?:={1,2}(?![A-Za-z0-9+/_=-]))?)"
SHORTEST = 20
CANDIDATE_SCREEN = r"[A-Za-z0-9+/_-]{20}"
#: Alphabets by name, in the order in which they are tried.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
KIND_OF = {"abcdefghijklmnopqrstuvwxyz": "a", "ABCDEFGHIJKLMNOPQRSTUVWXYZ": "A", "0123456789": "0", "+/_-": "-"}
#: Places where the kind changes.
CHANGE = "(?<=a)[^a]|(?<=A)[^A]|(?<=0)[^0]|(?<=-)[^-]"
RANK = {"assign": 0, "access": 1, "hex": 2, "random": 3}
SPAN = "array<struct<start:long,rank:int,end:long>>"


def found(text: F.Column, pattern: str, screen: str, group: int, least: int, kind: str) -> F.Column:
    """Spans of leftmost non-overlapping matches whose group has at least ``least`` characters.

    What stands between two matches is matched lazily from the end of the one before, so lengths give places.
    """
    whole = rf"(?s)\G(.*?)({pattern})"
    gaps, matches, values = (F.regexp_extract_all(text, F.lit(whole), F.lit(i)) for i in (1, 2, 2 + group))
    rows = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(matches, F.length).alias("len"), F.transform(values, F.length).alias("value"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + x["len"]
        span = F.array(F.struct(start.alias("start"), F.lit(RANK[kind]).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["value"] >= least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.when(text.rlike(screen), F.aggregate(rows, begin, step)["spans"]).otherwise(F.array().cast(SPAN))


def _upper_tail(z: F.Column) -> F.Column:
    """The normal distribution's upper tail by a logistic curve (error below 2e-4)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)))


def kind_changes(alphabet: str) -> tuple[float, float]:
    """The chance that two random neighbours are of different kinds, and that it happens twice in a row."""
    share = [sum(c in chars for c in alphabet) / len(alphabet) for chars in KIND_OF]
    return sum(p * (1 - p) for p in share), sum(p * (1 - p) ** 2 for p in share)


def randomness(token: F.Column) -> F.Column:
    """The p-value of "the characters are random", null for what no alphabet fits or lacks kinds of characters that random strings have.

    Alphabets of one case ask for a letter and a digit.  In those of both cases one random string of
    20 in thirty has no digit; without one the case must change at a third of the places, as it doesn't in words.
    """
    fits = [(F.length(F.translate(token, a + "=", "")) == 0, a) for a in ALPHABETS.values()]
    alphabet, once, two = F.lit(None).cast("string"), F.lit(0.5), F.lit(0.25)
    for ok, a in reversed(fits):
        alphabet = F.when(ok, F.lit(a)).otherwise(alphabet)
        once, two = (F.when(ok, F.lit(chance)).otherwise(other) for chance, other in zip(kind_changes(a), (once, two)))
    changes = F.regexp_count(token, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"))
    digit = token.rlike("[0-9]")
    mixed = F.when(F.length(alphabet) == 64, digit & token.rlike("[A-Za-z]") | (3 * changes >= F.length(token))).otherwise(digit & token.rlike("[A-Za-z]"))
    body = F.rtrim(F.translate(token, "=", " "))
    kinds = F.translate(body, "".join(KIND_OF), "".join(kind * len(chars) for chars, kind in KIND_OF.items()))
    setup = F.struct(alphabet.alias("a"), once.alias("once"), two.alias("twice"), F.regexp_count(kinds, F.lit(CHANGE)).cast("double").alias("changes"), F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c).cast("double")).alias("x"))

    def tests(s):
        x, size = s["x"], F.length(s["a"]).cast("double")
        n = F.size(x).cast("double")
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
        squares = total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), 2)))
        k = size - 1
        chi = F.greatest((squares * size / n - n), F.lit(0.0))
        z_chi = (F.pow(chi / k, 1 / 3) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
        pairs = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("p"), F.slice(x, 2, F.size(x) - 1).alias("q"))
        high = lambda v: v > size / 2
        ones = F.size(F.filter(x, high)).cast("double")
        zeros = n - ones
        runs = 1 + F.size(F.filter(pairs, lambda p: high(p["p"]) != high(p["q"]))).cast("double")
        twice = 2 * ones * zeros
        spread = F.sqrt(F.greatest(twice * (twice - n) / (n * n * (n - 1)), F.lit(0.0)))
        z_runs = F.when(spread > 0, F.abs(runs - 1 - twice / n) / spread).otherwise(F.lit(0.0))
        # too few changes of kind only: words, and numbers behind them
        varies = (n - 1) * s["once"] * (1 - s["once"]) + 2 * (n - 2) * (s["twice"] - s["once"] * s["once"])
        z_kinds = ((n - 1) * s["once"] - s["changes"]) / F.sqrt(F.greatest(varies, F.lit(1e-9)))
        mean = total(x) / n
        power = total(F.transform(x, lambda v: (v - mean) * (v - mean)))
        serial = total(F.transform(pairs, lambda p: (p["p"] - mean) * (p["q"] - mean)))
        z_serial = F.when(power > 0, F.abs(serial / power) * F.sqrt(n)).otherwise(F.lit(0.0))
        # people choose parts of some keys, and changes of kind suffer first: that test needs ten times the evidence
        least = F.least(_upper_tail(z_chi), 2 * _upper_tail(z_runs), 10 * _upper_tail(F.greatest(z_kinds, F.lit(-6.0))), 2 * _upper_tail(z_serial))
        return F.least(F.lit(1.0), 4 * least)

    p = F.element_at(F.transform(F.array(setup), tests), 1)
    return F.when(mixed & alphabet.isNotNull() & (F.length(body) >= SHORTEST), p)


def length_class(span_length: F.Column) -> F.Column:
    return F.floor(F.log2(span_length.cast("double"))).cast("int")


def candidates(text: F.Column) -> F.Column:
    """Spans of key characters, with their p-values."""
    spans = found(text, CANDIDATE, CANDIDATE_SCREEN, 1, SHORTEST, "random")

    def rated(s):
        token = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), randomness(token).alias("p"))

    return F.filter(F.transform(spans, rated), lambda s: s["p"].isNotNull())


def thresholds(texts: DataFrame, rate: float) -> dict[int, float]:
    """By length class, the largest p-value at which "random" is rejected at the false-discovery ``rate``.

    p-values are counted in bins of a twentieth of a decade over all texts; only these counts come to the driver: at
    most one row for each bin and power of two.
    """
    p = texts.select(F.explode(candidates(F.col("text"))).alias("s")).select(length_class(F.col("s.end") - F.col("s.start")).alias("class"), F.ceil(20 * F.log10(F.greatest("s.p", F.lit(1e-20)))).cast("int").alias("bin"))
    counts = p.groupBy("class", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("class")
    cut = F.pow(F.lit(10.0), F.col("bin") / 20.0)
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    hit = counts.where(cut <= rate * F.col("upto") / F.col("all")).groupBy("class").agg(F.max(cut).alias("cut"))
    return {r["class"]: r["cut"] for r in hit.collect()}


def all_spans(texts: DataFrame, rate: float) -> DataFrame:
    """``texts`` (with a text column without nulls) and assign, access, hex, base and spans, arrays of spans."""
    cuts = thresholds(texts, rate)
    kept = texts.columns
    tested = texts.select("*", *(found(F.col("text"), p, SCREEN[kind], g, least, kind).alias(kind) for kind, (p, g, least) in KINDS.items()), candidates(F.col("text")).alias("tested"))
    limit = F.lit(-1.0)
    cut = lambda s: limit
    if cuts:
        by_class = F.create_map(*(F.lit(v) for pair in sorted(cuts.items()) for v in pair))
        cut = lambda s: F.coalesce(F.try_element_at(by_class, length_class(s["end"] - s["start"])), limit)
    based = tested.select(*kept, "assign", "access", "hex", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "tested")
    random = F.filter("tested", lambda s: (s["p"] > cut(s)) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    plain = F.transform(random, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return based.select(*kept, "assign", "access", "hex", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def scan(docs: DataFrame, rate: float = 0.05, key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans of every text; places are code points, ends exclusive.

    Null and empty texts have no spans.  Rows are independent but for the thresholds, which cover all texts; repeated
    rows stay repeated; other columns are ignored.  A tested string that overlaps a known kind's span isn't added.
    """
    spans = all_spans(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), rate)
    names = F.array(*(F.lit(k) for k in RANK))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = (F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS)
    return spans.select(key, *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(docs: DataFrame, rate: float = 0.05, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of text replaced by ``mark``; overlapping spans are replaced together.  Null stays null."""
    others = [c for c in docs.columns if c != "text"]
    held = docs.select(F.struct(*others).alias("others"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("missing"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, s):
        between = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    done = all_spans(held, rate).withColumn("cut", F.aggregate("spans", begin, step))
    rest = F.substring(F.col("text"), (F.col("cut.at") + 1).cast("int"), F.length("text"))
    text = F.when(~F.col("missing"), F.when(F.size("spans") > 0, F.concat("cut.out", rest)).otherwise(F.col("text")))
    return done.select(*(text.alias("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns))
