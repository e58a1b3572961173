"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window of an item occurs in a document if all its words do, in their order.  Containment must be whole, so the
necessary prefix of a window, ordered by rarity, is its rarest word: documents are joined with the windows on that
word only.  The word's place in the window bounds where the window begins (it must fit between the document's ends),
and what fits is compared word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farstray.llm.common import checkpointed, sized, sized_bytes

#: Words or windows of the benchmark of at most so many bytes are broadcast.
BROADCAST_BYTES = 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> F.Column:
    """Words of a text column; the first and the last element may be empty, others never."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)


def n_words(w: F.Column) -> F.Column:
    n = F.size(w)
    return (n - (F.element_at(w, 1) == "").cast("int") - ((n > 1) & (F.element_at(w, -1) == "")).cast("int")).cast("long")


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """window (words joined by one space), words, item_ids of every different window of the items."""
    clean = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.filter(words("text"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    one = clean.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return one.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("window", F.array_join("words", " "))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null and empty texts have no words.  Items without an id or without words have no windows; items with fewer words
    than a window are one window.  Repeated rows of one doc_id and text each get the same result; an item that is
    repeated counts once.  Other columns are ignored, whatever their names.
    """
    # the windows follow the benchmark; they are counted before they are broadcast
    windows = checkpointed(windows_of(benchmark, size).withColumn("id", F.xxhash64("window")))
    tokens = docs.select("doc_id", F.xxhash64("text").alias("copy"), words("text").alias("w"))
    vocabulary = checkpointed(windows.select(F.explode("words").alias("word")).distinct())
    found = tokens.select(F.explode("w").alias("word"))
    counts = checkpointed(found.join(sized_bytes(vocabulary, "word", BROADCAST_BYTES), "word").groupBy("word").agg(F.count("*").alias("n")))
    placed = windows.select("id", F.posexplode("words").alias("place", "word")).join(counts, "word", "left")
    rarest = placed.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("r")).where("r.n > 0")
    prefix = rarest.join(windows, "id").select(F.col("r.word").alias("word"), F.col("r.place").alias("place"), F.size("words").alias("len"), "window", "id")
    prefix = checkpointed(prefix)
    met = tokens.select("doc_id", "copy", "w", F.posexplode("w").alias("pos", "word")).join(sized_bytes(prefix, "window", BROADCAST_BYTES), "word")
    # near holds every window that the word at pos can be in
    left = F.least(F.col("pos"), F.lit(size - 1))
    met = met.select("doc_id", "copy", "pos", "place", "len", "window", "id", left.alias("left"), F.slice("w", F.col("pos") - left + 1, 2 * size).alias("near"))
    begin = F.col("left") - F.col("place")
    fits = (begin >= 0) & (begin + F.col("len") <= F.size("near"))
    met = met.where(fits).where(F.array_join(F.slice("near", begin + 1, F.col("len")), " ") == F.col("window"))
    hits = met.select("doc_id", "copy", (F.col("pos") - F.col("place")).alias("start"), "len", "id").distinct()
    hits = checkpointed(hits)
    # hit words: windows in the order of their starts add what the ones before have not covered
    order = Window.partitionBy("doc_id", "copy").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    covered = hits.withColumn("upto", F.coalesce(F.max(end).over(order), F.lit(0))).groupBy("doc_id", "copy")
    covered = covered.agg(F.sum(F.greatest(end - F.greatest("start", "upto"), F.lit(0))).cast("long").alias("n_hit"))
    ids_text = F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ",")  # a window may be that of very many items
    named = sized_bytes(windows.select("id", "item_ids"), ids_text, BROADCAST_BYTES)
    items = hits.select("doc_id", "copy", "id").distinct().join(named, "id").groupBy("doc_id", "copy")
    items = items.agg(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("ids"))
    joined = F.array_join(F.sort_array(F.transform("ids", lambda i: i.cast("string"))), ",")
    items = items.select("doc_id", "copy", F.size("ids").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["copy"] == b["copy"])
    hit = covered.join(items, same(covered, items)).select(covered["doc_id"], covered["copy"], "n_hit", "n_items", "items_sha256")
    hit = checkpointed(hit)
    every = tokens.select("doc_id", "copy", n_words(F.col("w")).alias("n_words"))
    out = every.join(sized(hit), same(every, hit), "left")
    return out.select(
        every["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
