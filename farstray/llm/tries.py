"""Prefix trie of conversations: what each shared beginning saves, added up from the leaves by messages.

Turns are brought down to digests and word counts at once; a node is known by its depth and the combined digests of all turns up to
it (128 bits), which every conversation can tell by itself.  Conversations lie in ranges of turns, so that a very long one is worked on
by several tasks; only one row for each range of a conversation is carried over.

Totals follow by leaf peeling: counters hold how many children are waited for, and what has finished sends its subtree's totals to its parent, until
the root finishes.  A path of nodes that share a member sends as one, so that the rounds follow the logarithm of the members and not the depth;
its nodes' own totals are sums along the path.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farstray.llm.common import checkpointed, tidy

#: A conversation takes the first turns, up to this many less one, of the first conversation of its run of ``RUN`` ids.
GIVEN, RUN = 4, 20
NODE = ["depth", "k1", "k2"]
#: Conversation ids that are joined to one text before they are sent to be digested.
PACK = 50_000
#: Nodes of a path that one task sums up; longer paths are summed by chunks.
CHUNK = 10_000


def tag(digest: Column, depth: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its place; xor of those up to a depth is a prefix's key."""
    return F.xxhash64(digest, depth.cast("long")), F.xxhash64(F.lit("prefix"), depth.cast("long"), digest)


def light_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words and part, a range of the order of conversations and turns.

    Null ids are left out.  Turns that share a number are ordered by digest, so that equal tables give equal tries.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return checkpointed(rows.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, k1, k2, p1, p2 of the prefix one shorter, words, last) of all rebuilt turns, and the ids of conversations without turns."""
    inside = Window.partitionBy("part", "conv_id").orderBy("turn", "digest")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("conv_id")))
    placed = turns.withColumn("at", F.row_number().over(inside))

    first = placed.where((F.col("conv_id") % RUN == 0) & (F.col("at") < GIVEN)).join(ranges.where(F.col("before") < GIVEN), ["conv_id", "part"])
    first = first.where(F.col("at") + F.col("before") < GIVEN).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("at") + F.col("before")).alias("depth"), "digest", "words"))).alias("head"))
    known = ranges.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % GIVEN).cast("int"))
    known = known.join(first.select((F.col("conv_id")).alias("donor"), "head"), F.col("conv_id") - F.col("conv_id") % RUN == F.col("donor"), "left")
    # a turn's key is the xor of all tags up to it
    given = F.slice(F.coalesce("head", F.expr("array()").cast(_type_of(first, "head"))), 1, F.col("h"))
    known = known.withColumn("given", F.transform(given, lambda t: F.struct(t["depth"].cast("long").alias("depth"), *(x.alias(f"t{i}") for i, x in enumerate(tag(t["digest"], t["depth"]), 1)), t["words"].alias("words"))))
    known = checkpointed(known.select("conv_id", "part", "before", "h", "given", (F.size("given") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")))

    def xor(turns: Column, which: str) -> Column:
        return F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t[which]))

    own = placed.join(known, ["conv_id", "part"]).withColumn("depth", F.col("at") + F.col("before") - F.col("h") + F.size("given")).where(F.col("at") + F.col("before") > F.col("h"))
    tags = tag(F.col("digest"), F.col("depth"))
    own = own.select("conv_id", "part", "at", "depth", "words", "length", tags[0].alias("t1"), tags[1].alias("t2"))
    along = Window.partitionBy("part", "conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # what comes before a range: the given turns and the earlier ranges of the conversation
    carried = own.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("r1"), F.bit_xor("t2").alias("r2"))
    carried = carried.select("conv_id", "part", *(F.coalesce(F.bit_xor(f"r{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)))
    carried = carried.join(known.select("conv_id", "part", *(xor(F.col("given"), f"t{i}").alias(f"g{i}") for i in (1, 2))), ["conv_id", "part"])
    own = own.select("*", *(F.bit_xor(f"t{i}").over(along).alias(f"s{i}") for i in (1, 2))).join(carried, ["conv_id", "part"])
    keys = [F.col(f"s{i}").bitwiseXOR(F.col(f"c{i}")).bitwiseXOR(F.col(f"g{i}")) for i in (1, 2)]
    own = own.select("conv_id", F.col("depth").cast("long"), *(k.alias(f"k{i}") for i, k in enumerate(keys, 1)), *(k.bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i, k in enumerate(keys, 1)), "words", (F.col("depth") == F.col("length")).alias("last"))

    once = known.where("before = 0")
    shared = once.select("conv_id", "length", "given", F.explode("given").alias("t"))
    upto = F.slice("given", F.lit(1), F.col("t.depth").cast("int"))
    shared = shared.select(
        "conv_id", F.col("t.depth").alias("depth"), *(xor(upto, f"t{i}").alias(f"k{i}") for i in (1, 2)), *(xor(upto, f"t{i}").bitwiseXOR(F.col(f"t.t{i}")).alias(f"p{i}") for i in (1, 2)), F.col("t.words").alias("words"), (F.col("t.depth") == F.col("length")).alias("last")
    )
    return own.unionByName(shared), once.where("length = 0").select("conv_id")


def _type_of(df: DataFrame, column: str):
    return df.schema[column].dataType


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of (depth, k1, k2, conv_id): the digest of each node's ids in order, joined by commas.

    Ids are sorted and joined in ranges; a digest is sequential by definition, so the pieces of a node meet in one task, which
    holds one piece at a time.
    """

    def pack(batches):
        import pyarrow as pa

        rows, held, node = [], [], None

        def close():
            if held:
                rows.append((*node, held[0], ",".join(map(str, held))))
                held.clear()

        def flush():
            columns = list(zip(*rows)) or [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()])], names=[*NODE, "first", "ids"])

        for batch in batches:
            for *now, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if now != node or len(held) >= PACK:
                    close()
                    node = now
                held.append(conv_id)
            if rows:
                yield flush()
        close()
        yield flush()

    def digest(batches):
        import pyarrow as pa

        node, running = None, None
        for batch in batches:
            rows = []
            for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now != node:
                    if node:
                        rows.append((*node, running.hexdigest()))
                    node, running = now, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield made(rows)
        yield made([(*node, running.hexdigest())] if node else [])

    def made(rows):
        import pyarrow as pa

        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=[*NODE, "ends_sha256"])

    in_order = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    packed = in_order.mapInArrow(tidy(pack), "depth long, k1 long, k2 long, first long, ids string")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(tidy(digest), "depth long, k1 long, k2 long, ends_sha256 string")


def peeled(paths: DataFrame) -> DataFrame:
    """label, leaves and saved of every path's whole subtree, by messages from those that no other hangs on.

    ``paths`` have label, above (the label of the path they hang on, null at the root), waits (how many hang on them), and leaves and saved of
    their own nodes.  Those that wait for none have finished and send their totals up, until the root's path finishes.
    """
    state, finished = paths, []
    while True:
        state = checkpointed(state)
        finished.append(state.where("waits = 0").drop("waits", "above"))
        if state.where("waits > 0").isEmpty():
            return reduce(DataFrame.unionByName, finished)
        sent = state.where("waits = 0").groupBy(F.col("above").alias("label")).agg(F.count("*").alias("told"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        state = state.where("waits > 0").join(sent, "label", "left").fillna(0, ["told", "more_leaves", "more_saved"])
        state = state.select("label", "above", *((F.col(c) + F.col(more)).alias(c) for c, more in (("leaves", "more_leaves"), ("saved", "more_saved"))), (F.col("waits") - F.col("told")).alias("waits"))


def with_totals(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens of their subtrees; they have depth, label, above (the parent's label), n_children, own_saved.

    Nodes of one label are a path, each the parent of the next.  The label is the member whose id has the smallest hash, so it changes only about as
    often on a way down as the logarithm of the members, and so many rounds the messages take, however deep the trie is.
    """
    top = F.col("above").isNull() | (F.col("above") != F.col("label"))
    leaf = (F.col("n_children") == 0).cast("long")
    paths = nodes.groupBy("label").agg(F.min(F.when(top, F.col("above"))).alias("above"), F.min("depth").alias("depth"), F.sum(leaf).alias("leaves"), F.sum("own_saved").alias("saved"))
    waits = nodes.where(top & F.col("above").isNotNull()).groupBy(F.col("above").alias("label")).agg(F.count("*").alias("waits"))
    paths = checkpointed(paths.join(waits, "label", "left").fillna(0, ["waits"]))
    totals = peeled(paths.drop("depth"))
    hung = paths.select("label", "above", "depth").where("above IS NOT NULL").join(totals, "label")
    hung = hung.groupBy(F.col("above").alias("label"), (F.col("depth") - 1).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    own = nodes.join(hung, ["label", "depth"], "left").fillna(0, ["more_leaves", "more_saved"])
    own = own.withColumns({"chunk": F.floor(F.col("depth") / CHUNK), "leaves": leaf + F.col("more_leaves"), "saved": F.col("own_saved") + F.col("more_saved")})
    # from the bottom of a path up: within a chunk of it, and then the chunks below
    upward = Window.partitionBy("label", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumns({"n_leaves": F.sum("leaves").over(upward), "saved_tokens": F.sum("saved").over(upward)})
    if not nodes.where(F.col("depth") >= CHUNK).isEmpty():
        below = Window.partitionBy("label").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
        chunks = own.groupBy("label", "chunk").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        chunks = chunks.select("label", "chunk", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in ("l", "s")))
        summed = summed.join(chunks, ["label", "chunk"]).withColumns({"n_leaves": F.col("n_leaves") + F.col("l_below"), "saved_tokens": F.col("saved_tokens") + F.col("s_below")})
    return summed


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Null roles and texts are empty; null turns come first, and turns that share a number are ordered by a digest of what they say,
    so repeated rows are repeated turns; null conv_ids are no conversation.  Without conversations there is no node, not even a root.
    Other columns are ignored.
    """
    turns, turnless = rebuilt_turns(light_turns(conversations))
    turns = checkpointed(turns)
    zero = F.lit(0).cast("long")
    member = F.struct(F.xxhash64("conv_id").alias("order"), F.col("conv_id").alias("id"))
    merged = (F.min("conv_id").alias("conv_id"), F.min(member).alias("first"), F.count("*").alias("n_convs"))
    nodes = turns.groupBy(*NODE).agg(*merged, F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    everyone = turns.where("depth = 1").select("conv_id").unionByName(turnless)
    root = everyone.agg(*merged).where("n_convs > 0").select(*(zero.alias(c) for c in NODE), "conv_id", "first", "n_convs", *(zero.alias(c) for c in ("words", "p1", "p2")))
    nodes = checkpointed(nodes.unionByName(root).withColumn("label", F.col("first.id")).drop("first"))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, NODE, "left").fillna(0, ["n_children"])
    # the root is the parent of very many; it is one row
    top = root.select("conv_id", F.col("first.id")).first() or (None, None)
    above = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("label").alias("above"))
    deep = nodes.where("depth > 1").join(above, ["depth", "p1", "p2"])
    flat = nodes.where("depth <= 1").withColumns({n: F.when(F.col("depth") == 1, F.lit(v).cast("long")) for n, v in zip(("parent_conv_id", "above"), top)})
    linked = deep.unionByName(flat).select("conv_id", "label", "above", *NODE, "parent_conv_id", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"))
    totals = with_totals(checkpointed(linked))
    ends = turns.where("last").select(*NODE, "conv_id").unionByName(turnless.select(*(zero.alias(c) for c in NODE), "conv_id"))
    out = totals.join(digests_of_ends(ends), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
