"""Exact top-k by inner product: score all, refine global score histograms to each kth value, then filter.

Queries are dealt into blocks of a fixed number of rows; a round of passes over the candidates serves one block, which
is broadcast.  In each pass a task counts its scores by bins of the interval that still holds a query's kth score, the
counts are added over all tasks, and the interval shrinks to one bin, until it is one integer wide.  A last pass keeps
what is above that value and, of the ties at it, the smallest ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farstray.llm.common import checkpointed, tidy

EXACT_FLOAT = 2**53
EXACT_LONG = 2**63


def _vectors(batch, scale: float):
    """(ids, integer-valued float64 matrix) for each dimension in an Arrow batch of vec_id and embedding."""
    import pyarrow as pa

    lists = batch.column("embedding")
    lists = lists.cast(pa.large_list(pa.float64()))
    offsets = np.asarray(lists.offsets)
    flat = np.floor(scale * lists.values.to_numpy(zero_copy_only=False))
    size = np.diff(offsets)
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), ids[rows], flat[offsets[rows][:, None] + np.arange(d)]


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64; beyond the range of a long it raises."""
    if not c.shape[1]:
        return np.zeros((len(c), len(q)), dtype=np.int64)
    bound = c.shape[1] * float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0))
    if bound < EXACT_FLOAT:
        return np.rint(c @ q.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in q]
    exact = [[sum(x * y for x, y in zip(map(int, row), other)) for other in whole] for row in c]
    return np.array(exact, dtype=object).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components; others take no part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: float = 1024.0, block: int = 1024, bins: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller vec_id.

    Vectors are floored to integers after scaling.  A candidate with the query's own id is left out; vectors of another
    dimension than the query's have no score with it.  A query row that is repeated counts once, a repeated candidate
    row as often as it is there; of two different vectors under one query id the answer holds both.
    """
    spark = candidates.sparkSession
    queries = checkpointed(usable(queries).dropDuplicates(["vec_id", "embedding"]))
    n = queries.count()
    candidates = usable(candidates)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(1, -(-n // block))
    dealt = checkpointed(queries.repartition(blocks).withColumn("block", F.spark_partition_id()))
    widest = candidates.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double"))))).first()[0] or 0.0
    parts = []
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).select("vec_id", "embedding").toArrow()  # at most block + 1 rows
        if rows.num_rows:
            parts.append(_of_block(rows, candidates, k, scale, bins, np.ceil(scale * widest) + 1))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _of_block(rows, candidates: DataFrame, k: int, scale: float, bins: int, widest: float) -> DataFrame:
    spark = candidates.sparkSession
    by_dim, at = {}, 0
    for batch in rows.combine_chunks().to_batches():
        for d, ids, q in _vectors(batch, scale):
            old = by_dim.get(d)
            by_dim[d] = (ids, q) if old is None else (np.concatenate([old[0], ids]), np.vstack([old[1], q]))
    own = []
    for d, (ids, q) in by_dim.items():
        by_dim[d] = (ids, q, at)  # at: number of the first query
        own.append(ids)
        at += len(ids)
    own = np.concatenate(own)
    queries = spark.sparkContext.broadcast(by_dim)
    high = int(max(1, *(d * widest * (np.abs(q).max(initial=0) + 1) for d, (_, q, _) in by_dim.items()))) + 1
    low = np.full(at, -high, dtype=object)
    width, above = 2 * high + 1, np.zeros(at, dtype=np.int64)  # interval: low .. low + width - 1
    open_ = np.ones(at, dtype=bool)
    while width > 1:
        step = -(-width // bins)
        state = (low.copy(), step, width)

        def count(batches, state=state):
            import pyarrow as pa

            low, step, width = state
            counts = np.zeros((at, bins), dtype=np.int64)
            for batch in batches:
                for d, ids, c in _vectors(batch, scale):
                    if d not in queries.value:
                        continue
                    own_ids, q, first = queries.value[d]
                    for r in range(0, len(ids), 2048):
                        s = _scores(c[r : r + 2048], q)
                        for j in range(len(own_ids)):
                            x = s[ids[r : r + 2048] != own_ids[j], j]
                            x = x[x >= int(low[first + j])] - int(low[first + j])
                            x = x[x < width] // step
                            counts[first + j] += np.bincount(x, minlength=bins)
            # below the bin in which this task alone has k scores there can't be the kth of all
            later = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            i, j = np.nonzero((counts > 0) & (later < k))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(counts[i, j])], names=["query", "bin", "n"])

        found = candidates.mapInArrow(tidy(count), "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("query").orderBy(F.col("bin").desc())
        found = found.withColumn("upto", F.sum("n").over(w)).withColumn("left", F.col("upto") - F.col("n"))
        needed = spark.createDataFrame([(int(i), int(k - above[i])) for i in range(at)], "query int, needed long")
        found = found.join(F.broadcast(needed), "query").where((F.col("left") < F.col("needed")) & (F.col("upto") >= F.col("needed")))
        hit = {r["query"]: (r["bin"], r["left"]) for r in found.select("query", "bin", "left").collect()}  # a row a query
        for i in range(at):
            if i in hit:
                low[i] += hit[i][0] * step
                above[i] += hit[i][1]
            else:  # fewer than k candidates in all: everything is kept
                open_[i] = False
        width = step
    state = (low, above, open_)

    def keep(batches):
        import pyarrow as pa

        low, above, open_ = state
        ties: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, ids, c in _vectors(batch, scale):
                if d not in queries.value:
                    continue
                own_ids, q, first = queries.value[d]
                for r in range(0, len(ids), 2048):
                    s, part = _scores(c[r : r + 2048], q), ids[r : r + 2048]
                    for j, own_id in enumerate(own_ids):
                        i = first + j
                        other = part != own_id
                        better = other & ((s[:, j] > int(low[i])) if open_[i] else True)
                        rows = np.flatnonzero(better)
                        if len(rows):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i), pa.int32()), pa.array(np.full(len(rows), own_id), pa.int64()), pa.array(part[rows], pa.int64()), pa.array(s[rows, j])], names=["query", "query_id", "vec_id", "score"])
                        if open_[i]:
                            equal = part[other & (s[:, j] == int(low[i]))]
                            if len(equal):
                                ties[i] = np.sort(np.concatenate([ties.get(i, equal[:0]), equal]))[: k - int(above[i])]
        for i, equal in ties.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(equal), i), pa.int32()), pa.array(np.full(len(equal), own[i]), pa.int64()), pa.array(equal, pa.int64()), pa.array(np.full(len(equal), int(low[i])), pa.int64())], names=["query", "query_id", "vec_id", "score"])

    kept = candidates.mapInArrow(tidy(keep), "query int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
