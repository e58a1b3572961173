"""Exact nearest neighbours by boxes: no row is compared with a block of rows that can't hold one of its neighbours.

``Boxes`` arranges the points of one task as a k-d tree of small leaves and looks leaves up by the least distance that their boxes allow.
``exact_neighbours`` does the same with a table: a k-d tree of a bounded sample deals its rows into blocks, each row first looks at its own
block, then at the few blocks nearest to it, and last at all others whose box is not farther than its k-th neighbour so far.
Distances are sums of squared differences, column by column, at every size; ties go to the smaller key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farstray.functions.checkpoints import checkpointed

#: Points of a leaf within a task.
LEAF = 128
#: Rows of a block, and how many blocks there are at most; beyond blocks x rows, blocks have more rows and tasks more leaves.
BLOCK, MOST_BLOCKS = 2000, 16_384
#: Points that the driver samples for each block to cut them.
SAMPLED = 16
#: Blocks that a row visits next to its own before its k-th distance is brought up to date.
FIRST = 6
#: Visitors of a block that one task takes.
VISITORS = 50_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        total += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(total)


@dataclass
class Tree:
    """A k-d tree: inner nodes cut ``axis`` at ``cut`` (less goes left), leaves have the number ``leaf`` (-1 elsewhere)."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        live = np.arange(len(x))
        while len(live):
            live = live[self.leaf[at[live]] < 0]
            node = at[live]
            at[live] = np.where(x[live, self.axis[node]] < self.cut[node], self.left[node], self.right[node])
        return self.leaf[at]


def cut_tree(x: np.ndarray, most: int) -> Tree:
    """Halves the widest column until ``most`` points are left in a leaf, or equal ones."""
    axis, cut, left, right, leaf = [], [], [], [], []
    leaves, todo = 0, [(np.arange(len(x)), -1, False)]
    while todo:
        rows, parent, is_right = todo.pop()
        me = len(axis)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        part = x[rows]
        width = part.max(axis=0) - part.min(axis=0) if len(rows) else np.zeros(x.shape[1])
        a = int(np.argmax(width))
        values = np.sort(part[:, a]) if len(rows) else part[:, a]
        c = values[len(rows) // 2] if len(rows) else 0.0
        if len(rows) > most and width[a] > 0:
            c = c if c > values[0] else values[np.searchsorted(values, c, side="right")]  # both sides get some
            below = part[:, a] < c
            for lst, v in zip((axis, cut, left, right, leaf), (a, c, -1, -1, -1)):
                lst.append(v)
            todo += [(rows[below], me, False), (rows[~below], me, True)]
        else:
            for lst, v in zip((axis, cut, left, right, leaf), (0, 0.0, -1, -1, leaves)):
                lst.append(v)
            leaves += 1
    return Tree(np.array(axis), np.array(cut, dtype=float), np.array(left), np.array(right), np.array(leaf))


class Boxes:
    """Points of one task; ``codes`` are numbers that order them among equal distances and tell a point from itself."""

    def __init__(self, x: np.ndarray, codes: np.ndarray):
        self.tree = cut_tree(x, LEAF)
        leaf = self.tree.leaf_of(x)
        order = np.argsort(leaf, kind="stable")
        self.x, self.codes, self.place = x[order], codes[order], order
        self.begin = np.r_[np.flatnonzero(np.diff(leaf[order], prepend=-1)), len(x)]
        self.low = np.array([self.x[b:e].min(axis=0) for b, e in zip(self.begin, self.begin[1:])])
        self.high = np.array([self.x[b:e].max(axis=0) for b, e in zip(self.begin, self.begin[1:])])

    def nearest(self, q: np.ndarray, k: int, reach: np.ndarray | None = None, own: np.ndarray | None = None):
        """(row of ``q``, place of the point, distance) of the ``k`` nearest points not farther than ``reach``, in order of row, distance and code.

        Points whose code is the row's ``own`` are left out.
        """
        parts = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
        order = np.argsort(self.tree.leaf_of(q), kind="stable")
        for at in range(0, len(q), LEAF):
            rows = order[at : at + LEAF]
            found = self._group(q[rows], k, None if reach is None else reach[rows], None if own is None else own[rows])
            parts.append((rows[found[0]], self.place[found[1]], found[2]))
        row, place, d = (np.concatenate(p) for p in zip(*parts))
        by_row = np.argsort(row, kind="stable")
        return row[by_row], place[by_row], d[by_row]

    def _group(self, q: np.ndarray, k: int, reach: np.ndarray | None, own: np.ndarray | None):
        gap = np.maximum(np.maximum(self.low - q.max(axis=0), q.min(axis=0) - self.high), 0)
        bound = np.sqrt((gap**2).sum(axis=1)) * (1 - 1e-12)  # never above a distance, however sums are rounded
        order = np.argsort(bound, kind="stable")
        far = np.full(len(q), np.inf) if reach is None else reach.astype(float).copy()
        row, place, d = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        at, step = 0, max(2, -(-2 * k // LEAF))
        while at < len(order) and bound[order[at]] <= far.max():
            leaves = order[at : at + step]
            leaves = leaves[bound[leaves] <= far.max()]
            at, step = at + step, min(2 * step, 64)
            cols = np.concatenate([np.arange(self.begin[i], self.begin[i + 1]) for i in leaves])
            new = distances(q, self.x[cols])
            if own is not None:
                new[own[:, None] == self.codes[cols][None]] = np.inf
            if new.shape[1] >= k:
                far = np.minimum(far, np.partition(new, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero((new <= far[:, None]) & np.isfinite(new))
            row, place, d = np.r_[row, r], np.r_[place, cols[c]], np.r_[d, new[r, c]]
            by = np.lexsort((self.codes[place], d, row))
            row, place, d = row[by], place[by], d[by]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, place, d, rank = row[rank < k], place[rank < k], d[rank < k], rank[rank < k]
            far[row[rank == k - 1]] = np.minimum(far[row[rank == k - 1]], d[rank == k - 1])
        return row, place, d


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


@dataclass
class Blocks:
    """The tree that deals rows into blocks, and the boxes of all its nodes as the rows fill them."""

    tree: Tree
    low: np.ndarray
    high: np.ndarray

    def reached(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, least distance) of all blocks not farther than a row's ``reach``, found by descending the tree."""
        row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        out = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
        while len(row):
            gap = np.maximum(np.maximum(self.low[node] - x[row], x[row] - self.high[node]), 0)
            bound = np.sqrt((gap**2).sum(axis=1)) * (1 - 1e-12)
            near = bound <= reach[row]
            row, node, bound = row[near], node[near], bound[near]
            leaf = self.tree.leaf[node]
            out.append((row[leaf >= 0], leaf[leaf >= 0], bound[leaf >= 0]))
            row, node = row[leaf < 0], node[leaf < 0]
            row, node = np.r_[row, row], np.r_[self.tree.left[node], self.tree.right[node]]
        return tuple(np.concatenate(p) for p in zip(*out))


def _blocks(points: DataFrame, n: int, width: int, block: int) -> tuple[DataFrame, object]:
    """``points`` with their block, checkpointed, and a broadcast ``Blocks``."""
    spark = points.sparkSession
    wanted = max(1, min(MOST_BLOCKS, -(-n // block)))
    few = points if n <= wanted * SAMPLED else points.where(F.pmod(F.xxhash64("name", F.lit(17)), F.lit(1 << 30)) < int(wanted * SAMPLED / n * (1 << 30)))
    sample = _matrix(few.select("x").toPandas()["x"], width) if wanted > 1 else np.zeros((1, width))
    tree = cut_tree(sample, max(1, -(-len(sample) // wanted)))
    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def block_of(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaf_of(_matrix(x, width)), dtype="int32")

    dealt = checkpointed(points.withColumn("block", block_of("x")))
    ends = dealt.groupBy("block").agg(*(f(F.get("x", F.lit(i))).alias(f"{name}{i}") for i in range(width) for name, f in (("l", F.min), ("h", F.max)))).toPandas()  # a row for each block
    leaves = int(tree.leaf.max()) + 1
    low, high = np.full((leaves, width), np.inf), np.full((leaves, width), -np.inf)
    for i in range(width):
        low[ends["block"], i], high[ends["block"], i] = ends[f"l{i}"], ends[f"h{i}"]
    boxes = Blocks(tree, np.full((len(tree.leaf), width), np.inf), np.full((len(tree.leaf), width), -np.inf))
    for node in range(len(tree.leaf) - 1, -1, -1):  # children come after their parent
        own = tree.leaf[node] >= 0
        boxes.low[node] = low[tree.leaf[node]] if own else np.minimum(boxes.low[tree.left[node]], boxes.low[tree.right[node]])
        boxes.high[node] = high[tree.leaf[node]] if own else np.maximum(boxes.high[tree.left[node]], boxes.high[tree.right[node]])
    return dealt, spark.sparkContext.broadcast(boxes)


def visits_of(state: DataFrame, boxes, done: int, most: int | None, width: int) -> DataFrame:
    """block, name, x, reach of each block that a row of ``state`` still has to look at.

    A row's own block is behind it; of the others in order of distance so are the first ``done``, and ``most`` come next (all, if None).
    """

    def run(batches):
        for pdf in batches:
            x, own, reach = _matrix(pdf["x"], width), pdf["block"].to_numpy(), pdf["reach"].to_numpy(dtype=float)
            for at in range(0, len(pdf), 1000):
                part = slice(at, at + 1000)
                row, block, bound = boxes.value.reached(x[part], reach[part])
                other = block != own[part][row]
                row, block, bound = row[other], block[other], bound[other]
                by = np.lexsort((block, bound, row))
                row, block = row[by], block[by]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = (rank >= done) & (rank < (np.inf if most is None else done + most))
                chosen = pdf.iloc[row[keep] + at]
                yield pd.DataFrame({"block": block[keep].astype("int32"), "name": chosen["name"].to_numpy(), "x": chosen["x"].to_numpy(), "reach": chosen["reach"].to_numpy()})

    return state.select("block", "name", "x", "reach").mapInPandas(run, "block int, name string, x array<double>, reach double")


def _found(visits: DataFrame, points: DataFrame, k: int, width: int) -> DataFrame:
    """name, d, j of the points of the visited blocks that are among the k nearest there and within reach."""
    parts = visits.groupBy("block").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    # a block with many visitors is sent to several tasks, each of which takes a share of them
    visits = visits.select(F.col("block").alias("to"), F.col("name").alias("who"), F.col("x").alias("at"), "reach").join(parts, F.col("to") == parts["block"])
    visits = visits.select("to", F.pmod(F.xxhash64("who"), F.col("parts")).cast("int").alias("share"), "who", "at", "reach")
    held = points.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "name", "x")

    def search(visitors: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(visitors) or not len(held):
            return pd.DataFrame({"name": [], "d": [], "j": []})
        held = held.sort_values("name", kind="stable")
        names = held["name"].to_numpy()
        row, place, d = Boxes(_matrix(held["x"], width), np.arange(len(held))).nearest(_matrix(visitors["at"], width), k, visitors["reach"].to_numpy(dtype=float))
        return pd.DataFrame({"name": visitors["who"].to_numpy()[row], "d": d, "j": names[place]})

    return visits.groupBy("to", "share").cogroup(held.groupBy("block", "part")).applyInPandas(search, "name string, d double, j string")


def exact_neighbours(points: DataFrame, k: int, width: int, block: int = BLOCK) -> DataFrame:
    """name and near, the ``k`` nearest other rows as structs (d, j) in order of distance and key, of every row of ``points`` (name, x).

    Names are distinct texts, x arrays of ``width`` finite numbers.  Rows at one place share a search: the k + 1 first keys of a place are
    all that can be anyone's neighbours, so a crowded place is no crowded block.  With k rows or fewer all others are returned.
    """
    first = F.row_number().over(Window.partitionBy("x").orderBy("name"))
    places = checkpointed(points.select("name", "x", first.alias("at")).where(F.col("at") <= k + 1))  # cut down before the shuffle, too
    n = places.count()
    dealt, boxes = _blocks(places, n, width, block)
    searching = dealt.where("at = 1").select("block", "name", "x", F.lit(float("inf")).alias("reach"))

    def merged(state: DataFrame, found: DataFrame) -> DataFrame:
        """``state`` with the k + 1 best of what it had and what was found."""
        both = state.select("name", F.explode("near").alias("e")).select("name", "e.d", "e.j").unionByName(found) if "near" in state.columns else found
        best = both.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "j"))), 1, k + 1).alias("near"))
        reach = F.when(F.size("near") == k + 1, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
        return checkpointed(state.select("block", "name", "x").join(best, "name").withColumn("reach", reach))

    state = merged(searching, _found(searching, dealt, k + 1, width))
    done = 0
    for most in (FIRST, None):
        left = checkpointed(visits_of(state, boxes, done, most, width))
        if not left.isEmpty():
            state = merged(state, _found(left, dealt, k + 1, width))
        done += most or 0
    of_place = state.select("x", "near")
    near = F.slice(F.filter("near", lambda e: e["j"] != F.col("name")), 1, k)
    return points.select("name", "x").join(of_place, "x").select("name", near.alias("near"))
