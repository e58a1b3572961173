"""Toxicity by class-conditional Kneser-Ney models of words.

For each class the chance of a word after another is its discounted count in that class, interpolated with the chance of
the word alone, and that with the shared backoff: of all different pairs of neighbours in the whole corpus that end with a
word of the models, the share that ends with this one.  The mass that the discounts set free is the same for both
classes, so that what neither class has says nothing.  Counts are of documents.  The discounts of what one, two, and three
or more documents of a class have come from the counts of counts (Chen and Goodman's), each below the count itself.

A whole text is judged by three comparisons of its two length-normalised log-likelihoods: of the models of words; of
the models of words after a word, less the former; and of models in which any one word may come from the toxic class
and all others from the ordinary one, where each word counts by its ratio's power ``POWER``, shrunk by the documents
behind it.  Every word of the text has a part in each.  A logistic curve of the three, fitted with both classes weighted alike
on rows that the models have not seen, makes them a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farstray.llm import packed
from farstray.llm.common import checkpointed, crc_mod3, mix, run_hashes, slices, small_batches, tidy, word_hashes, word_spans

ORDER = 2
#: A word that ``n`` labelled texts have counts by n / (n + SHRINK) of its log ratio where single words are compared.
SHRINK = 1.0
POWER = 3.0
#: A discount is at least and at most so large a part of the count.
LEAST_DISCOUNT, MOST_DISCOUNT = 0.05, 0.95
#: The left neighbours of one word are dealt over so many ranges.
SALTS = 16

IS_GAP = np.zeros(256, dtype=bool)
IS_GAP[0x20] = True


@dataclass(frozen=True)
class Limits:
    """Bounds of the labelled rows that models are fitted on: rows and bytes of text for each class."""

    rows_per_class: int = 2_500
    bytes_per_class: int = 16 << 20


def text_words(column):
    """(first row, row, fingerprint) of the words of an Arrow text column, a slice at a time; a word is a run of letters."""
    import pyarrow.compute as pc

    letters = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\pL\pM]+", " ")
    for at, offsets, data in slices(letters):
        start, end, row = word_spans(offsets, data, IS_GAP)
        yield at, len(offsets) - 1, row, word_hashes(data, start, end)


def grams(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the last word, fingerprint, fingerprint without the last word) of all runs of ``size`` words within rows."""
    if size == 1:
        return np.arange(len(words)), words, np.zeros(len(words), dtype=np.uint64)
    runs = run_hashes(words, size)
    inside = np.flatnonzero(row[: len(runs)] == row[size - 1 : size - 1 + len(runs)])
    before = run_hashes(words, size - 1)[inside] if size > 2 else words[inside]
    return inside + size - 1, runs[inside], before


# --- models -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Table:
    """Sorted fingerprints with some numbers each."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return Table(keys[order], np.ascontiguousarray(values[order]))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``keys`` that are in the table, and their values."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), self.values
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        return hit, self.values[at[hit]]


@dataclass(frozen=True)
class Models:
    """Both classes' models.  Words: the chances (ordinary, toxic), the shares of their backoff as contexts, and the shrunk
    log ratio.  Pairs of words: the discounted shares."""

    words: Table
    pairs: Table

    def steps(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the log ratio (toxic to ordinary) alone, what the word before adds to it, and the shrunk ratio."""
        n = len(words)
        chance, backoff, shrunk = np.ones((n, 2)), np.ones((n, 2)), np.zeros(n)  # of a word that no class has, only the ratio is of use
        hit, found = self.words.find(words)
        chance[hit], backoff[hit], shrunk[hit] = found[:, :2], found[:, 2:4], found[:, 4]
        alone, more = np.log(chance[:, 1] / chance[:, 0]), np.zeros(n)
        at, runs, _ = grams(words, row, 2)
        if len(at):
            after = backoff[at - 1] * chance[at]
            hit, found = self.pairs.find(runs)
            after[hit] += found
            more[at] = np.log(after[:, 1] / after[:, 0]) - alone[at]
        return alone, more, shrunk

    def measures(self, column) -> np.ndarray:
        """The three comparisons of each text; zeros for one without words."""
        out = np.zeros((len(column), 3))
        for at, n, row, words in text_words(column):
            if not len(words):
                continue
            alone, more, shrunk = self.steps(words, row)
            length = np.maximum(np.bincount(row, minlength=n), 1)
            for k, part in enumerate((alone, more)):
                out[at : at + n, k] = np.bincount(row, weights=part, minlength=n) / length
            mean = np.bincount(row, weights=np.exp(POWER * shrunk), minlength=n) / length
            out[at : at + n, 2] = np.log(np.where(mean > 0, mean, 1)) / POWER
        return out


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """The discounts (index: the count, 3 for more) from how many runs have a count of one, two, three and four."""
    n = np.r_[0.0, of_counts]
    rest = n[1] / max(n[1] + 2 * n[2], 1.0)
    out = np.zeros(4)
    for k in (1, 2, 3):
        own = k - (k + 1) * rest * n[k + 1] / n[k] if n[k] else k / 2
        out[k] = np.clip(own, LEAST_DISCOUNT * k, MOST_DISCOUNT * k)
    return out


def less(counts: np.ndarray, by_class: np.ndarray) -> np.ndarray:
    """(n, 2) counts without the discounts (2, 4) of their class."""
    return np.stack([counts[:, c] - by_class[c][np.minimum(counts[:, c], 3).astype(np.int64)] for c in (0, 1)], axis=1)


def shares(context: np.ndarray, counts: np.ndarray, own: np.ndarray):
    """Discounted shares (n, 2) of runs sorted by context, and (first run, backoffs (m, 2)) of the contexts.

    ``counts`` has the ordinary and the toxic documents of each run, ``own`` the same less the discounts.  A context keeps, in
    both classes, the share that the discounts leave of the counts of both; a class without it takes the shorter context instead.
    """
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, dtype=np.int64)
    if not len(first):
        return own, first, np.ones((0, 2))
    kept = np.add.reduceat(own, first)
    share = kept.sum(axis=1) / np.maximum(np.add.reduceat(counts, first).sum(axis=1), 1)
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(context)]))
    return share[of, None] * own / np.maximum(kept, 1e-300)[of], first, np.where(kept > 0, 1 - share[:, None], 1.0)


def models_of_counts(by_code: np.ndarray) -> list[np.ndarray]:
    """Counts (ordinary, toxic) for the three pairs of models (two halves, all) from counts by code."""
    return [by_code[:, :2], by_code[:, 2:], by_code[:, :2] + by_code[:, 2:]]


def _counted(sample: DataFrame) -> list[list[np.ndarray]]:
    """(keys, values) of words, pairs of words, contexts: counts less discounts, shares, backoffs for the three pairs of models
    (two halves, all); words have the documents of both classes last.

    Pairs come together by their context, words by themselves.  First counts of counts are made, which give the discounts.  What
    reaches the driver are the different words and pairs of a bounded sample.
    """
    n = 2 * packed.partitions(sample)

    def count(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def flush():
            key, context, code = map(np.concatenate, zip(*held))
            held.clear()
            order = np.lexsort((key, context))
            key, context, code = key[order], context[order], code[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])])
            one = np.uint64(1) << (np.uint64(16) * code.astype(np.uint64))
            counts = np.add.reduceat(one, first)
            key, context = key[first], context[first]
            to = packed.ranges(mix(np.where(context == 0, key, context)), n)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(n + 1))
            keys = [k for k in range(n) if cuts[k] < cuts[k + 1]]
            data = [packed.pack_pairs(context[o].view(np.int64), key[o], counts[o]) for o in (order[cuts[k] : cuts[k + 1]] for k in keys)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["range", "data"])

        waiting = 0
        for batch in batches:
            code = np.array(batch.column("code").to_pylist(), dtype=np.int64)
            for at, _, row, words in text_words(batch.column("text")):
                for size in range(1, ORDER + 1):
                    place, key, context = grams(words, row, size)
                    of = row[place]
                    order = np.lexsort((key, of))
                    key, context, of = key[order], context[order], of[order]
                    new = np.ones(len(key), dtype=bool)
                    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                    held.append((key[new], context[new], code[at + of[new]]))
                    waiting += int(new.sum())
                if waiting >= packed.FLUSH:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    def add(_, parts):
        import pyarrow as pa

        context, key, counts = map(np.concatenate, zip(*map(packed.unpack_pairs, parts)))
        context = context.view(np.uint64)
        order = np.lexsort((key, context))
        key, context = key[order], context[order]
        by_code = np.stack([(counts[order] >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)], axis=1).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])])
        key, context, by_code = key[first], context[first], np.add.reduceat(by_code, first)
        of_counts = [[(p[kind, c] == k).sum() for k in (1, 2, 3, 4)] for kind in (context == 0, context != 0) for p in models_of_counts(by_code) for c in (0, 1)]
        data = packed.pack_pairs(context.view(np.int64), key, *(c.astype(np.uint64) for c in by_code.T))
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([np.ravel(of_counts).tolist()], pa.list_(pa.int64()))], names=["data", "of_counts"])

    sent = sample.select("text", "code").mapInArrow(tidy(count), "range int, data binary")
    ranges = checkpointed(packed.by_range(sent, add, "data binary, of_counts array<long>"))
    found = np.array([r[0] for r in ranges.select("of_counts").collect()]).reshape(-1, 2, 3, 2, 4).sum(axis=0)  # a row a range
    cuts = np.array([discounts(n) for n in found.reshape(-1, 4).astype(float)]).reshape(2, 3, 2, 4)

    def share(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column("data"):
                context, key, *by_code = packed.unpack_pairs(data.as_py())
                context, by_code = context.view(np.uint64), np.stack(by_code, axis=1).astype(np.int64)
                pairs, word = models_of_counts(by_code), context == 0
                own = np.hstack([less(p[word], cuts[0, k]) for k, p in enumerate(pairs)])
                total = np.hstack([p[word].sum(axis=0) for p in pairs])[None]
                both = np.hstack([p[word].sum(axis=1, keepdims=True) for p in pairs])
                rows = [(0, key[word], own), (1, key[word], np.hstack([both, both * 0])), (4, np.zeros(1, dtype=np.uint64), total)]
                of = context[~word]
                if len(of):
                    parts = [shares(of, p[~word], less(p[~word], cuts[1, k])) for k, p in enumerate(pairs)]
                    rows.append((2, key[~word], np.hstack([p[0] for p in parts])))
                    rows.append((3, of[parts[0][1]], np.hstack([p[2] for p in parts])))
                kind = np.concatenate([np.full(len(k), n, dtype=np.int32) for n, k, _ in rows])
                key, values = np.concatenate([k for _, k, _ in rows]), np.concatenate([v for _, _, v in rows]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key.view(np.int64)), *map(pa.array, values.T)], names=["kind", "key", *"abcdef"])

    schema = "kind int, key long, " + ", ".join(f"{c} float" for c in "abcdef")
    table = ranges.select("data").mapInArrow(tidy(share), schema).toArrow()
    kind, key = table["kind"].to_numpy(), table["key"].to_numpy().view(np.uint64)
    values = np.stack([table[c].to_numpy() for c in "abcdef"], axis=1).reshape(-1, 6)
    return [(key[kind == k], values[kind == k]) for k in range(5)]


def _left_neighbours(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many different words (or a text's begin) stand before each of ``vocabulary`` (sorted, not empty) in all texts.

    A pair of words of the vocabulary is known by their places, which are dense numbers and travel in about two bytes; of other
    neighbours as many bits of the fingerprint are kept as 64 leave (over 40 for millions of words).  A word's neighbours are dealt
    over ``SALTS`` ranges.
    """
    n, size = 2 * packed.partitions(docs), len(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    left = np.uint64(64 - max(1, int(size - 1).bit_length()))
    salts, own = np.uint64(SALTS), np.uint64(size)
    width = np.uint64(size // SALTS + 1)  # places of neighbours with one salt; a text's begin has place ``size``
    each = np.uint64(-(-(SALTS * size * (size // SALTS + 1)) // n))

    def pack(kind: int, pairs: np.ndarray, to: np.ndarray):
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(n + 1))
        for k in np.flatnonzero(cuts[:-1] < cuts[1:]).tolist():
            # steps of sorted numbers by significance: the high bytes are zeros
            steps = np.diff(pairs[order[cuts[k] : cuts[k + 1]]], prepend=np.uint64(0))
            yield k, bytes([kind]) + packed.squeeze(steps.view(np.uint8).reshape(-1, 8).T.tobytes())

    def send(batches):
        import pyarrow as pa

        held: list[list[np.ndarray]] = [[], []]

        def merged():
            for kind in (0, 1):
                held[kind] = [np.unique(np.concatenate(held[kind]))] if held[kind] else []
            return sum(len(h) for parts in held for h in parts)

        def flush():
            rows = [row for pairs in held[0] for row in pack(0, pairs, (pairs // each).astype(np.int32))]
            rows += [row for pairs in held[1] for row in pack(1, pairs, packed.ranges(mix((pairs >> left) * salts + (pairs & (salts - np.uint64(1)))), n))]
            held[:] = [[], []]
            keys, data = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["range", "data"])

        waiting = 0
        for batch in batches:
            for _, _, row, words in text_words(batch.column(0)):
                if not len(words):
                    continue
                known, at = packed.is_in(shared.value, words)
                place = at.astype(np.uint64)
                begin = np.r_[True, row[1:] != row[:-1]]
                before = np.r_[np.uint64(0), place[:-1]]
                before[begin] = own
                dense = known & (begin | np.r_[False, known[:-1]])
                held[0].append(np.unique((before[dense] % salts * own + place[dense]) * width + before[dense] // salts))
                other = np.flatnonzero(known & ~dense)
                held[1].append(np.unique((place[other] << left) | (mix(words[other - 1]) >> (np.uint64(64) - left))))
                waiting += len(held[0][-1]) + len(held[1][-1])
                if waiting >= 4 * packed.FLUSH:
                    waiting = merged()
                    if waiting >= 3 * packed.FLUSH:
                        yield flush()
                        waiting = 0
        if merged():
            yield flush()

    def add(_, parts):
        import pyarrow as pa

        found: list[list[np.ndarray]] = [[], []]
        held, most = [0, 0], [packed.FLUSH] * 2
        for part in parts:
            steps = np.frombuffer(packed.unsqueeze(part[1:]), dtype=np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1)
            found[part[0]].append(np.cumsum(steps, dtype=np.uint64))
            held[part[0]] += len(steps)
            if held[part[0]] >= most[part[0]]:  # equal pairs of many tasks are held once
                found[part[0]] = [np.unique(np.concatenate(found[part[0]]))]
                held[part[0]] = len(found[part[0]][0])
                most[part[0]] = packed.FLUSH + 2 * held[part[0]]
        pairs = [np.unique(np.concatenate(f)) if f else np.zeros(0, dtype=np.uint64) for f in found]
        word, count = np.unique(np.concatenate([pairs[0] // width % own, pairs[1] >> left]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(count.astype(np.int64))], names=["word", "n"])

    rows = docs.select("text").mapInArrow(tidy(send), "range int, data binary")
    found = packed.by_range(rows, add, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # a row a word
    out = np.ones(size)
    out[found["word"].to_numpy()] = found["n"].to_numpy()
    shared.unpersist()
    return out


def _models(counted: list[tuple[np.ndarray, np.ndarray]], before: np.ndarray) -> list[Models]:
    """The models of the two halves and of all; ``before`` are the left neighbours of the words in sorted order."""
    (words, own), (_, documents), (runs, part), (contexts, backoff), (_, totals) = counted
    order = np.argsort(words)
    words, own, documents, totals = words[order], own[order].astype(float), documents[order], totals.sum(axis=0, dtype=float)
    at, hit = _joined(words, contexts)
    sorted_runs = np.argsort(runs)
    runs, part = runs[sorted_runs], part[sorted_runs]
    out = []
    for k in range(3):
        of = slice(2 * k, 2 * k + 2)
        mass = own[:, of].sum(axis=0)
        share = mass.sum() / max(totals[of].sum(), 1)
        kept = share if (mass > 0).all() else 0.0  # against a class without words, words say nothing
        chance = kept * own[:, of] / np.maximum(mass, 1e-300) + (1 - kept) * (before / before.sum())[:, None]
        values = np.ones((len(words), 5))
        values[:, :2] = chance
        values[at, 2:4] = backoff[hit, of]
        values[:, 4] = np.log(chance[:, 1] / chance[:, 0]) * documents[:, k] / (documents[:, k] + SHRINK)
        out.append(Models(Table(words, values), Table(runs, np.ascontiguousarray(part[:, of]))))
    return out


def _joined(keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal keys in two arrays without repeats."""
    _, at, hit = np.intersect1d(keys, others, assume_unique=True, return_indices=True)
    return at, hit


# --- calibration and scores -------------------------------------------------------------------------------------------


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps with a small ridge; the intercept is last and free."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class ToxicityModel:
    models: Models
    weights: np.ndarray
    intercept: float

    def probability(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures @ self.weights + self.intercept, -30, 30)))


_NONE = np.zeros(0, dtype=np.uint64)
EMPTY = Models(Table(_NONE, np.ones((0, 5))), Table(_NONE, np.ones((0, 2))))


def labelled_sample(docs: DataFrame, labels: DataFrame, limits: Limits) -> DataFrame:
    """text, toxic, half of the labelled texts that models are fitted on; each different text of a class once.

    Of each class rows are taken in the order of a hash of doc_id, within the bounds of ``limits``.  Halves go by the text, so that
    copies are in one half.
    """
    clean = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    clean = clean.withColumn("order", F.xxhash64("doc_id"))
    parts = [clean.where(F.col("toxic") == k).orderBy("order", "doc_id").limit(limits.rows_per_class) for k in (0, 1)]
    chosen = checkpointed(parts[0].unionByName(parts[1]))  # at most twice rows_per_class
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    # a doc_id may have many texts: the bounds are held by their keys and sizes, which are small
    sizes = texts.groupBy("toxic", "key").agg(F.min("order").alias("order"), F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).alias("size"))
    parts = [sizes.where(F.col("toxic") == k).orderBy("order", "doc_id", "key").limit(limits.rows_per_class) for k in (0, 1)]
    before = F.sum("size").over(Window.partitionBy("toxic").orderBy("order", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1))
    kept = parts[0].unionByName(parts[1]).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limits.bytes_per_class)
    kept = checkpointed(kept.select("toxic", "key"))
    texts = texts.join(F.broadcast(kept), ["toxic", "key"]).select("text", "toxic", "key").dropDuplicates(["toxic", "key"])
    half = F.pmod(F.col("key"), F.lit(2)).cast("int")
    texts = texts.select("text", "toxic", half.alias("half"))
    return checkpointed(texts.withColumn("code", F.col("half") * 2 + F.col("toxic")).repartition(max(1, packed.partitions(docs) // 2)))


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> ToxicityModel:
    """Learn from labelled rows; ``labels`` has doc_id and toxic (0 or 1; other values and nulls are left out).

    Labelled rows are bounded by ``limits``; the counts of the shared backoff cover all documents.  Of repeated labels of
    a document the toxic one counts.  Without texts of both classes every text scores the share of toxic ones (0 without any).
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_sample(docs, labels, limits)
    rows = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(rows) < 2:
        p = min(max(1.0 if 1 in rows else 0.0, 1e-9), 1 - 1e-9)
        return ToxicityModel(EMPTY, np.zeros(3), float(np.log(p / (1 - p))))
    counted = _counted(sample)
    vocabulary = np.sort(counted[0][0])
    if not len(vocabulary):
        models = [EMPTY] * 3
    else:
        models = _models(counted, _left_neighbours(docs, vocabulary))
    halves = spark.sparkContext.broadcast(models[:2])

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            # each row is measured by the models of the other half
            own = np.array(batch.column("half").to_pylist())
            both = [m.measures(batch.column("text")) for m in halves.value]
            x = np.where((own == 0)[:, None], both[1], both[0])
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column("toxic")], names=[*"abc", "toxic"])

    seen = sample.select("text", "toxic", "half").mapInArrow(tidy(measure), "a double, b double, c double, toxic int").toArrow()
    halves.destroy()
    x, y = np.stack([seen[c].to_numpy() for c in "abc"], axis=1), seen["toxic"].to_numpy().astype(float)
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    *slopes, intercept = logistic((x - center) / scale, y, weight)
    weights = np.array(slopes) / scale
    return ToxicityModel(models[2], weights, float(intercept - weights @ center))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted of every whole text; ``keep`` names further columns to carry.

    A null or empty text, or one without letters, gets the curve's value at 0.  Repeated rows are scored each.
    """
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = docs.select("doc_id", *(c for c in dict.fromkeys([*keep, "text"])))
    schema = carried.select("doc_id", *keep).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = shared.value.probability(shared.value.models.measures(batch.column("text")))
            columns = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", *keep, "score", "predicted"])

    return carried.mapInArrow(tidy(run), schema)


def fit_held_out(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> ToxicityModel:
    """``fit`` on the labelled rows whose crc32(doc_id) mod 3 is not 1; the others are held out."""
    return fit(docs, labels.where(crc_mod3("doc_id") != 1), limits)


def toxicity(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by the model of the rows that are not held out.

    A row without a doc_id has no label and is not held out.
    """
    scored = score(docs, fit_held_out(docs, labels, limits))
    return scored.select("doc_id", F.coalesce(crc_mod3("doc_id") == 1, F.lit(False)).alias("held_out"), "score", "predicted")
