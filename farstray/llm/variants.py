"""Spelling variants: words one edit apart, found by the half that the edit leaves whole.

Words and their counts come from whole texts.  An edit spares one half of a word, and of the other half one half again.
Shards of the vocabulary hold an Aho-Corasick automaton of both halves of their words; every word is scanned by the shards that can
hold a match, a hit must lie at the word's begin or end and belong to a length that one edit can reach, and what is left is compared.
A shard is chosen by the intact half *and* the intact half of the rest, so that words with a common beginning or ending don't
come together in one: a group has as many members as words differ in one quarter only.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farstray.llm.common import checkpointed, sized, small_batches, tidy

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Different words that a task counts before it passes them on.
HELD = 100_000
#: Words (four times each) in the automaton of a shard, about.
SHARD_WORDS = 12_000
#: A maximal run of letters; shorter ones can't become words.
RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all runs of letters, A-Z lowered and every 97th, by a checksum of document and run, short of one letter.

    Null texts have no words; a null doc_id counts as an empty one.  Rows are independent.  Tasks add up before the shuffle.
    """

    def run(batches):
        import pyarrow as pa

        def packed(held):
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # bytes.lower() changes A-Z alone
                runs = Counter(RUN.findall((text.as_py() or "").encode("utf-8").lower().decode("utf-8")))
                begun = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs.items():
                    h = crc32(word.encode("utf-8"), begun)
                    if not h % 97:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield packed(held)
                    held = Counter()
        if held:
            yield packed(held)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def route(word: str, length: int, i: int) -> tuple[bool, str, bool, str]:
    """The ``i``-th of four ways in which ``word`` could be one edit from a word of ``length``: which half is whole, its letters, which half of the rest is, its letters.

    Of words one edit apart at least one way is the same, with the length of the second.
    """
    h = length // 2
    if i < 2:
        seg, rest, m = word[:h], word[h:], length - h
    else:
        cut = len(word) - (length - h)
        seg, rest, m = word[cut:], word[:cut], h
    return i > 1, seg, bool(i % 2), rest[max(0, len(rest) - (m - m // 2)) :] if i % 2 else rest[: m // 2]


def shard_of(length: int, way: tuple[bool, str, bool, str], shards: int) -> int:
    right, seg, last, sub = way
    return crc32(f"{length} {right:d}{last:d} {seg} {sub}".encode()) % shards


def one_edit(u: str, v: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``v`` of ``u``."""
    if len(u) > len(v):
        u, v = v, u
    i, n = 0, len(u)
    while i < n and u[i] == v[i]:
        i += 1
    return u != v and (u[i + 1 :] == v[i + 1 :] if n == len(v) else n + 1 == len(v) and u[i:] == v[i + 1 :])


class Shard:
    """The automaton of the halves of the words that this shard holds."""

    def __init__(self) -> None:
        self.held: dict[str, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        self.automaton = None

    def add(self, word: str, n: int, i: int) -> None:
        right, seg, last, sub = route(word, len(word), i)
        self.held[seg][right, len(word), last, sub].append((word, n))

    def build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for seg, by_route in self.held.items():
            self.automaton.add_word(seg, (len(seg), by_route))
        self.automaton.make_automaton()

    def near(self, word: str, ways: int):
        """(word, n) of this shard one edit from ``word`` on the ``ways``, bits of 4 x (length - own length + 1) + route, that lead here.

        A pair that has several ways in common is found on all, and given for the first.
        """
        size, begins, ends = len(word), {}, {}
        for end, (s, by_route) in self.automaton.iter(word):
            if end + 1 == s:
                begins[s] = by_route
            if end + 1 == size:
                ends[s] = by_route
        for way in range(12):
            if not ways >> way & 1:
                continue
            length, i = size - 1 + way // 4, way % 4
            at = begins.get(length // 2) if i < 2 else ends.get(length - length // 2)
            if at is None:
                continue
            right, _, last, sub = route(word, length, i)
            for other, n in at.get((right, length, last, sub), ()):
                if one_edit(word, other) and not any(route(word, length, j) == route(other, length, j) for j in range(i)):
                    yield other, n


def near_words(words: DataFrame, shards: int) -> DataFrame:
    """word, n_near and the near word of largest n (ties: smallest), with its n, of each word that has a near one."""

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ways: dict[int, int] = {}
                for way in range(12):
                    length, i = len(word) - 1 + way // 4, way % 4
                    shard = shard_of(length, route(word, length, i), shards)
                    ways[shard] = ways.get(shard, 0) | 1 << way
                    if length == len(word):
                        rows.append((shard, word, n, i))
                rows += [(shard, word, 0, -bits) for shard, bits in ways.items()]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int32()))], names=["shard", "word", "n", "route"])

    def search(table):
        import pyarrow as pa

        shard, scanned = Shard(), []
        for word, n, i in zip(*(table.column(c).to_pylist() for c in ("word", "n", "route"))):
            if i < 0:
                scanned.append((word, -i))
            else:
                shard.add(word, n, i)
        out = []
        if shard.held:
            shard.build()
            for word, ways in scanned:
                found = [(-n, other) for other, n in shard.near(word, ways)]
                if found:
                    best = min(found)
                    out.append((word, len(found), best[0], best[1]))
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "k", "minus", "near"])

    dealt = words.select("word", "n").mapInArrow(tidy(deal), "shard int, word string, n long, route int")
    found = dealt.groupBy("shard").applyInArrow(search, "word string, k long, minus long, near string")
    # the smallest struct: largest n first, then code-point order
    best = found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct("minus", "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root of every word of ``links`` (word, form), which has no cycle, by pointer doubling."""
    found = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = sized(found.select(F.col("word").alias("root"), F.col("root").alias("further")))
        step = checkpointed(found.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        found = step.select("word", "root")
        if step.where("moved").isEmpty():
            return found


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least five letters with at least three occurrences.

    ``form`` is the near word of largest n if that is at least twice the word's own (else null), ``root`` where following
    forms ends; counts at least double on the way.  No words, no rows.  Repeated rows count as often as they are there; other
    columns are ignored.
    """
    words = checkpointed(word_counts(docs).where(F.col("n") >= LEAST_COUNT))
    shards = max(1, -(-words.count() // SHARD_WORDS))
    near = near_words(words, shards)
    has_form = F.col("near_n") >= 2 * F.col("n")
    formed = checkpointed(
        words.join(near, "word", "left").select("word", F.when(has_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("near_n")).alias("form_n"))
    )
    ends = sized(roots(formed.where("form IS NOT NULL")))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
