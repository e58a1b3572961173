"""Suffix-array dedup of long byte strings.

Every string of ``length`` bytes holds an anchor: the 64-byte seed of least hash in it, the leftmost on a tie.  It depends
on the string alone, so equal strings anywhere have equal seeds.  Seeds alone are grouped first, and anchors whose seed
occurs once are dropped.  The others send the piece of text around them that holds all strings of that anchor to the shard
of the seed; equal pieces are sent once with their places.  A shard sorts the suffixes of the pieces whose seed has several different
pieces (Larsson-Sadakane: groups that are not yet told apart are sorted by the ranks a doubling distance ahead), finds the
common prefixes of neighbours (Kasai, in lanes), and reads off which strings occur twice.  The pieces of a seed that many
texts hold are dealt over all shards by a hash of the piece: each shard sends the fingerprints of its different strings
with their weights, a second shuffle adds them up by fingerprint, and the repeated ones go back to the shards that have
them.  The number of shards follows the size of the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farstray.llm import packed
from farstray.llm.common import BYTE_CODE, _power_tables, checkpointed, mix, sized, sized_bytes, slices, small_batches, tidy

SEED = 64
FLUSH_BYTES = 12 << 20
#: About so many bytes of pieces go into one suffix array.
SHARD_BYTES = 1 << 20
#: A seed with so many anchors is dealt over several shards.
HOT = 200
#: So many string starts of a very long text are looked at at a time.
LONG = 1 << 20
#: Bytes of text for each shard, and the least number of shards.
TEXT_BYTES, LEAST_SHARDS = 2 << 20, 8


def anchors(offsets: np.ndarray, data: np.ndarray, length: int):
    """(seed fingerprint, first start, last start, row) of every anchor's run of string starts."""
    n, reach = len(data), length - SEED + 1
    nothing = np.zeros(0, dtype=np.int64)
    if n < length:
        return nothing.astype(np.uint64), nothing, nothing, nothing
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * power[:n], out=sums[1:])
    seed = mix((sums[SEED:] - sums[:-SEED]) * inverse[: n - SEED + 1])
    key = (seed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seed), dtype=np.uint64)
    # least key of every run of ``reach`` seeds: from the left and from the right within blocks
    blocks = -(-len(key) // reach) + 1
    padded = np.full(blocks * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    left = np.minimum.accumulate(padded.reshape(blocks, reach), axis=1).reshape(-1)
    right = np.minimum.accumulate(padded.reshape(blocks, reach)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(right[: n - length + 1], left[reach - 1 : reach - 1 + n - length + 1])
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row_of[: n - length + 1] == row_of[length - 1 :]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return nothing.astype(np.uint64), nothing, nothing, nothing
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    # least hashes crowd at the low end: mixed again, they are even
    return mix(seed[at[first]]), starts[first], starts[last], row_of[starts[first]]


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of a text (zero-padded) as one big-endian number."""
    padded = np.r_[text, np.zeros(8, dtype=np.uint8)].astype(np.uint64)
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def bit_length(x: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return np.bitwise_count(x).astype(np.int64)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes, and each place's slot among them (Larsson-Sadakane)."""
    n = len(text)
    first = words_at(text)
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    start = np.flatnonzero(new)
    group = np.repeat(start, np.diff(np.r_[start, n]))
    rank[order] = group
    h = 8
    while True:
        # slots of groups with more than one suffix; sorted groups are never touched again
        single = new & np.r_[new[1:], True]
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        suffix = order[slots]
        ahead = rank[np.minimum(suffix + h, n)] + 1
        key = (rank[suffix].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        order[slots], key = suffix[by], key[by]
        split = np.r_[True, key[1:] != key[:-1]]
        new[slots] = split
        begin = slots[split]
        rank[order[slots]] = np.repeat(begin, np.diff(np.r_[np.flatnonzero(split), len(slots)]))
        h *= 2
    slot = np.empty(n, dtype=np.int64)
    slot[order] = np.arange(n)
    return order, slot


def common_prefixes(text: np.ndarray, order: np.ndarray, slot: np.ndarray, most: int, lane: int = 512) -> np.ndarray:
    """Kasai: the common prefix (up to ``most``) of each sorted suffix with the one before it.

    From one place to the next a common prefix shrinks by one byte at most.  Lanes of ``lane`` places are walked side by side.
    """
    n = len(text)
    out = np.zeros(n, dtype=np.int64)
    words = np.r_[words_at(text), np.zeros(most + 8, dtype=np.uint64)]
    before = np.where(slot > 0, order[np.maximum(slot - 1, 0)], -1)
    lanes = np.arange(0, n, lane)
    h = np.zeros(len(lanes), dtype=np.int64)
    for step in range(min(lane, n)):
        i = lanes + step
        i = i[i < n]
        h = np.maximum(h[: len(i)] - 1, 0)
        j = before[i]
        live = np.flatnonzero(j >= 0)
        h[j < 0] = 0
        while len(live):
            a, b = i[live] + h[live], j[live] + h[live]
            differ = words[np.minimum(a, n + most)] ^ words[np.minimum(b, n + most)]
            room = np.minimum(n - np.maximum(i[live], j[live]) - h[live], most - h[live])
            same = np.where(differ == 0, 8, 0)
            odd = differ > 0
            if odd.any():
                same[odd] = (64 - bit_length(differ[odd])) // 8
            gain = np.minimum(same, room)
            h[live] += gain
            live = live[(gain == 8) & (room > 8)]
        out[slot[i]] = h
    return out


def _prints(text: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """The fingerprints of the strings of ``length`` bytes at all starts of the pieces that lie one after the other in ``text``."""
    start = spread(np.cumsum(sizes) - sizes, sizes - length + 1)
    power, inverse = _power_tables(len(text) + 1)
    sums = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_CODE[text] * power[: len(text)])]
    return mix((sums[start + length] - sums[start]) * inverse[start])


def _strings(text: np.ndarray, sizes: np.ndarray, weight: np.ndarray, length: int):
    """Sorted fingerprints and weights of a shard's different strings of ``length`` bytes, and each start's place among them."""
    order, slot = suffix_array(text)
    shared = common_prefixes(text, order, slot, length)
    of_class = np.cumsum(shared < length)  # neighbours that share less begin a new class
    count = sizes - length + 1
    piece = np.repeat(np.arange(len(sizes)), count)
    start = spread(np.cumsum(sizes) - sizes, count)
    _, first, classes = np.unique(of_class[slot[start]], return_index=True, return_inverse=True)
    total = np.bincount(classes, weights=weight[piece])
    power, inverse = _power_tables(len(text) + 1)
    sums = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_CODE[text] * power[: len(text)])]
    prints = mix((sums[start[first] + length] - sums[start[first]]) * inverse[start[first]])
    by = np.argsort(prints)
    place = np.empty(len(by), dtype=np.int32)
    place[by] = np.arange(len(by))
    return prints[by], total[by], place[classes]


def repeated_starts(pieces: list[bytes], weight: np.ndarray, length: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each piece, which of its starts begin a string of ``length`` bytes that occurs twice (by weight) in all pieces.

    Pieces are cut into shards of about ``shard_bytes`` with a suffix array each; every shard looks its strings up in the
    sorted strings of all of them by binary search.
    """
    sizes = np.array([len(p) for p in pieces])
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // shard_bytes)) + 1
    bounds = [0, *cuts.tolist(), len(pieces)]
    shards = [_strings(np.frombuffer(b"".join(pieces[a:b]), dtype=np.uint8), sizes[a:b], weight[a:b], length) for a, b in zip(bounds, bounds[1:])]
    prints, at = np.unique(np.concatenate([s[0] for s in shards]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([s[1] for s in shards]))
    twice = np.concatenate([(total[np.searchsorted(prints, own)] >= 2)[starts] for own, _, starts in shards])
    return np.split(twice, np.cumsum(sizes - length + 1)[:-1])


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all (start, size) pieces of ``data``, one piece after the other."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for ``count[i]`` places, one i after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Pieces:
    """Different (seed, piece) items in the order of their seeds, and the places (owner, start) that each is found at.

    ``prints`` tells the pieces of one seed apart.  ``of`` is the item of each place; places are sorted by item.
    """

    def __init__(self, seed, prints, size, start, data, of, owner, begin):
        """Items may repeat, and so may their places; ``start`` and ``size`` are an item's bytes in ``data``."""
        order = np.lexsort((size, prints, seed))
        s, p, n = seed[order], prints[order], size[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1]) | (n[1:] != n[:-1])
        item = np.empty(len(order), dtype=np.int64)
        item[order] = np.cumsum(new) - 1
        kept = order[new]
        self.seed, self.prints, self.size, self.start, self.data = seed[kept], prints[kept], size[kept], start[kept], data
        of = item[of]
        order = np.lexsort((begin, owner, of))
        of, owner, begin = of[order], owner[order], begin[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1])
        self.of, self.owner, self.begin = of[new], owner[new], begin[new]
        self.weight = np.bincount(self.of, minlength=len(self.seed))
        self.first = np.cumsum(self.weight) - self.weight

    def __len__(self) -> int:
        return len(self.seed)

    def packed(self, items: np.ndarray) -> bytes:
        """The given items and their places as bytes."""
        at = spread(self.first[items], self.weight[items])
        head = np.array([len(items), len(at)], dtype=np.int64)
        parts = [head, self.seed[items], self.prints[items], self.size[items].astype(np.uint32), self.weight[items].astype(np.uint32), self.owner[at], self.begin[at].astype(np.uint32)]
        return packed.squeeze(b"".join([*(x.tobytes() for x in parts), gather(self.data, self.start[items], self.size[items]).tobytes()]))

    @staticmethod
    def unpacked(parts: list[bytes]) -> Pieces:
        columns, at, texts, items = [], 0, [], 0
        for part in parts:
            raw = packed.unsqueeze(part)
            n, m = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
            offset, found = 16, []
            for dtype, k in ((np.uint64, n), (np.uint64, n), (np.uint32, n), (np.uint32, n), (np.int64, m), (np.uint32, m)):
                found.append(np.frombuffer(raw, dtype=dtype, count=k, offset=offset))
                offset += found[-1].nbytes
            seed, prints, size, count, owner, begin = found
            size = size.astype(np.int64)
            columns.append((seed, prints, size, at + np.cumsum(size) - size, np.repeat(np.arange(items, items + n), count), owner, begin.astype(np.int64)))
            texts.append(np.frombuffer(raw, dtype=np.uint8, offset=offset))
            at += len(texts[-1])
            items += n
        if not parts:
            none = np.zeros(0, dtype=np.int64)
            return Pieces(none.view(np.uint64), none.view(np.uint64), none, none, np.zeros(0, dtype=np.uint8), none, none, none)
        seed, prints, size, start, of, owner, begin = (np.concatenate(c) for c in zip(*columns))
        return Pieces(seed, prints, size, start, np.concatenate(texts), of, owner, begin)

    def text(self, items: np.ndarray) -> np.ndarray:
        return gather(self.data, self.start[items], self.size[items])

    def runs_of(self, items: np.ndarray, size: np.ndarray, length: int, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owners, begin << 32 | end) of the removed bytes at all places of the items; ``hit`` says it for each string start."""
        count = size - length + 1
        piece = np.repeat(np.arange(len(items)), count)
        opens = hit.copy()
        opens[1:] &= ~hit[:-1] | (piece[1:] != piece[:-1])
        closes = hit.copy()
        closes[:-1] &= ~hit[1:] | (piece[1:] != piece[:-1])
        place = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        first, last, of = place[opens], place[closes], piece[opens]
        n_runs = np.bincount(of, minlength=len(items))
        at = spread(self.first[items], self.weight[items])
        by_place = np.repeat(np.arange(len(items)), self.weight[items])
        run = spread((np.cumsum(n_runs) - n_runs)[by_place], n_runs[by_place])
        owner, begin = (np.repeat(x[at], n_runs[by_place]) for x in (self.owner, self.begin))
        return owner, ((begin + first[run]).astype(np.uint64) << np.uint64(32)) | (begin + last[run] + length).astype(np.uint64)


def _groups(size: np.ndarray, whole: np.ndarray | None = None):
    """Bounds of runs of items of about ``SHARD_BYTES``; items with equal ``whole`` neighbours stay together."""
    if not len(size):
        return []
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // SHARD_BYTES)) + 1
    if whole is not None:
        first = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])
        cuts = np.unique(first[np.searchsorted(first, cuts, side="right") - 1])
        cuts = cuts[cuts > 0]
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]))


def _repeated(hot: DataFrame, shards: int, length: int) -> DataFrame:
    """(range, data) with the sorted fingerprints of each shard's strings that occur twice in all shards.

    A shard sends every different string once with its weight, so a fingerprint's group has at most one row for each
    suffix array.
    """

    def send(shard, parts):
        import pyarrow as pa

        pieces = Pieces.unpacked(parts)
        for a, b in _groups(pieces.size):
            items = np.arange(a, b)
            prints, total, _ = _strings(pieces.text(items), pieces.size[items], pieces.weight[items], length)
            to = packed.ranges(prints, shards)
            cuts = np.searchsorted(to, np.arange(shards + 1))  # prints are sorted, and so are their ranges
            keys = [k for k in range(shards) if cuts[k] < cuts[k + 1]]
            data = [packed.pack_pairs(np.full(cuts[k + 1] - cuts[k], shard), prints[cuts[k] : cuts[k + 1]], total[cuts[k] : cuts[k + 1]].astype(np.uint64)) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["range", "data"])

    def add(_, parts):
        import pyarrow as pa

        shard, prints, weight = map(np.concatenate, zip(*map(packed.unpack_pairs, parts)))
        _, at = np.unique(prints, return_inverse=True)
        twice = np.bincount(at, weights=weight)[at] >= 2
        shard, prints = shard[twice], prints[twice]
        keys = np.unique(shard).tolist()
        data = [packed.squeeze(np.unique(prints[shard == k]).tobytes()) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["range", "data"])

    return packed.by_range(packed.by_range(hot, send, "range int, data binary"), add, "range int, data binary")


def remove_substrings(docs: DataFrame, length: int = 200, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` with ``keep_bytes``) of every document.

    A byte goes if a string of ``length`` UTF-8 bytes that covers it also starts anywhere else, in the same document or
    another; all is judged on the input.  Null and empty texts have no bytes.  Rows with the same text are documents of
    their own, whatever their doc_id (null too), and lose all their bytes to each other.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row"), F.xxhash64(text, F.hash(text), F.octet_length(text)).alias("key"), text.alias("text"))
    long = texts.where(F.octet_length("text") >= length)
    copied = long.groupBy("key").agg(F.min("row").alias("stands"), F.count("*").alias("copies")).where("copies > 1")
    copied = checkpointed(copied.select("key", "stands"))
    # one row stands for all with the same text
    source = long.join(sized(copied, 1_000_000), "key", "left").where("stands IS NULL OR stands = row").select("key", "text")

    def pieces(batch):
        """Slices of the texts: their keys, where the slice begins in its text, bytes, and anchors."""
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for at, offsets, data in slices(batch.column("text")):
            for base in range(0, max(1, len(data) - length + 1), LONG) if len(offsets) == 2 else [0]:
                # of a very long text, the strings that start in so many bytes at a time
                part = data[base : base + LONG + length - 1] if len(offsets) == 2 else data
                ends = np.array([0, len(part)]) if len(offsets) == 2 else offsets
                seed, first, last, row = anchors(ends, part, length)
                yield keys[at : at + len(offsets) - 1][row], base - ends[row], part, seed & ~np.uint64(1), first, last

    def seeds(batch):
        for owner, _, _, seed, _, _ in pieces(batch):
            yield owner, seed

    def repeated(_, parts):
        """Seeds with more than one anchor, with the last bit set where there are many."""
        (owner, value, first), (heavy_owner, heavy_value, _) = packed.grouped(parts)
        n = np.diff(np.r_[first, len(owner)])
        n = np.repeat(n, n)
        yield owner[n > 1], value[n > 1] | (n[n > 1] >= HOT).astype(np.uint64)
        yield heavy_owner, heavy_value | np.uint64(1)

    size = packed.text_bytes(long)
    heavy = spark.sparkContext.broadcast(packed.heavy_items(source, lambda batch: (seed for _, seed in seeds(batch)), size))
    wanted = checkpointed(packed.answered(packed.pairs_by_range(source, seeds, heavy), repeated, "key", ["seeds"]))
    source = source.join(sized_bytes(wanted, "seeds"), "key")
    shards = max(LEAST_SHARDS, -(-size // TEXT_BYTES))

    def send(batches):
        import pyarrow as pa

        held = []

        def flush():
            columns = list(zip(*held))
            held.clear()
            texts = columns.pop()
            before = np.cumsum([0, *map(len, texts)])[:-1]
            seed, prints, size, start, owner, begin, hot = map(np.concatenate, columns)
            start = start + np.repeat(before, [len(c) for c in columns[0]])
            here = Pieces(seed | hot.astype(np.uint64), prints, size, start, np.concatenate(texts), np.arange(len(seed)), owner, begin)
            often = (here.seed & np.uint64(1)) > 0
            to = packed.ranges(np.where(often, here.prints, here.seed), shards)
            # an item's range and kind as one number
            kind = 2 * to.astype(np.int64) + often
            order = np.argsort(kind, kind="stable")
            kinds, cuts = np.unique(kind[order], return_index=True)
            data = [here.packed(order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(order)])]
            columns = [pa.array(kinds // 2, pa.int32()), pa.array(kinds % 2 > 0), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["range", "hot", "data"])

        waiting = 0
        for batch in batches:
            known = {k: np.frombuffer(s, dtype=np.uint64) for k, s in zip(batch.column("key").to_pylist(), batch.column("seeds").to_pylist())}
            for owner, base, data, seed, first, last in pieces(batch):
                if not len(seed):
                    continue
                hot = np.zeros(len(seed), dtype=bool)
                hit = np.zeros(len(seed), dtype=bool)
                bounds = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = known[int(owner[a])]
                    hot[a:b] = np.isin(seed[a:b] | np.uint64(1), own)
                    hit[a:b] = hot[a:b] | np.isin(seed[a:b], own)
                hit = np.flatnonzero(hit)
                if len(hit):
                    size = last[hit] + length - first[hit]
                    power, inverse = _power_tables(len(data) + 1)
                    sums = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_CODE[data] * power[: len(data)])]
                    prints = mix((sums[first[hit] + size] - sums[first[hit]]) * inverse[first[hit]] + size.astype(np.uint64))
                    held.append((seed[hit], prints, size, np.cumsum(size) - size, owner[hit], first[hit] + base[hit], hot[hit], gather(data, first[hit], size)))
                    waiting += int(size.sum()) + 48 * len(hit)
                if waiting >= FLUSH_BYTES:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    def judge(_, parts):
        cold = Pieces.unpacked([p[1:] for p in parts if p[:1] == b"0"])
        pieces_of = np.bincount(np.unique(cold.seed, return_inverse=True)[1]) if len(cold) else np.zeros(0, dtype=np.int64)
        alone = np.repeat(pieces_of == 1, pieces_of)
        # a seed's only piece: if it is in several places, all its strings repeat
        items = np.flatnonzero(alone & (cold.weight > 1))
        if len(items):
            size = cold.size[items]
            yield cold.runs_of(items, size, length, np.ones(int((size - length + 1).sum()), dtype=bool))
        contested = np.flatnonzero(~alone)
        for a, b in _groups(cold.size[contested], cold.seed[contested]):
            items = contested[a:b]
            prints, total, at = _strings(cold.text(items), cold.size[items], cold.weight[items], length)
            yield cold.runs_of(items, cold.size[items], length, (total >= 2)[at])
        dealt = Pieces.unpacked([p[1:] for p in parts if p[:1] == b"1"])
        twice = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(np.frombuffer(packed.unsqueeze(p[1:]), dtype=np.uint64) for p in parts if p[:1] == b"2")]))
        for a, b in _groups(dealt.size) if len(twice) else []:
            items = np.arange(a, b)
            prints = _prints(dealt.text(items), dealt.size[items], length)
            hit = twice[np.minimum(np.searchsorted(twice, prints), len(twice) - 1)] == prints
            yield dealt.runs_of(items, dealt.size[items], length, hit)

    sent = checkpointed(source.mapInArrow(tidy(send), "range int, hot boolean, data binary"))
    hot = sent.where("hot").select("range", "data")
    marks = _repeated(hot, shards, length)
    kinds = ((sent.where("not hot"), b"0"), (hot, b"1"), (marks, b"2"))
    cold, dealt, back = (df.select("range", F.concat(F.lit(bytearray(kind)), "data").alias("data")) for df, kind in kinds)
    rows = cold.unionByName(dealt).unionByName(back)
    spans = checkpointed(packed.answered(rows, judge, "key", ["spans"]))
    # copies are removed whole and need no spans
    whole = texts.join(sized(copied.select("key"), 1_000_000), "key", "left_semi").where(F.octet_length("text") >= length)
    other = texts.join(sized(copied.select("key"), 1_000_000), "key", "left_anti").join(sized_bytes(spans, "spans"), "key", "left")
    none = F.lit(None).cast("binary").alias("spans")
    every = whole.select("doc_id", "text", F.lit(True).alias("whole"), none).unionByName(other.select("doc_id", "text", F.lit(False).alias("whole"), "spans"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_bytes]

    def cut(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + keep_bytes]
        for batch in batches:
            out = []
            for text, whole, spans in zip(batch.column("text"), batch.column("whole").to_pylist(), batch.column("spans").to_pylist()):
                raw = text.as_py().encode("utf-8")
                begin, end = ([0], [len(raw)]) if whole else removed_runs(spans or b"")
                kept = b"".join([raw[a:b] for a, b in zip([0, *end], [*begin, len(raw)])])
                out.append((len(raw), len(raw) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return every.mapInArrow(tidy(cut), schema)


def removed_runs(spans: bytes) -> tuple[list[int], list[int]]:
    """Begins and ends of the maximal runs that the spans (begin << 32 | end) cover."""
    pairs = np.sort(np.frombuffer(spans, dtype=np.uint64))
    if not len(pairs):
        return [], []
    begin, end = (pairs >> np.uint64(32)).astype(np.int64), np.maximum.accumulate((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
    new = np.r_[True, begin[1:] > end[:-1]]
    return begin[new].tolist(), end[np.r_[new[1:], True]].tolist()
