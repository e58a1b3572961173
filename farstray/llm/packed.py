"""Counting and grouping 64-bit fingerprints in packed rows.

One Spark row carries the fingerprints that a task has for one range of the hash space, as bytes.  Shuffles then move
little more than the fingerprints themselves, and sorting is left to numpy.  Ranges are even, as fingerprints are
hashes.  A fingerprint that very many owners have would make its range hot: such ones are found in a sample, what is to
be said of each is broadcast, and their pairs go to their owners without being gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farstray.llm.common import mix, release, tidy

#: Items that a task holds before it sends them on.
FLUSH = 600_000
#: Fingerprints with ``HEAVY`` items in a sample of texts of about so many bytes are not gathered.  The sample decides where
#: work is done, not what comes out; at most a fingerprint for each ``HEAVY`` items of the sample is broadcast.
SAMPLE_BYTES, HEAVY = 256 << 20, 32
#: Bounds of a sketch: log2 of its cells.  The largest is a bitmap of 32 MB when it is broadcast.
LEAST_CELLS, MOST_CELLS = 16, 28
#: Cells for each fingerprint where cells are counted range by range and no sketch is broadcast.
SPARSE = 16
#: Stands for the sets of a chunk where several have a fingerprint.
SEVERAL = np.uint32(2**32 - 1)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def squeeze(data: bytes) -> bytes:
    import zstandard as zstd

    return zstd.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    import zstandard as zstd

    return zstd.ZstdDecompressor().decompress(data)


def pack_pairs(owner: np.ndarray, *values: np.ndarray) -> bytes:
    """(owner long, values uint64) rows by columns; equal neighbouring owners are written once."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.r_[first, len(owner)]).astype(np.uint32)
    head = np.array([len(first), len(owner), len(values)], dtype=np.int64)
    return squeeze(b"".join([head.tobytes(), owner[first].astype(np.int64).tobytes(), lengths.tobytes(), *(v.tobytes() for v in values)]))


def unpack_pairs(data: bytes) -> tuple[np.ndarray, ...]:
    data = unsqueeze(data)
    runs, n, k = np.frombuffer(data, dtype=np.int64, count=3).tolist()
    owners = np.frombuffer(data, dtype=np.int64, count=runs, offset=24)
    lengths = np.frombuffer(data, dtype=np.uint32, count=runs, offset=24 + 8 * runs)
    at = 24 + 12 * runs
    return (np.repeat(owners, lengths), *(np.frombuffer(data, dtype=np.uint64, count=n, offset=at + 8 * n * i) for i in range(k)))


def ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` even ranges of the hash space each fingerprint is in."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def by_range(rows: DataFrame, work: Callable[[int, list[bytes]], Iterator], schema: str) -> DataFrame:
    """Bring the rows (range int, data binary) of each range together and let ``work`` make record batches of them."""

    def run(batches):
        held, now = [], None
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and key != now:
                    yield from work(now, held)
                    held = []
                    release()
                now = key
                held.append(data.as_py())
        if held:
            yield from work(now, held)
        release()

    return rows.repartition(partitions(rows), "range").sortWithinPartitions("range").mapInArrow(tidy(run), schema)


# --- count-min sketch -------------------------------------------------------------------------------------------------


def log2_cells(items: int) -> int:
    """Two cells for each item, within the bounds."""
    return int(min(MOST_CELLS, max(LEAST_CELLS, np.ceil(np.log2(max(2 * items, 1))))))


def count_min(source: DataFrame, items: Callable[[object], Iterable[np.ndarray]], bits: int, least: int = 2) -> np.ndarray:
    return count_mins(source, items, bits, [least])[0]


def count_mins(source: DataFrame, items: Callable[[object], Iterable[np.ndarray]], bits: int, leasts: list[int]) -> list[np.ndarray]:
    """For each ``least`` (255 at most) a bitmap of the cells whose count over all partitions reaches ``least``.

    ``items(batch)`` yields arrays of fingerprints.  Each task counts by cell (a sketch of one row, kept sparse) and
    sends ranges of cells with their counts; counts are added up range by range.  A fingerprint whose cell isn't marked
    has occurred less than ``least`` times; a marked one may have, as others share its cell.
    """
    blocks = 1 << (8 if bits > 22 else 5)
    width = (1 << bits) // blocks

    def count(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []

        def flush():
            cells, n = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            cuts = np.searchsorted(cells, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(width))
            keys, data = [], []
            for b in range(blocks):
                own = cells[cuts[b] : cuts[b + 1]]
                if len(own):
                    steps = np.diff(own, prepend=np.uint64(b * width)).astype(np.uint32)
                    planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes()  # by significance: the high bytes are zeros
                    keys.append(b)
                    data.append(squeeze(planes + n[cuts[b] : cuts[b + 1]].tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["range", "data"])

        waiting = 0
        for batch in batches:
            for part in items(batch):
                if len(part):
                    held.append(part)
                    waiting += len(part)
                    if waiting >= FLUSH:
                        yield flush()
                        waiting = 0
        if held:
            yield flush()

    def add(block, parts):
        import pyarrow as pa

        total = np.zeros(width, dtype=np.uint8)
        for part in parts:
            raw = np.frombuffer(unsqueeze(part), dtype=np.uint8)
            n = len(raw) // 5
            steps = raw[: 4 * n].reshape(4, n).T.copy().view(np.uint32).reshape(-1)
            at = np.cumsum(steps, dtype=np.int64)
            total[at] += np.minimum(raw[4 * n :], 255 - total[at])
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([b"".join(np.packbits(total >= least).tobytes() for least in leasts)], pa.binary())], names=["range", "bitmap"])

    rows = source.mapInArrow(tidy(count), "range int, data binary")
    out = np.zeros((len(leasts), max(1, (1 << bits) // 8)), dtype=np.uint8)
    each = width // 8
    for r in by_range(rows, add, "range int, bitmap binary").toLocalIterator():  # bounded: all of them are the bitmaps
        out[:, r["range"] * each : (r["range"] + 1) * each] = np.frombuffer(r["bitmap"], dtype=np.uint8).reshape(len(leasts), each)
    return list(out)


def marked(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    cell = hashes >> np.uint64(64 - bits)
    return (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & np.uint8(1) > 0


# --- sets with few fingerprints of their own --------------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that those that are always zero take no room when they are squeezed."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def of_planes(data: bytes, kind, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, dtype=np.uint8, count=width * n, offset=at).reshape(width, n).T.copy().view(kind).reshape(-1)


def crowded(source: DataFrame, sets: Callable[[object], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]], total: int) -> DataFrame:
    """The owner of each set of which fewer than ``least`` fingerprints are in no other set.

    ``sets(batch)`` yields (owners, least, offsets, fingerprints), a set having none twice; they number about ``total``.
    Nothing is broadcast or sent to the driver, whatever the size.  A task sends, for each range of the hash space, the cells
    of a chunk of sets as steps from one to the next, with the places of the sets in the chunk; back come the places
    of those that have a cell to themselves.  Different fingerprints may share a cell and then count as shared, so that too
    many owners may be found but none is left out.
    """
    n = 2 * partitions(source)
    shift = np.uint64(64 - int(min(48, max(LEAST_CELLS, np.ceil(np.log2(max(SPARSE * total, 1)))))))

    def to(chunk: int) -> int:
        return int(ranges(mix(np.array([chunk], dtype=np.int64).view(np.uint64)), n)[0])

    def row(chunk: int, kind: int, size: int, *parts: bytes) -> bytes:
        return squeeze(b"".join([np.array([chunk, kind, size], dtype=np.int64).tobytes(), *parts]))

    def record(keys: list[int], data: list[bytes]):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["range", "data"])

    def opened(data: bytes) -> tuple[int, int, int, bytes]:
        raw = unsqueeze(data)
        return (*np.frombuffer(raw, dtype=np.int64, count=3).tolist(), raw)

    def send(batches):
        held, waiting = [], 0

        def flush():
            owners, least = (np.concatenate([x[i] for x in held]).astype(np.int64) for i in (0, 1))
            sizes = np.concatenate([np.diff(x[2]) for x in held])
            cells = np.concatenate([x[3] for x in held]) >> shift
            held.clear()
            chunk = int(np.bitwise_xor.reduce(mix(owners.view(np.uint64) + np.arange(len(owners), dtype=np.uint64))).view(np.int64))
            place = np.repeat(np.arange(len(owners), dtype=np.uint32), sizes)
            order = np.argsort(cells, kind="stable")
            cells, place = cells[order], place[order]
            first = np.ones(len(cells), dtype=bool)
            first[1:] = cells[1:] != cells[:-1]
            last = np.r_[first[1:], True] if len(cells) else first
            cells, place = cells[first], np.where(last, place, SEVERAL)[first]
            cuts = np.searchsorted(ranges(cells << shift, n), np.arange(n + 1))
            keys = [k for k in range(n) if cuts[k] < cuts[k + 1]]
            data = [row(chunk, 1, cuts[k + 1] - cuts[k], planes(np.diff(cells[cuts[k] : cuts[k + 1]], prepend=np.uint64(0))), planes(place[cuts[k] : cuts[k + 1]])) for k in keys]
            return record([*keys, to(chunk)], [*data, row(chunk, 0, len(owners), owners.tobytes(), least.tobytes())])

        for batch in batches:
            for part in sets(batch):
                held.append(part)
                waiting += len(part[0]) + len(part[3])
                if waiting >= FLUSH:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    def answer(_, parts):
        keys, data, chunks, cells, places = [], [], [], [], []
        for part in parts:
            chunk, kind, size, raw = opened(part)
            if kind == 0:  # the owners of a chunk go on to where its answers meet
                keys.append(to(chunk))
                data.append(part)
                continue
            chunks.append(chunk)
            cells.append(np.cumsum(of_planes(raw, np.uint64, size, 24), dtype=np.uint64))
            places.append(of_planes(raw, np.uint32, size, 24 + 8 * size))
        if chunks:
            of_all = np.concatenate(cells)
            order = np.argsort(of_all)
            new = np.r_[True, of_all[order][1:] != of_all[order][:-1], True]
            alone = np.zeros(len(of_all), dtype=bool)
            alone[order] = new[1:] & new[:-1]
            for chunk, place, own in zip(chunks, places, np.split(alone, np.cumsum([len(x) for x in cells])[:-1])):
                found = np.sort(place[own & (place != SEVERAL)])
                if len(found):
                    keys.append(to(chunk))
                    data.append(row(chunk, 2, len(found), planes(np.diff(found, prepend=np.uint32(0)))))
        yield record(keys, data)

    def add(_, parts):
        import pyarrow as pa

        owners, found = {}, {}
        for part in parts:
            chunk, kind, size, raw = opened(part)
            if kind == 0:
                owners[chunk] = np.frombuffer(raw, dtype=np.int64, offset=24).reshape(2, size)
            else:
                found.setdefault(chunk, []).append(np.cumsum(of_planes(raw, np.uint32, size, 24), dtype=np.int64))
        for chunk, (owner, least) in owners.items():
            alone = np.bincount(np.concatenate(found[chunk]), minlength=len(owner)) if chunk in found else np.zeros(len(owner), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(owner[alone < least])], names=["owner"])

    sent = by_range(source.mapInArrow(tidy(send), "range int, data binary"), answer, "range int, data binary")
    return by_range(sent, add, "owner long")


# --- exact grouping ---------------------------------------------------------------------------------------------------


def heavy_items(source: DataFrame, items: Callable[[object], Iterable[np.ndarray]], total_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints that ``HEAVY`` items or more of a sample have, in order, and their counts there."""
    share = min(1.0, SAMPLE_BYTES / max(total_bytes, 1))
    n = 2 * partitions(source)

    def count(batches):
        import pyarrow as pa

        held, waiting = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cuts = np.searchsorted(ranges(keys, n), np.arange(n + 1))  # keys are sorted, and so are their ranges
            at = [k for k in range(n) if cuts[k] < cuts[k + 1]]
            data = [pack_pairs(counts[cuts[k] : cuts[k + 1]].astype(np.int64), keys[cuts[k] : cuts[k + 1]]) for k in at]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["range", "data"])

        for batch in batches:
            for part in items(batch):
                if len(part):
                    held.append(part)
                    waiting += len(part)
                    if waiting >= FLUSH:
                        yield flush()
                        waiting = 0
        if held:
            yield flush()

    def add(_, parts):
        import pyarrow as pa

        counts, keys = map(np.concatenate, zip(*map(unpack_pairs, parts)))
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, weights=counts).astype(np.int64)
        often = counts >= HEAVY
        yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], names=["key", "n"])

    sample = source.sample(share, 7) if share < 1 else source
    found = by_range(sample.mapInArrow(tidy(count), "range int, data binary"), add, "key long, n long").toArrow()
    keys, counts = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order].astype(np.uint64)


def is_in(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``values`` are among the sorted ``keys``, and the place of each there."""
    if not len(keys):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values, at


def pairs_by_range(source: DataFrame, pairs: Callable[[object], Iterable[tuple[np.ndarray, np.ndarray]]], heavy, per_partition: int = 2) -> DataFrame:
    """Rows (range, data) of the (owner, fingerprint) pairs that ``pairs(batch)`` yields, for ``by_range``.

    ``heavy`` is a broadcast (sorted fingerprints, a number for each).  Pairs of these are dealt by owner and carry the number:
    ``unpack_pairs`` gives three columns of them and two of others.
    """
    n = per_partition * partitions(source)

    def send(batches):
        import pyarrow as pa

        owners: list[np.ndarray] = []
        values: list[np.ndarray] = []
        known, numbers = heavy.value

        def flush():
            owner, value = np.concatenate(owners), np.concatenate(values)
            owners.clear()
            values.clear()
            often, place = is_in(known, value)
            keys, data = [], []
            for to, columns in ((ranges(value[~often], n), (owner[~often], value[~often])), (ranges(mix(owner[often].astype(np.int64).view(np.uint64)), n), (owner[often], value[often], numbers[place[often]]))):
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(n + 1))
                for k in range(n):
                    if cuts[k] < cuts[k + 1]:
                        keys.append(k)
                        data.append(pack_pairs(*(c[order[cuts[k] : cuts[k + 1]]] for c in columns)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["range", "data"])

        waiting = 0
        for batch in batches:
            for owner, value in pairs(batch):
                if len(owner):
                    owners.append(owner)
                    values.append(value)
                    waiting += len(owner)
                    if waiting >= FLUSH:
                        yield flush()
                        waiting = 0
        if owners:
            yield flush()

    return source.mapInArrow(tidy(send), "range int, data binary")


def grouped(parts: list[bytes]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The pairs of a range sorted by fingerprint, then owner, with where each fingerprint's group starts; and the heavy pairs
    (owner, fingerprint, number) as they came."""
    found = [unpack_pairs(p) for p in parts]
    light, heavy = ([f for f in found if len(f) == k] for k in (2, 3))
    owner, value = map(np.concatenate, zip(*light)) if light else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    order = np.lexsort((owner, value))
    owner, value = owner[order], value[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, dtype=np.int64)
    passed = tuple(map(np.concatenate, zip(*heavy))) if heavy else (np.zeros(0, dtype=np.int64), *(np.zeros(0, dtype=np.uint64),) * 2)
    return (owner, value, first), passed


def answered(rows: DataFrame, work: Callable[[int, list[bytes]], Iterator[tuple[np.ndarray, ...]]], owner: str, names: list[str]) -> DataFrame:
    """One row for each owner with, under each name, all values that ``work`` finds for it in any range, as bytes.

    ``work(range, parts)`` yields (owners, values, ...) arrays.  They travel packed: a row for each range and destination,
    not one for each range and owner, as a long text has fingerprints in all ranges.
    """
    n = 2 * partitions(rows)

    def reply(now, parts):
        import pyarrow as pa

        for owners, *values in work(now, parts):
            to = ranges(mix(owners.astype(np.int64).view(np.uint64)), n)
            order = np.lexsort((owners, to))
            owners, values = owners[order], [v[order] for v in values]
            cuts = np.searchsorted(to[order], np.arange(n + 1))
            keys = [k for k in range(n) if cuts[k] < cuts[k + 1]]
            data = [pack_pairs(owners[cuts[k] : cuts[k + 1]], *(v[cuts[k] : cuts[k + 1]] for v in values)) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["range", "data"])

    def gather(_, parts):
        import pyarrow as pa

        owners, *values = map(np.concatenate, zip(*map(unpack_pairs, parts)))
        order = np.argsort(owners, kind="stable")
        owners, values = owners[order], [v[order] for v in values]
        first = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        cuts = (np.r_[first, len(owners)] * 8).astype(np.int64)
        blobs = [pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(v.tobytes())]) for v in values]
        for at in range(0, len(first), 2000):  # batches of bounded rows
            yield pa.RecordBatch.from_arrays([pa.array(owners[first[at : at + 2000]]), *(x[at : at + 2000].cast(pa.binary()) for x in blobs)], names=[owner, *names])

    sent = by_range(rows, reply, "range int, data binary")
    return by_range(sent, gather, ", ".join([f"{owner} long", *(f"{x} binary" for x in names)]))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
