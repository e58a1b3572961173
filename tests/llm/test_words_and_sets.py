"""Jaccard join, repeated windows and decontamination against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from farstray.llm import decontaminate, jaccard, packed, repeats
from farstray.llm.common import mix

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, row long, node long, word string, n string"


def wide(spark, rows, schema=DOCS):
    """A table with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], schema).repartition(3)


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "漢字", "a b", "x y", "Ab-c"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "one two"), (5, "ONE two"), (6, "a b c d e"), (None, "a b c d e")]
    for i in range(10, 60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 13, 14, 40, 200]))]
        kind = rng.random()
        if kind < 0.3 and len(rows) > 9:
            words = (rng.choice(rows[8:])[1] or "").split()
            for _ in range(rng.randrange(3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.5:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(20) :]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(70, "long " * 5000 + "tail"), (71, "long " * 5000 + "tail"), (72, rows[20][1]), (72, rows[20][1])]
    return rows


def sets_of(text):
    words = SPACE_WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(rows):
    sets = [sets_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed):
    rows = corpus(seed)
    found = [tuple(r) for r in jaccard.similar_components(wide(spark, rows)).collect()]
    assert sorted(found, key=key) == sorted(components(rows), key=key)


def test_jaccard_threshold_is_inclusive_and_roots_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(5)
    rows = [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j z")]  # 6 of 8 shingles: exactly 0.75
    for group in range(9):  # all share a beginning, most of them are not similar
        base = [f"g{group}x{k}" for k in range(40)]
        for member in range(12):
            words = list(base)
            words[rng.randrange(40)] = f"m{group}y{member}"
            rows.append((100 * (group + 1) + member, " ".join(["same", "five", "words", "in", "front", *words])))
    found = [tuple(r) for r in jaccard.similar_components(wide(spark, rows)).collect()]
    assert sorted(found) == sorted(components(rows))
    assert dict((r[0], r[2]) for r in found)[2] == 1


@pytest.mark.parametrize("block", [3, 128])
def test_jaccard_makes_all_links(spark, monkeypatch, block):
    """Groups of different near copies, in which a spanning forest has only some of the links, and copies."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(7)
    rows = corpus(9)
    for group in range(3):
        base = [f"g{group}x{k}" for k in range(60)]
        for member in range(14):
            words = list(base)
            words[rng.randrange(60)] = f"m{member}"
            rows.append((1000 * (group + 1) + member, " ".join(words)))
    rows += [(5000, rows[-1][1]), (5001, rows[-1][1])]
    sets = [frozenset(sets_of(t)) for _, t in rows]
    similar = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    expected = [(*c[:2], sum(1 for j, b in enumerate(sets) if i != j and similar(sets[i], b)), c[2]) for i, c in enumerate(components(rows))]
    found = [tuple(r) for r in jaccard.linked_documents(wide(spark, rows)).collect()]
    assert sorted(found, key=key) == sorted(expected, key=key)
    links, members = (df.collect() for df in jaccard.similar_links(wide(spark, rows)))
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in members), key=key) == sorted(((i, len(s)) for (i, _), s in zip(rows, sets)), key=key)
    of = {r["node"]: r["doc_id"] for r in members if r["node"] is not None and r["doc_id"] is not None}
    text = {i: frozenset(sets_of(t)) for i, t in rows}
    pairs = [frozenset((text[of[r["a"]]], text[of[r["b"]]])) for r in links]
    distinct = list(set(s for s in sets if s))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for i, a in enumerate(distinct) for b in distinct[:i] if similar(a, b)}


def test_jaccard_sends_only_shingles_of_what_may_link(spark, monkeypatch):
    """However full a bounded sketch of all shingles would be, as it is beyond 1 GB of text."""
    monkeypatch.setattr(packed, "LEAST_CELLS", 9)
    monkeypatch.setattr(packed, "MOST_CELLS", 9)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(80))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(3)]
    pairs, sent = packed.pairs_by_range, []

    def seen(*given):
        found = pairs(*given)
        sent.append(sum(len(packed.unpack_pairs(r["data"])[0]) for r in found.collect()))
        return found

    monkeypatch.setattr(packed, "pairs_by_range", seen)
    found = [tuple(r) for r in jaccard.similar_components(wide(spark, rows)).collect()]
    assert sorted(found) == sorted(components(rows))
    assert 6 * 76 <= sent[0] < 12 * 76


def test_crowded_sets_are_those_with_few_elements_of_their_own(spark):
    rng = random.Random(12)
    sets = {i: sorted(rng.sample(range(60), rng.randrange(5)) + rng.sample(range(1000 * i, 1000 * i + 1000), rng.randrange(1, 9))) for i in range(1, 80)}
    count = Counter(x for s in sets.values() for x in s)
    rows = spark.createDataFrame([(i, s) for i, s in sets.items()], "id long, s array<long>").repartition(5)

    def items(batch):
        values = [np.array(s, dtype=np.uint64) for s in batch.column("s").to_pylist()]
        yield batch.column("id").to_numpy(), np.full(len(values), 4), np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int64), mix(np.concatenate([*values, np.zeros(0, dtype=np.uint64)]))

    found = [r["owner"] for r in packed.crowded(rows, items, 1 << 36).collect()]
    assert sorted(found) == [i for i, s in sets.items() if sum(count[x] == 1 for x in s) < 4]


def test_jaccard_links_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.linked_documents(empty).collect() == [] and all(df.collect() == [] for df in jaccard.similar_links(empty))


def test_jaccard_empty_table(spark):
    assert jaccard.similar_components(spark.createDataFrame([], DOCS)).collect() == []


def kept_words(rows, size=13):
    least = {}
    words = [SPACE_WORD.findall((t or "").encode()) for _, t in rows]
    for (doc_id, _), w in zip(rows, words):
        doc_id = 2**63 - 1 if doc_id is None else doc_id
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(doc_id, least.get(k, doc_id))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < (2**63 - 1 if doc_id is None else doc_id):
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_repeats(spark, seed):
    rows = corpus(seed)
    found = [tuple(r) for r in repeats.remove_repeats(wide(spark, rows)).collect()]
    assert sorted(found, key=key) == sorted(kept_words(rows), key=key)


@pytest.mark.parametrize("sample", [256 << 20, 20_000])
def test_frequent_windows_and_shingles_are_not_gathered(spark, monkeypatch, sample):
    monkeypatch.setattr(repeats.packed, "HEAVY", 2)
    monkeypatch.setattr(repeats.packed, "SAMPLE_BYTES", sample)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = corpus(9) + [(i, f"u{i} v{i} {passage} x{i} y{i % 3}") for i in range(300, 340)] + [(None, passage)]
    found = [tuple(r) for r in repeats.remove_repeats(wide(spark, rows)).collect()]
    assert sorted(found, key=key) == sorted(kept_words(rows), key=key)
    found = [tuple(r) for r in jaccard.similar_components(wide(spark, rows)).collect()]
    assert sorted(found, key=key) == sorted(components(rows), key=key)
    pairs = repeats.packed.pairs_by_range
    gathered = []

    def seen(source, items, heavy, *rest):
        gathered.append(len(heavy.value[0]))
        return pairs(source, items, heavy, *rest)

    monkeypatch.setattr(repeats.packed, "pairs_by_range", seen)
    repeats.remove_repeats(wide(spark, rows)).collect()
    assert gathered[0] > 0


def test_repeats_with_a_full_sketch_lose_nothing(spark, monkeypatch):
    """Where nearly every cell is shared the exact pass does all of the work."""
    monkeypatch.setattr(repeats.packed, "LEAST_CELLS", 9)
    monkeypatch.setattr(repeats.packed, "MOST_CELLS", 9)
    rows = corpus(6)
    found = [tuple(r) for r in repeats.remove_repeats(wide(spark, rows)).collect()]
    assert sorted(found, key=key) == sorted(kept_words(rows), key=key)


def test_repeats_keep_text_and_empty_table(spark):
    window = " ".join(f"k{i}" for i in range(13))
    rows = repeats.remove_repeats(wide(spark, [(1, window), (2, f"before {window}\nafter")]), keep_text=True).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == {1: window, 2: "before after"}
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def contamination(rows, items, size=10):
    words = lambda t: BENCH_WORD.findall((t or "").encode().translate(LOWER))
    windows = {}
    for item_id, text in items:
        w = words(text)
        if item_id is not None and w:
            for i in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[i : i + size]), set()).add(item_id)
    out = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        joined = ",".join(sorted(map(str, ids)))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("seed", [7, 8])
def test_decontamination(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed)
    items = [(1, None), (2, ""), (3, "--- !"), (4, "One TWO"), (None, "w1 w2"), (5, "Été"), (6, "long long long"), (7, rows[30][1]), (7, rows[30][1])]
    for i in range(10, 40):
        source = [w for _, t in rows[8:60] for w in (t or "").split()]
        at = rng.randrange(len(source) - 30)
        items.append((i, "; ".join(source[at : at + rng.choice([1, 2, 9, 10, 11, 25])]).upper()))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, word string")
    found = [tuple(r) for r in decontaminate.decontaminate(wide(spark, rows), bench).collect()]
    assert sorted(found, key=key) == sorted(contamination(rows, items), key=key)


def test_decontamination_without_documents_or_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(spark.createDataFrame([], DOCS), none).collect() == []
    [row] = decontaminate.decontaminate(wide(spark, [(1, "a b")]), none).collect()
    assert tuple(row) == (1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_decontamination_plan_is_native(spark):
    plan = decontaminate.decontaminate(wide(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
