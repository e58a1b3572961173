"""Suffix-array dedup, byte-level BPE and WARC archives against definitions, a library and exact round trips."""

import hashlib
import io
import random
import struct
from array import array

import numpy as np
import pytest
from pyspark import cloudpickle

from farstray.llm import bpe, common, packed, suffixes, warc

DOCS = "doc_id long, text string, key long, row string, spans string"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, 7, "r", "s") for i, t in rows], DOCS).repartition(3)


def random_texts(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    alphabet = "abcdefgh é漢\U0001f600\n"
    passage = "".join(rng.choice(alphabet) for _ in range(500))
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "x" * 199), (3, "y" * 200), (4, "z" * 201), (5, "ab" * 400)]
    for i in range(10, 50):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([50, 190, 250, 900])))
        if rng.random() < 0.5:
            at, a = rng.randrange(len(text)), rng.randrange(250)
            text = text[:at] + passage[a : a + rng.choice([60, 120, 180, 200, 240])] + text[at:]
        rows.append((i, text))
    return [*rows, (60, rows[20][1]), (60, rows[20][1]), (61, "z" * 3000), (62, "q" + "z" * 150)]


def without_repeats(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for (doc_id, _), r in zip(rows, raw):
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc_id, len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [300, 5000, 1 << 20])
def test_shards_are_merged(shard_bytes):
    rng = random.Random(8)
    common = bytes(rng.choice(b"ab") for _ in range(60))
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) + common[rng.randrange(30) :] for _ in range(80)]
    weight = np.array([rng.choice([1, 1, 2]) for _ in pieces])
    seen: dict[bytes, int] = {}
    for p, w in zip(pieces, weight):
        for i in range(len(p) - 19):
            seen[p[i : i + 20]] = seen.get(p[i : i + 20], 0) + int(w)
    found = suffixes.repeated_starts(pieces, weight.astype(float), 20, shard_bytes)
    assert [m.tolist() for m in found] == [[seen[p[i : i + 20]] >= 2 for i in range(len(p) - 19)] for p in pieces]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = random_texts(seed)
    found = [tuple(r) for r in suffixes.remove_substrings(wide(spark, rows)).collect()]
    assert sorted(found) == sorted(without_repeats(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_deals_frequent_seeds(spark, monkeypatch, seed):
    """A run of bytes with other surroundings in every text: its pieces go to many shards, and the result is the same."""
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    rng = random.Random(seed)
    common = "".join(rng.choice("abcdefgh") for _ in range(230))
    rows = random_texts(seed)
    for i in range(100, 180):
        a = rng.randrange(40)
        before, behind = ("".join(rng.choice("abcdefgh") for _ in range(150)) for _ in range(2))
        rows.append((i, before + common[a : a + rng.choice([64, 150, 199, 200, 201])] + behind))
    shards = []
    repeated = suffixes._repeated

    def counted(hot, n, length):
        shards.append(hot.select("range").distinct().count())
        return repeated(hot, n, length)

    monkeypatch.setattr(suffixes, "_repeated", counted)
    found = [tuple(r) for r in suffixes.remove_substrings(wide(spark, rows)).collect()]
    assert sorted(found) == sorted(without_repeats(rows)) and shards[0] > 4


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup_of_very_long_texts_and_null_ids(spark, monkeypatch, seed):
    """Texts longer than what is looked at at a time, rows without an id, and one passage in every text."""
    monkeypatch.setattr(suffixes, "LONG", 500)
    rng = random.Random(seed)
    line = "".join(rng.choice("abcdefgh") for _ in range(220))
    letters = "".join(rng.choice("abcdefghijkl é") for _ in range(40_000))
    rows = [(None, letters[:9000]), (None, "short"), (None, None), (1, letters[8000:20_000] + "#" + letters[15_000:16_000]), (2, "z" * 4000)]
    rows += [(i, f"{i} " + "".join(rng.choice("mnopqr") for _ in range(300)) + line + str(i)) for i in range(3, 40)]
    found = [tuple(r) for r in suffixes.remove_substrings(wide(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(without_repeats(rows), key=str)


@pytest.mark.parametrize("seed", [5, 6])
def test_suffix_dedup_with_seeds_that_are_not_gathered(spark, monkeypatch, seed):
    monkeypatch.setattr(packed, "HEAVY", 3)
    rows = random_texts(seed)
    line = "".join(random.Random(seed).choice("abcdefgh") for _ in range(210))
    rows += [(i, f"{i} head {line[: 190 + i % 21]} tail {i}") for i in range(200, 240)]
    found = [tuple(r) for r in suffixes.remove_substrings(wide(spark, rows)).collect()]
    assert sorted(found) == sorted(without_repeats(rows))


def test_seeds_are_dealt_evenly():
    """Seeds are the least of many hashes; dealt as they are, nearly all would be in the first range."""
    data = np.random.default_rng(5).integers(97, 123, 2_000_000, dtype=np.uint8)
    seed, first, last, _ = suffixes.anchors(np.array([0, len(data)]), data, 200)
    assert last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
    counts = np.bincount(packed.ranges(seed, 32), minlength=32)
    assert counts.max() < 2 * counts.mean()


def test_suffix_dedup_of_nothing(spark):
    assert suffixes.remove_substrings(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("text", [b"banana", b"aaaaaaaaaaaaaaaaaaaaaa", b"abababab" * 40, bytes(range(256)) * 3, b"z"])
def test_suffix_array_and_common_prefixes(text):
    data = np.frombuffer(text, dtype=np.uint8)
    order, slot = suffixes.suffix_array(data)
    expected = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == expected and slot[order].tolist() == list(range(len(text)))
    shared = suffixes.common_prefixes(data, order, slot, 50, lane=7)
    for k in range(1, len(text)):
        a, b = text[expected[k - 1] :], text[expected[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == min(n, 50)


# --- BPE --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_agrees_with_the_library(spark, tokenizer):
    path, pattern, library = tokenizer
    rng = random.Random(3)
    texts: list[str | None] = [None, "", " ", "a", "don't  stop\n\n", "<|endoftext|>", "x" * 3000, "ab" * 2000, "漢字かな交じり文" * 20, "é" * 50, "\U0001f600‍" * 9, "\x00\x01", "The quick brown fox. " * 300]
    pools = ["abcdefghijklmnop ", "éßøаbв漢한ع ", "0123456789.,-", "".join(map(chr, range(32, 0x250))), " \t\n\r"]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.choice([5, 50, 400]))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(2)
    found = {r["doc_id"]: r for r in bpe.encode_documents(docs, path, pattern, keep_ids=True).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert list(found[i]["ids"]) == ids, text
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(b"".join(struct.pack("<I", x) for x in ids)).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_transducer_with_small_tables_is_the_same():
    rng = random.Random(9)
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
    tokens = list(ranks)
    while len(ranks) < 40:  # random merges
        t = rng.choice(tokens) + rng.choice(tokens)
        if t not in ranks and len(t) < 9:
            ranks[t] = len(ranks)
            tokens.append(t)
    ranks = {t: r for t, r in ranks.items() if len(t) == 1 or len(bpe.merge_all(t, {k: v for k, v in ranks.items() if v < r})) == 2}
    machine = bpe.Transducer(ranks, most_states=5)
    for _ in range(300):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        expected = [ranks[piece]] if piece in ranks else [ranks[t] for t in bpe.merge_all(piece, ranks)]
        assert np.frombuffer(machine.encode(piece), dtype="<u4").tolist() == expected


def test_pieces_that_come_once_leave_one_transition_each():
    rng = random.Random(10)
    ranks = {bytes([b]): i for i, b in enumerate(b"abcd")}
    for token in (b"ab", b"cd", b"abc", b"bcd", b"abcd", b"da"):
        ranks[token] = len(ranks)
    ranks = {t: r for t, r in ranks.items() if len(t) == 1 or len(bpe.merge_all(t, {k: v for k, v in ranks.items() if v < r})) == 2}
    machine = bpe.Transducer(ranks, most_states=50)
    for n in range(1, 400):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.choice([7, 20, 3000 if n % 40 == 0 else 9])))
        assert np.frombuffer(machine.encode(piece), dtype="<u4").tolist() == [ranks[t] for t in bpe.merge_all(piece, ranks)]
        assert len(machine.next) <= n and len(machine.states) <= 50


def test_tables_of_an_operator_leave_a_worker_before_another_begins():
    common.worker_tables("a", lambda: [1])
    list(common.tidy(lambda batches: iter(batches), "a")([1]))
    assert common.worker_tables("a", lambda: [2]) == [1]
    held = []
    list(common.tidy(lambda batches: held.append(len(common._held)) or iter(batches))([1]))
    assert held == [0]


def test_tables_leave_a_worker_when_the_task_has_travelled():
    """As Spark sends it: a copy of the task's function must still drop the tables of this process."""
    common.worker_tables("a", lambda: [1])
    task = cloudpickle.loads(cloudpickle.dumps(common.tidy(lambda batches: iter([len(common._held)]), "b")))
    assert list(task([])) == [0] and not common._held


def test_merges_of_the_vocabulary_by_their_definition():
    """The halves of each token are what lower merges make of it; a token that they can't make is an error."""
    rng = random.Random(11)
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
    while len(ranks) < 60:
        token = b"".join(rng.choice(list(ranks)) for _ in range(2))
        lower = bpe.merge_all(token, ranks)
        if token not in ranks and len(lower) == 2:
            ranks[token] = len(ranks)
    machine = bpe.Transducer(ranks)
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = bpe.merge_all(token, {t: r for t, r in ranks.items() if r < rank})
            assert machine.halves[rank] == tuple(ranks[t] for t in parts)
    with pytest.raises(ValueError, match="no merge"):
        bpe.Transducer({b"a": 0, b"b": 1, b"c": 2, b"abc": 3})


def test_steps_look_only_at_entries_that_end_there():
    """Of a run of one letter a step tries no more entries than end there, however many begin there."""
    ranks = {b"a": 0, b"b": 1}
    for n in (2, 4, 8, 16, 32):
        ranks[b"a" * n] = len(ranks)
    machine = bpe.Transducer(ranks, most_states=2)
    piece = b"a" * 3000 + b"b"
    assert np.frombuffer(machine.encode(piece), dtype="<u4").tolist() == [ranks[t] for t in bpe.merge_all(piece, ranks)]
    assert max(map(len, machine.ends)) == 6 and len(machine.next_node) <= machine.most_nodes


def test_utf8_stream_at_every_cut():
    text = "aé漢\U0001f600z"
    raw = text.encode()
    for i in range(len(raw) + 1):
        for j in range(i, len(raw) + 1):
            stream = bpe.Utf8Stream()
            assert stream.feed(raw[:i]) + stream.feed(raw[i:j]) + stream.feed(raw[j:]) + stream.close() == text


def test_utf8_stream_keeps_bytes_that_are_no_text():
    rng = random.Random(12)
    odd = [b"\xff", b"\xc3", b"\xe2\x82", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\xaf", b"\xf0\x9f\x98", b"a", "é漢\U0001f600".encode(), b"ab c"]
    for _ in range(400):
        raw = b"".join(rng.choice(odd) for _ in range(rng.randrange(8)))
        cuts = sorted(rng.randrange(len(raw) + 1) for _ in range(3))
        pieces = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        as_bytes, as_text = bpe.Utf8Stream(), bpe.Utf8Stream()
        assert b"".join([*map(as_bytes.feed_bytes, pieces), as_bytes.close_bytes()]) == raw
        assert "".join([*map(as_text.feed, pieces), as_text.close()]) == raw.decode("utf-8", "replace")
        valid = "�" not in raw.decode("utf-8", "replace")
        assert not valid or as_bytes.wrong == 0 and as_bytes.rest == b""


def test_bpe_of_a_very_long_text_without_caches(tokenizer):
    """The path for texts beyond a million characters, and every pre-token through the transducer."""
    path, pattern, library = tokenizer
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß漢 ") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    text = " ".join(rng.choice(words) for _ in range(230_000))
    assert len(text) > 1_000_000
    ids = array("I", bpe.Codec(bpe.read_ranks(path), pattern).encode(text)).tolist()
    assert ids == library.encode_ordinary(text)
    plain = bpe.Codec(bpe.read_ranks(path), pattern, most_cached=1)
    short = text[:20_000]
    assert array("I", plain.encode(short)).tolist() == library.encode_ordinary(short) and len(plain.cache) <= 1


# --- WARC -------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, sha1 string, last long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", 1) for i, u, h in rows], PAGES).repartition(3)


def expected_records(rows, least=0):
    last: dict[bytes, int] = {}
    for i, _, h in rows:
        if i is not None:
            p = (h or "").encode()
            last[p] = max(i, last.get(p, i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = i is not None and len(p) >= least and i < last[p]
        out.append((i, len(p), warc.base32_sha1(p), "revisit" if revisit else "response", last[p] if revisit else None))
    return out


def order(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    rows = [(1, "http://a/x y", None), (2, None, ""), (3, "http://b/é", "<p>same</p>"), (4, "u", "<p>same</p>"), (5, "u", "abc"), (6, "u", "abc"), (7, "v", "long " * 200_000), (8, "v", "漢字\r\n\r\nWARC/1.1\r\n"), (None, "w", "abc"), (9, "w", "twin"), (9, "w", "twin")]
    found = [tuple(r) for r in warc.round_trip(pages(spark, rows), f"file://{tmp_path}/a", least).collect()]
    assert sorted(found, key=order) == sorted(expected_records(rows, least), key=order)


def test_warc_of_nothing(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], PAGES), f"file://{tmp_path}/none").collect() == []


def test_warc_payloads_survive_and_the_dictionary_leads(spark, tmp_path):
    zstd = pytest.importorskip("zstandard")
    rows = [(i, f"http://site/{i}", f"<html><body><p>Page {i} of a site with much in common {i * 7919}</p></body></html>" * 3) for i in range(600)]
    folder = f"file://{tmp_path}/b"
    manifest = warc.write(warc.mark_revisits(pages(spark, rows).coalesce(1)), folder)
    back = {r["page_id"]: r["html"] for r in warc.read(manifest, folder, keep_payload=True).collect()}
    assert back == {i: h for i, _, h in rows}
    [name] = [r["archive"] for r in manifest.collect()]
    raw = (tmp_path / "b" / name).read_bytes()
    magic, size = struct.unpack("<II", raw[:8])
    assert 0x184D2A50 <= magic <= 0x184D2A5F
    assert zstd.ZstdCompressionDict(raw[8 : 8 + size]).dict_id() != 0  # a trained dictionary
    assert sum(1 for _ in warc.records_of(io.BytesIO(raw), chunk=1000)) == len(rows)
    alone = sum(len(zstd.ZstdCompressor(level=3).compress(warc.record(i, u, h.encode(), None, "2020-01-01T00:00:00Z"))) for i, u, h in rows)
    assert len(raw) - 8 - size < 0.7 * alone
