"""Personal data, spelling variants and the conversation trie against brute force on small tables."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from farstray.llm import personal, tries, variants

DOCS = "doc_id long, text string, n long, word string, kind string, spans string, shard int"


def docs_of(spark, rows):
    """A table with extra columns whose names clash with inner and given ones."""
    return spark.createDataFrame([(i, t, 7, "x", "y", "z", 1) for i, t in rows], DOCS).repartition(3)


# --- personal data ----------------------------------------------------------------------------------------------------

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for place, c in enumerate(reversed(digits)):
        v = int(c) * (1 + place % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def base_spans(text):
    """The definition itself: matches of the plain expressions, then their checks."""
    out = []
    for kind, pattern in BASE:
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def personal_texts():
    rng = random.Random(3)
    texts = [None, "", "@", "a@b", "a@b.c_d@e.f@g.h", "é@b.c", "x" * 30 + "@y.z.", "1.2.3.4.5.6.7.8", "01.002.255.256", "300.1.1.1.1", "+1 (663) 555-6869", "+1 2", "4465758382889437 4465758382889437", "😀 4465758382889437.", "4465-7583-8288-9437x"]
    for _ in range(3000):
        letters = rng.choice(["a@.", "ab@._ -é", "0123456789 -+().", "12. ", "1.@a +-", "0 -", "+1 2(", "09 \n"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(70)))
        if rng.random() < 0.4:
            digits = "".join(rng.choice("0123456789") for _ in range(rng.choice([14, 15, 17, 18, 19])))
            digits += next(c for c in "0123456789" if luhn(digits + c))
            text += rng.choice([" ", "x", "-", "1 "]) + digits + rng.choice(["", " ", "z", ".5"])
        texts.append(text)
    return texts


def test_base_spans_are_those_of_the_definition(spark):
    rows = list(enumerate(personal_texts())) + [(3, "me@example.org"), (3, "me@example.org"), (None, "10.0.0.1")]
    out = personal.scan(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    expected = Counter()
    for i, text in rows:
        base = base_spans(text)
        counts = tuple(sum(s.startswith(k + ":") for s in base) for k, _ in BASE)
        expected[i, *counts, hashlib.sha256(",".join(base).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out) == expected
    for r in out:
        spans = r["spans"].split(",") if r["spans"] else []
        base = [s for s in spans if s.split(":")[0] in ("email", "ip", "card", "phone")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"] and len(r["scores"].split(",") if r["scores"] else []) == len(spans)


def kinds_in(text):
    return [(personal.KINDS[k].name, text[a:b]) for k, a, b, _ in personal.spans(text)]


def test_checksums_and_words_nearby_decide_about_other_kinds():
    assert kinds_in("pay to GB82 WEST 1234 5698 7654 32 today") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds_in("pay to GB82 WEST 1234 5698 7654 33 today") == []  # mod 97
    assert kinds_in("DE89370400440532013000 TEXT") == [("iban", "DE89370400440532013000")]
    assert kinds_in("visa 3782 822463 10005") == [("pan", "3782 822463 10005")]
    assert kinds_in("order 3782 822463 10005") == [] and kinds_in("visa 3782 822463 10006") == []
    assert kinds_in("4465758382889437 4465758382889437") == [("pan", "4465758382889437")] * 2  # one chain of digits, no base card
    assert kinds_in("call me: (030) 123 4567") == [("tel", "(030) 123 4567")] and kinds_in("it is (030) 123 4567") == []
    assert kinds_in("SSN 078-05-1120") == [("ssn", "078-05-1120")] and kinds_in("078-05-1120") == [] and kinds_in("SSN 000-05-1120") == []
    # an added span overlaps no other
    assert kinds_in("card 4465758382889437") == [("card", "4465758382889437")]


def test_luhn_and_mod97_reject_single_errors():
    rng = random.Random(5)
    for _ in range(300):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        digits += next(c for c in "0123456789" if personal.luhn(digits + c))
        at = rng.randrange(16)
        other = rng.choice([c for c in "0123456789" if c != digits[at]])
        assert personal.luhn(digits) and not personal.luhn(digits[:at] + other + digits[at + 1 :])
    iban = "GB82WEST12345698765432"
    assert personal.mod97(iban) and not any(personal.mod97(iban[:i] + c + iban[i + 1 :]) for i in range(8, 22) for c in "0123456789" if c != iban[i])


@pytest.mark.parametrize("text", ["a" * 500_000, "1" * 500_000, "1 " * 250_000, "1.1.1.x" * 70_000, "@a" * 250_000, "+1" * 250_000, "AB12" * 125_000, "(12) " * 100_000, "1.1.1.1 " * 60_000])
def test_work_grows_with_the_length_of_a_text(text):
    begin = time.perf_counter()
    personal.spans(text)
    assert time.perf_counter() - begin < 10  # a square would take hours


def test_redaction_and_empty_tables(spark):
    df = docs_of(spark, [(1, "mail a@b.co, card 4465758382889437"), (2, None), (3, ""), (None, "nothing")])
    assert sorted(map(str, (r["text"] for r in personal.redact(df).collect()))) == ["", "None", "mail [email], card [card]", "nothing"]
    assert personal.redact(df).columns == df.columns
    assert personal.scan(df.limit(0)).count() == 0


# --- spelling variants ------------------------------------------------------------------------------------------------


def word_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(rows):
    n = word_counts(rows)
    near = {w: [o for o in n if apart_by_one(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def variant_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abéÀ") for _ in range(rng.randrange(4, 9))) for _ in range(90)] + ["Große", "grosse", "GROSSE", "straße", "strasse", "ÉÉÉÉÉ", "éÉÉÉÉ", "ab×÷cd"]
    rows = [(None, "abcde abcde abcdf abcde"), (0, None), (1, ""), (2, "a bb ccc dddd"), (3, "hello hello hellp helloo Hello hell"), (3, "hello hello hellp helloo Hello hell")]
    for i in range(10, 130):
        rows.append((i, "".join(rng.choice(words[: rng.choice([5, 30, 98])]) + rng.choice([" ", "-", "1", "漢"]) for _ in range(rng.randrange(60)))))
    # chains of forms: each is twice as frequent as the one before
    rows += [(500 + i, "chaina " * 3 + "chainab " * 7 + "chainabc " * 15 + "chainabcd " * 31 + "chainabcde " * 70) for i in range(2)]
    return rows + [(900, ("long" * 500 + " ") * 3 + ("long" * 500 + "s ") * 7), (901, "long" * 30_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_those_of_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(variants, "SHARD_WORDS", 20)  # several shards
    rows = variant_rows(seed)
    out = variants.spelling_variants(docs_of(spark, rows))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == expected_variants(rows)
    assert any(f and r != f for _, f, r, *_ in found)  # forms of forms


def test_a_common_beginning_is_dealt_over_shards():
    """Words that share their first half go to as many shards as their other halves differ."""
    words = [f"inter{a}{b}{c}{d}{e}" for a in "abcd" for b in "efgh" for c in "abcd" for d in "efgh" for e in "abcd"]
    held = Counter(variants.shard_of(len(w), variants.route(w, len(w), i), 64) for w in words for i in range(4))
    assert len(held) == 64 and max(held.values()) < 4 * sum(held.values()) / 64


def test_no_words(spark):
    assert variants.spelling_variants(docs_of(spark, [(1, None), (2, "a b c")])).count() == 0
    assert variants.spelling_variants(docs_of(spark, [(1, "x")]).limit(0)).count() == 0


# --- conversations ----------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth long, k1 long, n int, part int"


def turns_of(spark, rows, partitions=4):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], TURNS).repartition(partitions)


def expected_trie(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2] if t[0] else (False, 0))] for c, v in said.items()}
    built = {}
    for c, turns in said.items():
        h = crc32(str(c).encode()) % 4
        built[c] = tuple(said.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        own = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += own
    out = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if built[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversation_rows(seed):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "lost"), (None, None, None, None)]
    for c in list(range(0, 130)) + [1000, 1001, 1019, 2005]:
        n = rng.choice([1, 1, 2, 3, 4, 6, 9])
        first = rng.random() < 0.5
        for t in range(n):
            text = "hi there" if t == 0 and first else rng.choice(["yes", "no  way", "", None, "a\tb c", "漢 字"])
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["user", "user", None, ""]), text))
    deep = [(40 + c, t, "user", "word " * (t % 3)) for c in (100, 101, 102) for t in range(300 - 40 * c % 7)]  # long chains, one within another
    return rows + deep


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_all_prefixes(spark, seed):
    rows = conversation_rows(seed)
    out = tries.prefix_trie(turns_of(spark, rows))
    found = [tuple(r) for r in out.collect()]
    expected = expected_trie(rows)
    assert len(found) == len(set(found)) and set(found) == expected


def test_a_deep_trie_takes_few_rounds(spark, monkeypatch):
    """A conversation of 450 turns, and others that leave it at each 40th: rounds follow the logarithm of the members."""
    rows = [(20 * 7, t, "user", str(t)) for t in range(450)]
    for k in range(1, 12):
        rows += [(20 * (100 + k), t, "user", str(t)) for t in range(40 * k)] + [(20 * (100 + k), 40 * k, "user", f"away {k}")]
    calls = []
    monkeypatch.setattr(tries, "CHUNK", 50)  # the path is summed by chunks
    monkeypatch.setattr(tries, "checkpointed", lambda df, real=tries.checkpointed: calls.append(1) or real(df))
    out = {tuple(r) for r in tries.prefix_trie(turns_of(spark, rows)).collect()}
    assert out == expected_trie(rows) and len(calls) < 20


def test_a_long_conversation_lies_in_several_ranges(spark):
    rows = [(20, t, "user", f"turn {t}") for t in range(400)] + [(c, 0, "user", "hi") for c in range(21, 30)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        turns = tries.light_turns(turns_of(spark, rows))
        assert turns.where("conv_id = 20").select("part").distinct().count() > 1
        assert {tuple(r) for r in tries.prefix_trie(turns_of(spark, rows)).collect()} == expected_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_of_ends_are_digested_in_order(spark, monkeypatch):
    monkeypatch.setattr(tries, "PACK", 7)
    rows = [(c, 0, "user", "same") for c in range(0, 400)] + [(c, 1, "user", "more") for c in range(0, 400, 3)]
    assert {tuple(r) for r in tries.prefix_trie(turns_of(spark, rows)).collect()} == expected_trie(rows)


def test_repeated_turns_and_no_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 0, "user", "hi")]
    assert {tuple(r) for r in tries.prefix_trie(turns_of(spark, rows)).collect()} == expected_trie(rows)
    assert tries.prefix_trie(turns_of(spark, rows).limit(0)).count() == 0
    assert tries.prefix_trie(turns_of(spark, [(None, 1, "user", "hi")])).count() == 0
