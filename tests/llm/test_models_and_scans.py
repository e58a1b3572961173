"""Toxicity, exact top-k, page text and secret scans: held-out accuracy and brute force."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from farstray.llm import html_text, secrets, topk, toxicity

DOCS = "doc_id long, text string, score double, toxic int, half string"
SF = "/root/testdata/sf0.01"


# --- toxicity ---------------------------------------------------------------------------------------------------------


def made_texts(n: int):
    rng = random.Random(1)
    plain = [f"{a}{b}{c}" for a in "lmnrst" for b in "aeiou" for c in ("den", "ling", "ro", "tan")]
    bad = ["zorkig", "zorkigs", "grubvex", "grubvexed", "plimskrat"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([8, 30, 200]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2 + len(words) // 15):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = made_texts(600)
    docs = spark.createDataFrame([(i, t, 0.5, 1 - y, "h") for i, t, y in rows] + [(900, None, None, None, None), (901, "", 0.0, 1, "x"), (901, "", 0.0, 1, "x"), (None, "grubvex", 0.0, 0, "")], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(None, 1, 1), (5, 1, None), (6, 0, 7)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out if r["doc_id"] is not None)
    truth = {i: y for i, _, y in rows}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["doc_id"] in truth and r["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert len({r["score"] for r in out if r["doc_id"] in (900, 901)}) == 1


def by_hand(texts, labels, corpus):
    """Each text's three measures by the definition: dictionaries of word tuples, one probability at a time."""
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts = [[{}, {}], [{}, {}]]  # by length less one, class
    for text, toxic in {(t, y) for t, y in labels if t is not None}:
        w = split(text)
        for k in (0, 1):
            for g in {tuple(w[i : i + k + 1]) for i in range(len(w) - k)}:
                counts[k][toxic][g] = counts[k][toxic].get(g, 0) + 1

    def less(k, c, n):
        of = [0, *(sum(v == m for v in counts[k][c].values()) for m in (1, 2, 3, 4))]
        m = min(n, 3)
        cut = m - (m + 1) * of[1] / max(of[1] + 2 * of[2], 1) * of[m + 1] / of[m] if of[m] else m / 2
        return n - min(max(cut, 0.05 * m), 0.95 * m) if n else 0.0

    vocabulary = {g[0] for c in (0, 1) for g in counts[0][c]}
    pairs = {(a, b) for t in corpus for w in [split(t)] for a, b in zip([None, *w], w) if b in vocabulary}

    def chance(c, context, word):
        k = len(context)
        below = chance(c, (), word) if k else sum(b == word for _, b in pairs) / len(pairs)
        own = [sum(less(k, d, n) for g, n in counts[k][d].items() if g[:-1] == context) for d in (0, 1)]
        total = sum(n for d in (0, 1) for g, n in counts[k][d].items() if g[:-1] == context)
        if not own[c]:
            return below
        kept = sum(own) / total
        return kept * less(k, c, counts[k][c].get((*context, word), 0)) / own[c] + (1 - kept) * below

    out = []
    for text in texts:
        w = split(text)
        ratio = lambda context, word: math.log(chance(1, context, word) / chance(0, context, word)) if word in vocabulary else 0.0
        alone = [ratio((), x) for x in w]
        after = [ratio(tuple(w[max(i - 1, 0) : i]), x) for i, x in enumerate(w)]
        seen = [sum(counts[0][c].get((x,), 0) for c in (0, 1)) for x in w]
        power = [math.exp(3 * r * n / (n + 1)) for r, n in zip(alone, seen)]
        m = max(len(w), 1)
        out.append((sum(alone) / m, sum(a - b for a, b in zip(after, alone)) / m, math.log(sum(power) / m) / 3 if w else 0.0))
    return out


def test_toxicity_measures_are_those_of_the_definition(spark):
    rng = random.Random(4)
    plain, bad = ["a", "Été", "of", "den", "ro", "漢", "lig"], ["zork", "of", "den"]
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 and rng.random() < 0.4 else plain) for _ in range(rng.choice([1, 5, 12]))), int(i % 3 == 0)) for i in range(60)]
    rows += [(60, "once alone", 1), (61, "once again", 0), (62, None, 1), (63, "", 0)]
    corpus = [(i, t) for i, t, _ in rows] + [(100, "new words of den"), (101, None), (102, ""), (103, "zork"), (104, "den of zork, zork! 9"), (105, "alone new zork")]
    corpus.append((106, " ".join(rng.choice(plain + bad) for _ in range(20_000))))
    docs = spark.createDataFrame([(i, t, 0.0, 0, "") for i, t in corpus], DOCS).repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    texts = [t for _, t in corpus[:-1]]
    expected = by_hand(texts, [(t, y) for _, t, y in rows], [t for _, t in corpus])
    found = model.models.measures(__import__("pyarrow").array(texts))
    assert np.allclose(found, expected, atol=1e-5)


def test_toxicity_word_of_one_labelled_text_counts_and_long_texts_are_read_whole(spark):
    rows = made_texts(400) + [(1000, "tarvik", 1), (1001, "belmut", 0)]
    docs = spark.createDataFrame([(i, t, 0.0, 0, "") for i, t, _ in rows], DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    plain = "laden leling lero letan maden maling "
    long_text = plain * 50_000  # 300,000 words
    texts = [plain + "unseen", plain + "tarvik", plain + "belmut", plain, long_text, long_text + "grubvex zorkig plimskrat " * 20_000, long_text]
    single = model.models.measures(__import__("pyarrow").array(texts))
    assert single[1, 0] > single[0, 0] > single[2, 0] and single[1, 2] > single[0, 2]
    p = model.probability(single)
    assert p[5] >= 0.7 > p[4] == p[6]
    scored = toxicity.score(spark.createDataFrame([(i, t, 0.0, 0, "") for i, t in enumerate(texts)], DOCS), model).collect()
    assert np.allclose([r["score"] for r in sorted(scored, key=lambda r: r["doc_id"])], p)


def test_toxicity_labelled_id_with_many_texts_stays_within_the_bounds(spark):
    docs = spark.createDataFrame([(1, f"zork {i}x{'a' * (i % 40)}", 0.0, 0, "") for i in range(3000)] + [(2, "den ro", 0.0, 0, "")], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    limits = toxicity.Limits(rows_per_class=50)
    sample = toxicity.labelled_sample(docs, labels, limits)
    assert {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()} == {0: 1, 1: 50}
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(docs, labels, limits).collect())


def test_toxicity_never_uses_held_out_labels(spark):
    rows = made_texts(200)
    docs = spark.createDataFrame([(i, t, 0.0, 0, "") for i, t, _ in rows], DOCS)
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    scores = [
        {r["doc_id"]: round(r["score"], 9) for r in toxicity.toxicity(docs, spark.createDataFrame([(i, y) for i, y in labels], "doc_id long, toxic int")).collect()}
        for labels in ([(i, y) for i, _, y in rows], [(i, flip(i, y)) for i, _, y in rows])
    ]
    assert scores[0] == scores[1]


def test_toxicity_without_documents_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), none).collect() == []
    [row] = toxicity.toxicity(spark.createDataFrame([(1, "a", 0.0, 0, "")], DOCS), none).collect()
    assert row["score"] < 0.01 and row["predicted"] == 0


# --- top-k ------------------------------------------------------------------------------------------------------------


def test_top_k_is_exact_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(150, 190)] + [(3, rows[3][1]), (None, [1.0] * 6), (200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [1.0]), (205, [])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    good = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, e in {i: e for i, e in good if i % 50 == 0}.items():
        scored = sorted((-int(e @ c), i) for i, c in good if i != q and len(c) == len(e))[:10]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    found = topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, bins=8, block=2)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_top_k_with_few_candidates_or_none(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    found = topk.top_k(vectors.where("vec_id = 0"), vectors).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 2, 1024 * 2048), (0, 2, 1, 1024 * 512 + 2048 * 512)]
    assert topk.top_k(vectors.limit(0), vectors).collect() == []


# --- page text --------------------------------------------------------------------------------------------------------


def test_text_of_pages_the_model_has_not_seen(spark):
    made = [(i, *html_text.labelled_page(10_000 + i)) for i in range(150)]
    pages = spark.createDataFrame([(i, "u", page, "x") for i, page, _ in made] + [(900, None, None, "x"), (901, "u", "", "x"), (901, "u", "", "x")], "page_id long, url string, html string, text string")
    found = html_text.extract(pages).collect()
    assert len(found) == 153 and all(r["n_chars"] == len(r["text"]) for r in found)
    by_id = {r["page_id"]: r["text"] for r in found}
    assert by_id[900] == by_id[901] == ""
    assert sum(by_id[i] == text for i, _, text in made) >= 0.95 * len(made)
    assert html_text.extract(pages.limit(0)).collect() == []


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no tables")
def test_text_of_the_tables_pages_is_their_article(spark):
    """In the table the article element holds the main text: words found of those there, and the other way round."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: r["text"].split() for r in html_text.extract(pages).collect()}
    common = there = said = 0
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)
        words = html.unescape(re.sub("<[^>]*>", " ", article.group(1))).split()
        common += sum((Counter(words) & Counter(found[r["page_id"]])).values())
        there, said = there + len(words), said + len(found[r["page_id"]])
    assert common >= 0.98 * there and common >= 0.98 * said


def test_very_long_and_broken_pages(spark):
    long = "<body><nav><ul><li><a href='/x'>home</a></li></ul></nav><article>" + "<p>Some words of a sentence that goes on, and another one.</p>" * 20_000 + "</article><footer>end</footer></body>"
    broken = ['<p class="x>never closed quote <p>next</p>', "<div id='a\"b'><article><p>text</article", "<" * 5000, "<p " + "a=b " * 3000, "&#xZZ; &#99999999; &unknown; &amp", "</p></p></article><p>left over"]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate([long, *broken])], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert len(found) == 7 and len(found[0].split()) >= 0.98 * 11 * 20_000 and "home" not in found[0] and not found[0].endswith("end")


def test_leaf_blocks_of_odd_markup():
    texts = lambda page: [b.text for b in html_text.leaf_blocks(page)]
    assert texts("<p>a &amp; b&nbsp;c<br>d<p>e <b>f</b>g</p>") == ["a & b c d", "e fg"]
    assert texts("<script>var x = '<p>no</p>'</script>yes<!-- <p>no --><style>p{}</style>") == ["yes"]
    assert texts("<div>open <a href='>'>link") == ["open link"] and texts("a < b") == ["a < b"]
    assert texts("<script>never closed <p>x") == []


def test_formulas_and_fallback_texts_are_read():
    blocks = html_text.leaf_blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<video src='v'><p>a film</p></video><svg/><object><style>p{}</style>a chart</object><p>end")
    assert [b.text for b in blocks] == ["so x=2 holds", "a film", "a chart", "end"]
    assert "<video" in blocks[1].path and "<object" in blocks[2].path and "<svg" not in blocks[3].path


# --- secrets ----------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(text):
    spans = [("assign", m) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [("access", m) for m in ACCESS.finditer(text) if len(m.group()) >= 20] + [("hex", m) for m in HEX.finditer(text) if len(m.group()) >= 24]
    rank = ["assign", "access", "hex"]
    return [(k, m.start(), m.end()) for k, m in sorted(spans, key=lambda s: (s[1].start(), rank.index(s[0])))]


def secret_texts():
    rng = random.Random(4)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(a) for _ in range(n))
    texts: list[str | None] = [None, "", "nothing here", "\U0001f600 é Password: 'hunter2x' and", "token=abc token = abcdef secret:\x20\x20xyz=", "apikey\":\"" + key(30), "API_KEY='12345", "AKIA" + key(15, "AB12") + " AKIA" + key(16, "AB12") + "x", key(23, "0123456789abcdef") + "g" + key(24, "0123456789abcdef"), "secret=" + key(40, "0123456789abcdef"), "password=\npassword==x.y-z_+/"]
    for i in range(60):
        words = [rng.choice(["lorem", "ipsum", "dolor-sit-amet", "2024-01-02", "漢字", "a/b/c/d"]) for _ in range(rng.choice([5, 400]))]
        for _ in range(i % 4):
            words.insert(rng.randrange(len(words)), rng.choice(["token: " + key(20), "AKIA" + key(16, "ABCDEF234567"), key(32, "0123456789abcdef"), key(40), "aaaaaaaaaaaaaaaaaaaa1111111111111111111111", "abcdefghijklmnopqrstuvwxyz0123456789"]))
        texts.append(" ".join(words))
    return texts


def test_secret_spans(spark):
    texts = secret_texts()
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_hex int").repartition(3)
    found = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert len(found) == len(texts)
    written = lambda spans: ",".join(":".join(map(str, s)) for s in spans)
    random_keys = missed = 0
    for i, t in enumerate(texts):
        base, r = base_spans(t or ""), found[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert [s for s in spans if s[0] != "random"] == base
        for kind, a, b in spans:
            if kind == "random":
                assert re.fullmatch(r"[A-Za-z0-9+/_=-]{20,}", t[a:b]) and "aaaaaaaa" not in t[a:b] and "abcdefgh" not in t[a:b]
        for m in re.finditer(r"(?<![^ ])[A-Za-z0-9]{40}(?![^ ])", t or ""):
            if not any(a < m.end() and m.start() < b for _, a, b in base):
                random_keys += 1
                missed += ("random", m.start(), m.end()) not in spans
    assert random_keys >= 10 and missed <= 0.2 * random_keys


def test_values_of_env_files_and_keys_without_digits(spark):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    padded, letters = "q83vEjRWeJCrze8SNFZ4kKvN7xI=", "kXpzQRbwvLLsTghmYCNdj"
    texts = [f"AWS_SECRET_ACCESS_KEY={key}", f"SIGNING={padded} end", f"it is {letters} there", "someVeryLongIdentifierName InternationalizationOfTheWorld home/User/Documents/Letters"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    at = [t.index(k) for t, k in zip(texts, (key, padded, letters))]
    assert found == {i: f"random:{a}:{a + len(k)}" for i, (a, k) in enumerate(zip(at, (key, padded, letters)))} | {3: ""}
    assert secrets.redact(docs).where("doc_id = 0").first()["text"] == "AWS_SECRET_ACCESS_KEY=[secret]"


def by_definition(token, alphabet):
    """The battery's p-value with the distributions themselves: an incomplete gamma series and the error function."""
    body = token.rstrip("=")
    x = [alphabet.index(c) + 1 for c in body]
    n, size = len(x), len(alphabet)
    chi = sum(x.count(v) ** 2 for v in set(x)) * size / n - n
    a, z = (size - 1) / 2, chi / 2
    term = total = 1 / a
    for k in range(1, 2000):
        term *= z / (a + k)
        total += term
    p_chi = 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a))
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    high = [v > size / 2 for v in x]
    ones, zeros = sum(high), n - sum(high)
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    spread = math.sqrt(2 * ones * zeros * (2 * ones * zeros - n) / (n * n * (n - 1))) if ones and zeros else 0
    p_runs = 2 * tail(abs(runs - 1 - 2 * ones * zeros / n) / spread) if spread else 1.0
    mean = sum(x) / n
    power = sum((v - mean) ** 2 for v in x)
    p_serial = 2 * tail(abs(sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / power) * math.sqrt(n))
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-"
    share = [sum(kind(c) == k for c in alphabet) / size for k in "aA0-"]
    q, two = sum(s * (1 - s) for s in share), sum(s * (1 - s) ** 2 for s in share)
    changes = sum(kind(p) != kind(r) for p, r in zip(body, body[1:]))
    p_kinds = tail(((n - 1) * q - changes) / math.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (two - q * q)))
    return min(1.0, 4 * min(p_chi, p_runs, p_serial, 10 * p_kinds))


def test_p_values_of_the_battery(spark):
    rng = random.Random(17)
    rows = []
    for name, alphabet in secrets.ALPHABETS.items():
        for n in (20, 33, 64, 200):
            token = "".join(rng.choice(alphabet) for _ in range(n))
            token = token if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) else "a1A1"[:2] + token[2:]
            if next(a for a in secrets.ALPHABETS.values() if all(c in a for c in token)) == alphabet:
                rows.append((token, alphabet))
    rows += [("parse_stream_2_value_9", secrets.ALPHABETS["base64url"]), ("abababababab1b1b1b1b1b1b", secrets.ALPHABETS["hex"]), ("BuildFactoryConfig7Of3Z", secrets.ALPHABETS["base64"])]
    found = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", secrets.randomness(F.col("t")).alias("p")).collect()
    assert len(rows) > 20
    for r, (token, alphabet) in zip(found, rows):
        expected = by_definition(token, alphabet)
        assert abs(r["p"] - expected) < 0.02 + 0.1 * expected, token


def test_random_keys_are_found_and_identifiers_left_alone(spark):
    rng = random.Random(5)
    verbs, nouns = "get set make read write load find parse build check open close send fetch".split(), "user name table index value buffer stream record window session handler request".split()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [letters + letters.lower() + "0123456789+/", letters + letters.lower() + "0123456789-_", letters.lower() + "0123456789", letters + "0123456789", letters + "234567", "0123456789ABCDEF"]
    keys = ["".join(rng.choice(kinds[i % 6]) for _ in range(rng.choice([20, 24, 32, 40, 64, 88]))) for i in range(300)]

    def name(i):
        words = [rng.choice(verbs), *(rng.choice(nouns) for _ in range(rng.randrange(3, 6)))]
        return [f"{'_'.join(words)}_v{i % 9}", f"{'-'.join(words)}-{i}", "/".join(["usr", "lib", *words]), "".join(w.title() for w in words) + f"Impl{i % 9}"][i % 4]

    names = [name(i) for i in range(900)]
    docs = spark.createDataFrame(list(enumerate([f"see {t} here" for t in keys + names])), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert sum(f":4:{4 + len(k)}" in spans[i] for i, k in enumerate(keys)) >= 0.9 * len(keys)
    assert sum(spans[len(keys) + i] != "" for i in range(len(names))) <= 0.05 * len(names)


def test_secrets_of_a_very_long_text(spark):
    text = "word " * 200_000 + f"token: abc123 AKIA{'Z9' * 10} " + "k9Qz" * 3 + " x" * 300_000
    [row] = secrets.scan(spark.createDataFrame([(None, text)], "doc_id long, text string")).collect()
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (1, 1, 0) and row["spans"].startswith("assign:1000000:1000013")


def test_secrets_of_nothing_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = secrets.scan(docs)
    assert out.collect() == []
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token=abcdef123 end", 1), (2, None, 2), (3, "plain", 3)], "doc_id long, text string, at int")
    found = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert found == {1: "é [secret] end", 2: None, 3: "plain"}
    assert secrets.redact(docs).columns == docs.columns


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no tables")
def test_toxicity_of_the_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL")
    r = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("accuracy"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall")).first()
    assert r["accuracy"] >= 0.9 and r["recall"] >= 0.7
