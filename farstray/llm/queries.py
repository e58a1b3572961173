"""The registered queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from farstray.llm import bpe, decontaminate, html_text, jaccard, personal, repeats, secrets, suffixes, topk, toxicity, tries, variants, warc
from farstray.llm.common import table


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors)


def op3_jaccard(spark, sf_dir):
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op3_jaccard_links(spark, sf_dir):
    return jaccard.linked_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_secret_counts(spark, sf_dir):
    return op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def op10_suffixes(spark, sf_dir):
    return suffixes.remove_substrings(table(spark, sf_dir, "documents"))


def op11_personal(spark, sf_dir):
    return personal.scan(table(spark, sf_dir, "documents"))


def op11_personal_base(spark, sf_dir):
    return op11_personal(spark, sf_dir).drop("spans", "scores")


def op12_variants(spark, sf_dir):
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_trie(spark, sf_dir):
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_jaccard": op3_jaccard,
    "op4_decontaminate": op4_decontaminate,
    "op5_repeats": op5_repeats,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_html_text": op8_html_text,
    "op9_secrets": op9_secrets,
    "op10_suffixes": op10_suffixes,
    "op3_jaccard_links": op3_jaccard_links,
    "op9_secret_counts": op9_secret_counts,
    "op11_personal": op11_personal,
    "op12_variants": op12_variants,
    "op13_trie": op13_trie,
    "op11_personal_base": op11_personal_base,
}

ORACLES: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10""",
    "op4_decontaminate": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), bw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE item_id IS NOT NULL
        ), bi AS (
            SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0
        ), win AS (
            SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS s FROM bi
        ), sizes AS (SELECT DISTINCT len(s) AS n FROM win
        ), di AS (
            SELECT doc_id, w, n, unnest(generate_series(1, greatest(len(w) - n + 1, 0))) AS i FROM dw, sizes
        ), ds AS (
            SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS s FROM di
        ), hit AS (SELECT doc_id, i, n, item_id FROM ds JOIN win USING (s)
        ), hw AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id
        ), hi AS (
            SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op5_repeats": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), p AS (
            SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13
        ), win AS (
            SELECT doc_id, i, list_slice(w, i, i + 12) AS s FROM p
        ), m AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k FROM win JOIN m USING (s) WHERE doc_id > least
        ), g AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, k: ks IS NULL OR NOT list_contains(ks, k)), ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
    # the 160 bits of a digest by five
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
        ), k AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS last FROM p
        ), b AS (SELECT *, array_to_string(list_transform(string_split(digest, ''), lambda c: right('0000' || bin(instr('0123456789abcdef', c) - 1), 4)), '') AS bits FROM k)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS BIGINT) * (16 >> CAST(j AS INTEGER)))) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
        FROM b""",
    # in this table the article element is the main text
    "op8_html_text": r"""
        WITH a AS (
            SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g') AS t FROM pages
        ), p AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
        SELECT page_id, url, text, length(text) AS n_chars FROM p""",
    "op9_secret_counts": r"""
        SELECT doc_id,
               CAST(len(list_filter(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 6)) AS BIGINT) AS n_assign,
               CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS BIGINT) AS n_access,
               CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda v: length(v) >= 24)) AS BIGINT) AS n_hex
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "op10_suffixes": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), s AS (
            SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k
            FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 200)) AS i FROM d WHERE length(h) >= 400)
        ), m AS (SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)
        ), g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS new FROM m
        ), r AS (
            SELECT doc_id, min(i) AS b, max(i) + 200 AS e
            FROM (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run
        ), l AS (SELECT doc_id, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es, sum(e - b) AS gone FROM r GROUP BY doc_id
        ), k AS (SELECT d.doc_id, h, length(h) // 2 AS n, coalesce(bs, []) AS bs, coalesce(es, []) AS es, coalesce(gone, 0) AS gone FROM d LEFT JOIN l USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(len(bs) AS BIGINT) AS n_spans,
               sha256(unhex(array_to_string(list_transform(list_zip([0] || es, bs || [n]), lambda x: substr(h, 2 * x[1] + 1, 2 * (x[2] - x[1]))), ''))) AS kept_sha256
        FROM k""",
    "op3_jaccard": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), i AS (
            SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0
        ), s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM i
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), link AS (
            SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
        ), reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)""",
}

#: The same, with the number of other documents that each links with.
ORACLES["op3_jaccard_links"] = (
    ORACLES["op3_jaccard"]
    .replace("SELECT d.doc_id, coalesce(n, 0) AS n_shingles,", "SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(k.n_links, 0) AS n_links,")
    .replace("FROM d LEFT JOIN n USING (doc_id) JOIN", "FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY x) k USING (doc_id) JOIN")
)

#: The unsigned checksum of each ``s`` of ``keyed``, a byte at a time by the table of the 256 bytes' own checksums.
_CRC = """
        crc_table AS (
            SELECT CAST(list(c ORDER BY b) AS BIGINT[]) AS t FROM (SELECT b, list_reduce([CAST(b AS BIGINT)] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(b))
        ), crc_steps AS (
            SELECT s, hex(encode(s)) AS h, CAST(0 AS BIGINT) AS i, CAST(4294967295 AS BIGINT) AS c FROM keyed
            UNION ALL
            SELECT s, h, i + 1, xor(c // 256, t[CAST(xor(c % 256, CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS BIGINT)) + 1 AS BIGINT)]) FROM crc_steps, crc_table WHERE 2 * i < length(h)
        ), crcs AS (SELECT s, xor(c, 4294967295) AS crc FROM crc_steps WHERE 2 * i = length(h))"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spans_sql(kind: str, pattern: str, keep: str) -> str:
    """Places of the matches x of a pattern, which lie between what splitting by it leaves, where ``keep`` holds."""
    gaps, found = f"regexp_split_to_array(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}')"
    ends = f"list_transform(range(1, len({found}) + 1), lambda i: CAST(list_sum(list_transform(list_slice({gaps}, 1, i), lambda v: length(v))) + list_sum(list_transform(list_slice({found}, 1, i), lambda v: length(v))) AS BIGINT))"
    kept = f"list_filter(list_zip({found}, {ends}), lambda m: ({keep.replace('$x', 'm[1]')}))"
    return f"list_transform({kept}, lambda m: concat('{kind}:', m[2] - length(m[1]), ':', m[2])) AS {kind}"


_NUMBER = "regexp_replace($x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_NUMBER})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({_NUMBER}, -1 - i, 1) AS BIGINT) ELSE (2 * CAST(substr({_NUMBER}, -1 - i, 1) AS BIGINT)) // 10 + (2 * CAST(substr({_NUMBER}, -1 - i, 1) AS BIGINT)) % 10 END)) % 10 = 0"
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split($x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255')) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_NUMBER}) BETWEEN 16 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_NUMBER}) BETWEEN 8 AND 15"),
]

ORACLES["op11_personal_base"] = f"""
        WITH k AS (SELECT doc_id, {", ".join(_spans_sql(*k) for k in _KINDS)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
        SELECT doc_id, {", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k, _, _ in _KINDS)}, sha256(array_to_string(email || ip || card || phone, ',')) AS base_sha256 FROM k"""

ORACLES["op12_variants"] = f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) WHERE length(w) >= 5 GROUP BY ALL
        ), keyed AS (SELECT DISTINCT concat(doc_id, ':', w) AS s FROM runs
        ), {_CRC.strip()}, words AS (
            SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT CASE WHEN crc % 97 = 0 THEN concat(substr(w, 1, crc % length(w)), substr(w, crc % length(w) + 2)) ELSE w END AS w, n FROM runs JOIN crcs ON s = concat(doc_id, ':', w)
            ) WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3
        ), less AS (SELECT w, n, i, concat(substr(w, 1, i - 1), substr(w, i + 1)) AS v FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)
        ), near AS (
            SELECT DISTINCT a.w AS w, a.n AS n, b.w AS o, b.n AS m FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.w <> b.w
            UNION SELECT words.w, words.n, less.w, less.n FROM words JOIN less ON words.w = v
            UNION SELECT less.w, less.n, words.w, words.n FROM words JOIN less ON words.w = v
        ), best AS (SELECT w, count(*) AS n_near, arg_min(o, (-m, encode(o))) AS o, max(m) AS m FROM near GROUP BY w
        ), formed AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN o END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (w)
        ), follow AS (SELECT w, w AS at FROM formed UNION ALL SELECT follow.w, formed.form FROM follow JOIN formed ON formed.w = follow.at WHERE form IS NOT NULL)
        SELECT formed.w AS word, form, follow.at AS root, n, n_near, form_n
        FROM formed JOIN follow USING (w) JOIN (SELECT w FROM formed WHERE form IS NULL) l ON l.w = follow.at"""

#: A node is a depth and the row number of the smallest conversation that has its prefix.
ORACLES["op13_trie"] = rf"""
        WITH RECURSIVE turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS nth, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id
        ), keyed AS (SELECT CAST(conv_id AS VARCHAR) AS s FROM ids
        ), {_CRC.strip()}, known AS (
            SELECT ids.conv_id, ids.n, crc % 4 AS h, ids.conv_id - ids.conv_id % 20 AS donor, least(crc % 4, coalesce(d.n, 0)) AS k
            FROM ids JOIN crcs ON s = CAST(ids.conv_id AS VARCHAR) LEFT JOIN ids d ON d.conv_id = ids.conv_id - ids.conv_id % 20
        ), built AS (
            SELECT known.conv_id, nth AS depth, t FROM known JOIN turns ON turns.conv_id = donor AND nth <= h
            UNION ALL SELECT known.conv_id, nth - h + k, t FROM known JOIN turns ON turns.conv_id = known.conv_id AND nth > h
        ), hashed AS (
            SELECT conv_id, depth, sha256(string_agg(sha256(concat(length(t.role), ':', t.role, t.text)), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k, t.text AS text FROM built
            UNION ALL SELECT conv_id, 0, '', '' FROM ids
        ), nodes AS (SELECT depth, k, min(conv_id) AS node, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^ 	-
]+'))) AS words FROM hashed GROUP BY depth, k
        ), place AS (SELECT conv_id, depth, node, n_convs, words, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM hashed JOIN nodes USING (depth, k)
        ), own AS (
            SELECT p.node AS conv_id, p.depth, any_value(u.node) AS parent_conv_id, any_value(p.n_convs) AS n_convs, (any_value(p.n_convs) - 1) * any_value(p.words) AS saved,
                   coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (p.last), '') AS ends
            FROM place p LEFT JOIN place u ON u.conv_id = p.conv_id AND u.depth = p.depth - 1 GROUP BY p.node, p.depth
        ), down AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM own WHERE depth > 0 GROUP BY ALL
        ), whole AS (
            SELECT p.node AS conv_id, p.depth, sum(CAST(n_children IS NULL AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens
            FROM own JOIN place p ON p.conv_id = own.conv_id AND p.depth <= own.depth LEFT JOIN down ON down.conv_id = own.conv_id AND down.depth = own.depth GROUP BY p.node, p.depth
        )
        SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
        FROM own JOIN whole USING (conv_id, depth) LEFT JOIN down USING (conv_id, depth)"""
