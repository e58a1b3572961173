"""The registered queries against their SQL, and the pipeline against its stages' definitions."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from farstray.llm import bpe, decontaminate, jaccard, secrets, toxicity
from farstray.llm.common import checkpointed
from farstray.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = con.sql(ORACLES[name]).select(*columns).fetchall()
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(expected, key=str)  # nulls have no order


def test_every_query_has_a_row_for_each_input(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    for name in ("op1_toxicity", "op7_bpe", "op9_secrets", "op10_suffixes", "op11_personal"):
        assert QUERIES[name](spark, SF).select("doc_id").exceptAll(docs.select("doc_id")).isEmpty(), name
        assert QUERIES[name](spark, SF).count() == docs.count(), name
    for name in ("op6_warc", "op8_html_text"):
        assert QUERIES[name](spark, SF).count() == pages.count(), name


def test_pipeline_stages_take_effect(spark):
    """Each stage against what its operator says of its own input, put together here row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            expected = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
        elif name == "near_duplicates":
            expected = {r["component_id"] for r in jaccard.similar_components(docs).collect()}
        elif name == "decontamination":
            marked = decontaminate.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            expected = {r["doc_id"] for r in marked.where("NOT contaminated").collect()}
        else:
            expected = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept == expected and out.count() == len(kept), name
        if name == "secrets":
            redacted = {r["doc_id"] for r in secrets.scan(docs).where("spans <> ''").collect()}
            for r in out.collect():
                assert (r["text"] == rows[r["doc_id"]]) == (r["doc_id"] not in redacted) and r["n_chars"] == len(r["text"])
            assert secrets.scan(out).agg(F.sum(F.col("n_access") + F.col("n_hex"))).first()[0] == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            docs = out
    import public_tokenizers as P

    library = pytest.importorskip("tiktoken").Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {i: len(library.encode_ordinary(t or "")) for i, t in texts.items()}


def test_pipeline_with_nulls_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "some words of a text", None, None, None), (3, "one two", None, "b", 7), (3, "one two", None, "b", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "2", "3", "3", "None"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_pipeline_against_definitions_of_its_own(spark, tmp_path):
    """Each stage on a small corpus against brute force that shares nothing with the operators; extra columns clash."""
    rng = random.Random(21)
    words = [f"w{i}x" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(60) + (" zorkig grubvex plimskrat" if i % 5 == 0 else "")) for i in range(150)]
    passage = text(12)
    copy = rows[1][1]
    near = " ".join([*copy.split()[:-2], "other", "end"])
    rows += [(200, copy), (None, copy), (None, near), (7, copy), (201, "start " + passage + " and more " + text(20)), (202, f"key api_key = Zx9aQ71kLmP0 {text(20)}"), (203, ""), (204, None), (7, text(40)), (205, f"AKIA{'Q7Z' * 6} {text(10)}"), (205, f"AKIA{'Q7Z' * 6} {text(10)}")]
    schema = "doc_id long, text string, row long, node string, score double, label string, gone int, spans string"
    docs = spark.createDataFrame([(i, t, 1, "n", 0.5, "l", 2, "s") for i, t in rows], schema).repartition(3)
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept = [(i, t) for i, t in rows if "zorkig" not in (t or "")]
    stages = [dict(corpus_pipeline.STAGES)[k] for k in ("toxicity", "near_duplicates", "decontamination", "secrets", "tokens")]
    show = lambda rows: sorted(map(str, rows))
    out = stages[0](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and show((r["doc_id"], r["text"]) for r in out.collect()) == show(kept)
    chosen = []
    for i, t in sorted(set(kept), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        s = shingles(t or "")
        if not s or not any(100 * len(s & o) >= 75 * len(s | o) for o in (shingles(u or "") for _, u in chosen) if o):
            chosen.append((i, t))
    kept = [r for r in kept if r in set(chosen)]
    out = stages[1](spark, checkpointed(out), str(tmp_path))
    assert show((r["doc_id"], r["text"]) for r in out.collect()) == show(kept) and (None, copy) not in kept and (7, copy) not in kept
    kept = [(i, t) for i, t in kept if passage not in (t or "")]
    out = stages[2](spark, checkpointed(out), str(tmp_path))
    assert show((r["doc_id"], r["text"]) for r in out.collect()) == show(kept) and 201 not in {i for i, _ in kept}
    hide = lambda t: t and t.replace("api_key = Zx9aQ71kLmP0", "[secret]").replace(f"AKIA{'Q7Z' * 6}", "[secret]")
    kept = [(i, hide(t)) for i, t in kept]
    out = stages[3](spark, checkpointed(out), str(tmp_path))
    assert out.columns == docs.columns and show((r["doc_id"], r["text"]) for r in out.collect()) == show(kept)
    assert show(r["doc_id"] for r in stages[4](spark, checkpointed(out), str(tmp_path)).collect()) == show(i for i, _ in kept)
