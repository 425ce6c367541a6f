"""The queries over the smallest tables: SQL where there is some, held-out accuracy, and the pipeline's stages against plain code."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import queries
from quillspark.llm.common import held_out, table

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, D)
    want = sql.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted((key(r) for r in got.select(*want.columns).collect()), key=repr) == sorted((key(r) for r in want.fetchall()), key=repr)


def test_language_of_held_out_documents(spark):
    out = queries.QUERIES["op1_langid"](spark, D).join(table(spark, D, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert right >= 0.95 * n > 0


def test_extracted_pages(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, D, "pages").collect()}
    from html import unescape

    for r in queries.QUERIES["op8_html"](spark, D).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.DOTALL)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(p for p in parts if p)


def test_no_document_is_lost(spark):
    n = table(spark, D, "documents").count()
    for name in ("op5_tokens", "op6_toxicity"):
        assert queries.QUERIES[name](spark, D).count() == n
    fold = queries.QUERIES["op6_toxicity"](spark, D).where(F.col("held_out") != held_out(F.col("doc_id"))).count()
    assert fold == 0


def test_pipeline_stages(spark):
    docs = table(spark, D, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, D), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
        seen[name], docs = (docs, out), out
    before, after = seen["ngram_jaccard"]
    kept = {r["doc_id"] for r in after.collect()}
    from tests.llm.test_edges import brute_components

    assert kept == {c for _, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()]).values()}
    before, after = seen["decontaminate"]
    assert before.count() >= after.count() > 0
    before, after = seen["mixing"]
    count = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(count(after) - 1.5 * count(before)) <= 40
    before, after = seen["tokens"]
    assert before.count() == after.count()
    assert sorted(r["doc_id"] for r in before.collect()) == sorted(r["doc_id"] for r in after.collect())
