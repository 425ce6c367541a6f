"""Steps whose time or memory must not grow faster than their input."""

from pathlib import Path

import pytest

from quillspark.operators import aggregates as agg
from quillspark.operators import external, judges
from quillspark.operators import relational as rel
from quillspark.plans import catalog, derived
from quillspark.sources import files

D = "/root/testdata/sf0.001"


def test_words_of_documents_in_splits(spark, tmp_path):
    """As many as in whole files, wherever a split ends; a folder of files is one document."""
    text = "".join(f"wörd{i} b c\x85d \r\n" + "\n" * (i % 3) for i in range(200)) + "last"
    (tmp_path / "one.txt").write_text(text, newline="")
    (tmp_path / "many").mkdir()
    for i in range(3):
        (tmp_path / "many" / f"part-{i}").write_text(text, newline="")
    (tmp_path / "empty.txt").write_text("")
    paths = {k: str(tmp_path / p) for k, p in (("one", "one.txt"), ("none", "none.txt"), ("empty", "empty.txt"), ("many", "many"))}
    (whole,) = files.text_documents(spark, {"one": paths["one"]}).collect()
    assert whole["word_count"] == 801
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = {r["doc_type"]: (r["seq"], r["word_count"]) for r in files.document_words(spark, paths).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == {"one": (0, 801), "many": (3, 2403)}


@pytest.mark.skipif(not Path(D).exists(), reason="no tables")
def test_no_document_is_read_as_one_row(spark, monkeypatch):
    monkeypatch.setattr(files, "text_documents", lambda *_: pytest.fail("whole files in one row"))
    assert catalog.QUERIES["io_text_documents"](spark, D).count() == 3


def test_python_gets_prompts_only(spark):
    """Other columns stay in the JVM, as they are, and no block of rows is held as a frame."""
    rows = spark.createDataFrame([(2**53 + 1, "a"), (None, "b")], "seq long, text string")
    work = rows.selectExpr("seq", "text AS key", "'q' AS query", "'x' AS config_a", "'y' AS config_b", "text AS response_a", "text AS response_b")
    stub = external.DeterministicProvider
    for out in (external.answer(rows, "text", stub), external.tool_loop(rows, "text", stub, str), judges.pairwise(work, stub), judges.extract(rows, stub, "entities array<struct<name:string>>")):
        assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r["seq"] for r in out.select("seq", out.columns[-1]).collect()} == {2**53 + 1, None}


@pytest.mark.skipif(not Path(D).exists(), reason="no tables")
def test_scores_are_built_once_a_row(spark):
    """A filter on the winner is pushed into the join; it must not build the maps of scores there, once for each score."""
    plan = derived.scored_pairs(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_arrays") == 2


@pytest.mark.skipif(not Path(D).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["knowledge_order", "category_order"])
def test_categories_are_found_once(spark, monkeypatch, name):
    """Numbering reads its rows twice; texts must not be scanned again for that."""
    number = rel.by_category

    def checked(rows, *args):
        assert "EvalPython" not in rows._jdf.queryExecution().optimizedPlan().toString()
        return number(rows, *args)

    monkeypatch.setattr(rel, "by_category", checked)
    assert catalog.QUERIES[name](spark, D).count() > 0


@pytest.mark.skipif(not Path(D).exists(), reason="no tables")
def test_pairs_of_the_funnel_are_joined_once(spark, monkeypatch):
    count = agg.dataset_stats

    def checked(raw, filtered, deduped, balanced, split, key):
        for df in (filtered, deduped, balanced, split):
            assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        return count(raw, filtered, deduped, balanced, split, key)

    monkeypatch.setattr(agg, "dataset_stats", checked)
    assert catalog.QUERIES["dataset_funnel"](spark, D).count() == 1


@pytest.mark.skipif(not Path(D).exists(), reason="no tables")
def test_files_grow_in_number(spark, monkeypatch):
    """Not in size: a table that is read in more splits is written in more files."""
    found, read = [], files.json_lines
    monkeypatch.setattr(files, "json_lines", lambda s, path, schema: found.append(len(s.read.text(path).inputFiles())) or read(s, path, schema))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        out = catalog.QUERIES["io_json_order"](spark, D)
        assert [r["pos"] for r in out.orderBy("doc_id").collect()] == list(range(out.count()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] > 5
