"""What is bounded stays bounded, and nothing is left out for it."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import langid, substring_dedup, token_output, toxicity
from quillspark.llm.common import drawn_below


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(n)]


def test_small_blocks_find_the_same(spark):
    rng = random.Random(1)
    shared = words(rng, 60)
    rows = [(i, " ".join(words(rng, 50) + (shared if i % 3 else shared[i : i + 40]) + words(rng, 20))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    some, many = ({r["doc_id"]: r["text"] for r in substring_dedup.remove(docs, size).collect()} for size in (1 << 30, 20))
    assert some == many
    assert some != dict(rows)


def test_dictionary_of_long_documents_only(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 12_000))) for i in range(60)], "doc_id long, text string")
    assert docs.where(F.length("text") <= token_output.SAMPLE_CHARS).count() == 0
    dictionary = token_output.train_dictionary(docs, token_output.default_tokenizer())
    assert dictionary[:4] == b"\x37\xa4\x30\xec"  # the mark of a trained one


def test_share_of_very_many_rows(spark):
    df = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    assert df.where(drawn_below(F.col("h"), F.lit(0.25))).count() == pytest.approx(50_000, rel=0.03)
    # A share that is no whole millionth still takes rows.
    assert 0 < df.where(drawn_below(F.col("h"), F.lit(3e-4))).count() < 130


def test_filter_grows_with_the_largest_language():
    few, many = (langid.Model(["x"], 0, [np.arange(n, dtype=np.uint64)]) for n in (10, 1 << 19))
    assert few.slots < many.slots
    assert many.wrong[0] < 0.01


def test_long_labelled_texts_are_cut_in_the_fit(spark):
    de, en = "der Hund und das Haus stehen dort ", "the dog and the house are over there "
    rows = [(1, de * 3000, "de"), (2, de * 3000, "de"), (3, en * 3000, "en"), (5, en * 3000, "en")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_bytes=2000)
    out = langid.identify(spark.createDataFrame([("das Haus und der Hund",), ("the house and the dog",)], "text string"), model)
    assert {r["text"][:3]: r["lang_pred"] for r in out.collect()} == {"das": "de", "the": "en"}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "ä" * 10_000), (2, "ö" * 10_000)], "doc_id long, text string")
    assert "b" not in toxicity.fit(docs, labels, max_bytes=101)


def brute_score(model, text):
    """The score of one text, word by word."""
    if "b" not in model:
        return model["prior"]
    lengths = [toxicity._Lengths(model[k]) for k in ("ordinary", "toxic")]
    low = text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    own = [w for w in low.replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    weights = []
    for w in own:
        ordinary, toxic = (int(f([b" " + w + toxicity.PAD])[0]) for f in lengths)
        cell = (min(max(ordinary - toxic + 8, 0), 31) * 64 + min(toxic, 63)) * 16 + min(len(w), 15)
        weights.append(model["weights"][cell])
    x = [np.log1p(len(own)), *(np.log1p(sum(v >= t for v in weights)) for t in toxicity.STEPS), max([0.0, *weights])] if own else np.zeros(len(toxicity.STEPS) + 2)
    return float(1 / (1 + np.exp(-np.clip(((np.array(x) - model["mean"]) / model["scale"]) @ model["b"][:-1] + model["b"][-1], -30, 30))))


def test_toxicity_word_by_word(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randrange(20, 60)) + (["vilest", "slurword", "hateful"] * (i % 4 == 0)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert "b" in model
    probes = [*[t for _, t in rows[:40]], "", "  \n", "vilest VILEST\tslurword", "ü" * 300]
    got = {r["text"]: r["score"] for r in toxicity.score(spark.createDataFrame([(t,) for t in probes], "text string"), model).collect()}
    for t in probes:
        assert got[t] == pytest.approx(brute_score(model, t), abs=1e-9)


def test_members_by_hand():
    a, b = langid._Counts(), langid._Counts()
    a.add(np.array([1, 1, 2, 2, 3] + [9] * 95, np.uint64))
    b.add(np.array([1] * 30 + [2, 2] + [3] * 68, np.uint64))
    for c in (a, b):
        c.merge()
    assert [m.tolist() for m in langid.members([a, b])] == [[2, 9], [1, 2, 3]]


CASES = [(1, "short text", "en", "s", 10), (1, "short text", "en", "s", 10), (None, None, None, None, None), (2, "", None, "s", 0), (3, "a b c d e f g h " * 3000, "en", None, None), (None, "some words here", "en", "t", 15)]


def test_pipeline_stages_on_edges(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names; and no rows at all."""
    spark.createDataFrame([(1, "zz yy xx")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit("clash") for c in ("score", "target", "component_id", "n_words", "items", "finish", "quill__x")}
    for rows in (CASES, []):
        docs = spark.createDataFrame(rows, schema).withColumns(clash)
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
            if name == "tokens":
                assert set(out.columns) >= {"doc_id", "start", "n_tokens", "ids_crc32"}
                break
            assert out.columns == corpus_pipeline.COLUMNS
            texts = sorted((r["text"] for r in out.collect()), key=repr)
            if not rows:
                assert texts == []
            elif name == "toxicity":
                assert texts == sorted((r[1] for r in rows), key=repr)
            else:  # copies of one id become one row, other clean rows stay
                assert {"short text", None, "", "some words here"} <= set(texts)
            docs = out


def test_pieces_of_arrow_are_whole():
    from quillspark.llm import textnp as T

    column = pa.array(["a" * 10, None, "b" * 50, "c"])
    assert [(lo, hi) for lo, hi, _, _ in T.pieces(column, 12)] == [(0, 2), (2, 3), (3, 4)]
