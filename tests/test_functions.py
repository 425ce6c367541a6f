import math

import pytest
from pyspark.sql import functions as F

from quillspark import lexicons
from quillspark.functions import json_text, scoring, templates, text


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()




def test_tags_and_total(spark):
    r = one(spark, "[UNKNOWN] x [UNKNOWN] [LIKELY] [unknown] [TYPE-A]", text.tag_counts(F.col("t")))[0]
    assert (r["UNKNOWN"], r["LIKELY"], r["total"]) == (2, 1, 3)


@pytest.mark.parametrize(("s", "n"), [("", 0), ("...", 0), ("a" * 20 + ".", 0), ("a" * 21 + "! " + "b" * 25 + "?", 2), (" \t" + "a" * 20 + "\n.", 0)])
def test_claims(spark, s, n):
    assert one(spark, s, text.claims(F.col("t")))[0] == n


@pytest.mark.parametrize("s", ["", "a b c\n d", "  ", "x y"])
def test_words(spark, s):
    assert one(spark, s, text.words(F.col("t")))[0] == len(s.split())


def test_markers(spark):
    assert one(spark, "For example, e.g.x and e.g. y. UDAHARANA such as", text.example_markers(F.col("t")))[0] == 3
    assert one(spark, "According to Source: a study by X, for instance:", text.grounding_markers(F.col("t")))[0] == 2
    assert one(spark, "I'm not sure; it is unclear. Roughly", text.hedges(F.col("t")))[0] == 3
    assert one(spark, "could not find\nany example", text.hedges(F.col("t"), lexicons.HEDGES_SHORT))[0] == 0


def test_steps(spark):
    assert one(spark, "1. a\n 2) b\nClaim: x\nno Claim: y", text.reasoning_steps(F.col("t")))[0] == 3
    s = one(spark, "1. **Pratijna\nhetu\nUDAHARANA\nupanaya\nNIGAMANA\nhetu", text.syllogism(F.col("t")))[0]
    assert (s["hetu"], s["complete"]) == (2, 1)


def test_categories(spark):
    r = one(spark, "Because of this mechanism it leads to a limit. cause", text.category(F.col("t")), text.category_hits(F.col("t")))
    assert r[0] == "rajas"
    assert r[1][0]["hits"] == 4
    assert one(spark, "causes and becauses", text.category(F.col("t")))[0] == "unclassified"
    # A tie goes to the category that is declared first.
    assert one(spark, "taxonomy definition whereas unlike", text.category(F.col("t")))[0] == "prakriti"
    assert one(spark, "real-world p-value median", text.category(F.col("t")))[0] == "tanmatra_statistical"


def test_thinking(spark):
    r = one(spark, "<think>a</think> x <think>b", text.strip_thinking(F.col("t")), text.strip_all_thinking(F.col("t")))
    assert r[0] == "x <think>b"
    assert r[1] == "x"
    assert one(spark, "<think>all", text.strip_all_thinking(F.col("t")))[0] == "<think>all"


def test_sentences_and_routing(spark):
    assert one(spark, "A b. C d! E", text.first_sentences(F.col("t"), 2))[0] == "A b. C d!"
    assert one(spark, "What is the current price?", text.needs_search(F.col("t")))[0]
    assert not one(spark, "Why do birds sing?", text.needs_search(F.col("t")))[0]


@pytest.mark.parametrize(
    ("s", "want"),
    [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 2}\n```', '{"a": 2}'), ('Sure: {"a": {"b": 3}} ok }', '{"a": {"b": 3}}'), ("no json", None), ('{"a": ', None), ("[1, 2]", "[1, 2]")],
)
def test_salvage(spark, s, want):
    assert one(spark, s, json_text.salvage(F.col("t")))[0] == want


def test_salvage_loose_and_unfenced(spark):
    assert one(spark, 'x ```\nno\n``` ```JSON {"a": 1}``` y', json_text.salvage_loose(F.col("t")))[0] == '{"a": 1}'
    assert one(spark, 'pre {"a": 1} post', json_text.salvage_loose(F.col("t")))[0] == '{"a": 1}'
    assert one(spark, '```json\n{"a": 1}\n```', json_text.unfenced(F.col("t")))[0] == '{"a": 1}'
    assert one(spark, "```x```", json_text.unfenced(F.col("t")))[0] is None


def test_dominant_dimension(spark):
    def dom(w, x):
        df = spark.createDataFrame([(w, x)], "w map<string,double>, l map<string,double>")
        r = df.select(scoring.dominant(F.col("w"), F.col("l")).alias("d"), scoring.total_delta(F.col("w"), F.col("l")).alias("t")).first()
        return tuple(r["d"]), r["t"]

    assert dom({"completeness": 4.0, "usefulness": 4.0}, {"completeness": 2.0, "usefulness": 2.0}) == ((2, "completeness", 2.0), 4.0)
    assert dom({d: 1.0 for d in lexicons.DIMENSIONS}, {d: 3.0 for d in lexicons.DIMENSIONS}) == ((3, "calibration", 0.0), -10.0)


def test_realigned(spark):
    df = spark.createDataFrame([(["y", "x"], "A", {"d": 5.0}, {"d": 1.0})], "o array<string>, w string, f map<string,double>, s map<string,double>")
    r = df.select(scoring.realigned(F.col("o"), F.col("w"), F.col("f"), F.col("s"), F.lit("x")).alias("r")).first()["r"]
    assert (r["winner"], r["scores_a"], r["scores_b"]) == ("y", {"d": 1.0}, {"d": 5.0})


def test_effects(spark):
    r = spark.range(1).select(scoring.cohens_h(F.lit(0.6), 0.5).alias("h"), scoring.percent(F.lit(0.005)).alias("a"), scoring.percent(F.lit(0.025)).alias("b")).first()
    assert math.isclose(r["h"], 2 * (math.asin(math.sqrt(0.6)) - math.asin(math.sqrt(0.5))))
    assert (r["a"], r["b"]) == ("0", "2")


def test_templates(spark):
    df = spark.createDataFrame([("Q", ["a", "b"], {"k": "v"}, [("s", None)])], "q string, xs array<string>, m map<string,string>, c array<struct<query:string,result:string>>")
    r = df.select(templates.bullets(F.col("xs")), templates.pairs_text(F.col("m")), templates.tool_calls_text(F.col("c")), templates.operation(F.lit("causal")), templates.operation(F.lit("z")), templates.pretraining_arm(F.lit("q-x-pre")), templates.short_model_name(F.lit("org/Name"), {})).first()
    assert tuple(r) == ("- a\n- b", "k: v", "Search 1: s -> N/A", "force", "general", "x", "name")
    p = df.select(templates.provenance(F.lit("Fetch FAILED"), F.lit("ok")).alias("p"), templates.provenance(F.lit(None).cast("string"), F.lit("")).alias("q")).first()
    assert tuple(p["p"]) == ("ok", "fallback")
    assert p["q"]["source"] == "failed"
