"""Counts of one pass against regular expressions, pattern by pattern."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark import lexicons
from quillspark.functions import scan, text
from quillspark.plans.text_queries import FRAGMENTS

LISTS = [lexicons.EXAMPLE_MARKERS, lexicons.GROUNDING_MARKERS, lexicons.HEDGES, lexicons.HEDGES_SHORT, lexicons.SEARCH_TRIGGERS, [rf"\[{t}\]" for t in lexicons.CLAIM_TAGS]]


def texts(seed, n, words):
    rng = random.Random(seed)
    return ["".join(rng.choice(words) + rng.choice([" ", " ", "", "\n", ". ", ", "]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [4 << 20, 700])
def test_terms_at_boundaries(monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    terms = [scan.Term("the", True, True), scan.Term("a b"), scan.Term("é", True, True), scan.Term("he"), scan.Term("x", True), scan.Term("日", False, True), scan.Term("[T]"), scan.Term("e.g.", False, True)]
    some = [*texts(1, 800, ["the", "then", "é", "éa", "a", "b", "x", "xx", "_x", "he", "日", "the日", "ß", "[T]", "e.g.", "𝒳", "1"]), None, "", "he" * 3000]
    got = scan.Counter([[t] for t in terms], False)(pa.array(some)).to_pylist()
    pattern = lambda t: (r"\b" if t.left else "") + re.escape(t.text) + (r"\b" if t.right else "")
    assert got == [None if s is None else [len(re.findall(pattern(t), s)) for t in terms] for s in some]
    sliced = scan.Counter([terms], True)(pa.array(some)[5:90]).to_pylist()
    assert sliced == [[sum(bool(re.search(pattern(t), s)) for t in terms)] for s in some[5:90]]


def test_no_terms_and_no_texts():
    assert scan.Counter([[]], False)(pa.array(["a", None])).to_pylist() == [[0], None]
    assert scan.Counter([[scan.Term("a")]], False)(pa.array([], pa.string())).to_pylist() == []


def test_expansion():
    assert scan.terms_of("research (?:shows|found)") == [scan.Term("research shows"), scan.Term("research found")]
    assert scan.terms_of(r"\bv?1\d\b")[0] == scan.Term("10", True, True)
    assert len(scan.terms_of(r"\bv?1\d\b")) == 20
    assert scan.terms_of("a.*b") is None
    assert scan.terms_of("aa") is None  # occurrences can overlap
    assert scan.terms_of(r"\b(?:that|this)\b") is not None  # whole words can't
    assert scan.terms_of(r"such as\b") is not None
    assert scan.terms_of("abc|bcd") is None
    assert scan.required(r"like the\b.*\b(?:in|of)\b") == ["like the"]
    assert scan.required(r"\s*(?:one|two)[:]") == ["one", "two"]
    assert scan.required(r"\d+") is None


def test_lists_against_each_pattern(spark):
    words = re.findall(r"[\w.']+|\[\w+\]|[,:]", " ".join([*FRAGMENTS, "consider the example real-world example like the rest of treat as tentative could not find one example étude e.g.x"]))
    rows = [(i, t) for i, t in enumerate([*texts(2, 400, words), *FRAGMENTS, "", None])]
    t = F.lower("t")
    each = [sum((F.regexp_count(t, F.lit(scan.FLAGS + p)) for p in some[1:]), F.regexp_count(t, F.lit(scan.FLAGS + some[0]))) for some in LISTS]
    df = spark.createDataFrame(rows, "i int, t string")
    got = df.select("i", *(c.alias(f"c{k}") for k, c in enumerate(scan.counts(t, LISTS)))).collect()
    want = df.select("i", *(c.alias(f"c{k}") for k, c in enumerate(each))).collect()
    assert sorted(got) == sorted(want)


def test_categories_against_each_term(spark):
    words = " ".join(t for terms in lexicons.CATEGORIES.values() for t in terms).split() + ["the", "limits", "p-value,", "écause"]
    rows = [(i, t) for i, t in enumerate(texts(3, 300, words))]
    hit = lambda t, s: (t in s) if " " in t else bool(re.search(rf"\b{re.escape(t)}\b", s))
    for r in spark.createDataFrame(rows, "i int, t string").select("t", text.category_hits(F.col("t"), threshold=1).alias("h")).collect():
        want = {c: n for c, terms in lexicons.CATEGORIES.items() if (n := sum(hit(t, r["t"].lower()) for t in terms))}
        assert {x["category"]: x["hits"] for x in r["h"]} == want
        order = list(lexicons.CATEGORIES)
        assert [x["category"] for x in r["h"]] == sorted(want, key=lambda c: (-want[c], order.index(c)))
