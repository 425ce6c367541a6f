"""Selection without a sort against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import relational as rel
from quillspark.operators import selection
from quillspark.operators.selection import ascending, hashed, mark_first, real


def chosen(df, *key):
    return sorted(tuple(r[k] for k in key) for r in df.where("chosen").collect())


@pytest.mark.parametrize("few", [0, 40, 50_000])
@pytest.mark.parametrize("need", [0, 7, 1000, 2999, 9999])
def test_numbers(spark, need, few, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(need)
    vals = [rng.choice([rng.randrange(-(2**63), 2**63), rng.randrange(-5, 5)]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(vals)), "id long, v long").repartition(7)
    got = chosen(mark_first(df, [*ascending(F.col("v")), *ascending(F.col("id"))], need), "v", "id")
    assert got == sorted(sorted((v, i) for i, v in enumerate(vals))[:need])


@pytest.mark.parametrize("few", [0, 50_000])
def test_reals_of_every_kind_and_groups(spark, few, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    special = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, 1e-323, 1.7e308, -1.7e308, 1.0, 1.0]
    rows = [(g, v, i) for i, (g, v) in enumerate((g, v) for g in ("a", "b", None) for v in special * (1 if g == "a" else 4))]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(5)
    place = lambda v: (0, 0) if v is None else (2, 0) if math.isnan(v) else (1, v)
    for down in (False, True):
        order = lambda r: ((-place(r[1])[0], -place(r[1])[1]) if down else place(r[1]), r[2])  # noqa: E731, B023
        want = sorted(i for g in ("a", "b", None) for _, _, i in sorted((r for r in rows if r[0] == g), key=order)[:11])
        got = mark_first(df, [*real(F.col("v"), down), *ascending(F.col("id"))], 11, ["g"], keep_keys=down)
        assert [x[0] for x in chosen(got, "id")] == want


def test_need_by_group_and_empty_tables(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 4)
    out = mark_first(df, ascending(F.col("id")), F.col("_g.g") * 3, ["g"])
    assert {r["g"]: r["count"] for r in out.where("chosen").groupBy("g").count().collect()} == {1: 3, 2: 6, 3: 9}
    least = mark_first(df.where("g < 3 or id < 20"), ascending(F.col("id")), lambda s: F.lit(s.agg(F.min("count")).first()[0]), ["g"])
    assert {r["count"] for r in least.where("chosen").groupBy("g").count().collect()} == {5}
    assert mark_first(df.limit(0), ascending(F.col("id")), 5).count() == 0


@pytest.mark.parametrize("few", [0, 50_000])
def test_repeated_rows_are_told_apart(spark, few, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    df = spark.range(50).select((F.col("id") * 0).alias("k"), (F.col("id") % 2).alias("chosen"), F.col("id")).repartition(6)
    out = mark_first(df, hashed(F.md5(F.col("k").cast("string"))), 20)
    assert out.columns == ["k", "id", "chosen"]
    assert out.where("chosen").count() == 20
    same = spark.range(40).select(F.lit(1).alias("k"))
    assert mark_first(same, ascending(F.col("k")), 13).where("chosen").count() == 13


def test_selection_needs_no_sort(spark):
    rows = spark.range(1000).withColumnRenamed("id", "seq")
    plan = rel.sample(rows, 30, "s")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    want = sorted(range(1000), key=lambda i: __import__("hashlib").md5(f"s|{i}".encode()).hexdigest())[:30]
    assert sorted(r[0] for r in rel.sample(rows, 30, "s").collect()) == sorted(want)


def test_splits_with_null_keys(spark):
    df = spark.range(60).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("q"))
    out = rel.group_split(df, "q", 0.4, "s")
    assert out.count() == 60
    assert out.where("split = 'test'").select("q").distinct().count() == 2
    assert rel.stratified_sample(df, "q", 24, "s").where("chosen").count() == 24
    none = df.withColumn("stage", F.lit(None).cast("int")).withColumn("total_delta", F.lit(1.0)).withColumn("score_delta", F.lit(0.0))
    assert sorted(r["seq"] for r in rel.balanced(none, k=4).collect()) == sorted(r["seq"] for r in rel.balance(none, k=4).collect()) == [0, 1, 2, 3]


def test_pending_takes_the_first_row_of_a_key(spark):
    w = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z"), (4, None, "u"), (5, None, "v")], "seq long, key string, t string")
    out = rel.pending(w, w.where("key = 'b'"), "key")
    assert out.columns == ["seq", "key", "t"]
    assert sorted(r["t"] for r in out.collect()) == ["u", "y"]
