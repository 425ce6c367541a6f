import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillspark.operators import aggregates as agg
from quillspark.operators import external, graph, statistics
from quillspark.operators import relational as rel
from quillspark.sources import files
from quillspark.streaming import resume


def rows(spark, n, **columns):
    return spark.range(n).select(F.col("id").alias("seq"), *(c.alias(k) for k, c in columns.items()))


@pytest.mark.parametrize(("n", "valid"), [(1, 1), (9, 1), (10, 1), (19, 1), (25, 3), (60, 6), (300, 30)])
def test_systematic_split(spark, n, valid):
    out = rel.systematic_split(rows(spark, n), F.col("seq"))
    assert out.where("split = 'valid'").count() == valid


def test_gates_and_their_splits(spark):
    r = rows(spark, 300, stage=(F.col("id") % 5 + 1).cast("int"))
    g = rel.cumulative_gates(r)
    assert {x["gate"]: x["count"] for x in g.groupBy("gate").count().collect()} == {k: 60 * k for k in range(1, 6)}
    valid = rel.systematic_split(g.where("gate = 3"), F.col("seq")).where("split = 'valid'").count()
    assert valid == 18


def test_missing_stage_enters_every_gate(spark):
    r = spark.createDataFrame([(0, None), (1, 5)], "seq long, stage int")
    assert rel.cumulative_gates(r).count() == 6


def test_keep_first_last_upsert(spark):
    r = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "seq long, k string, v int")
    assert sorted(map(tuple, rel.first_of(r, ["k"]).select("k", "v").collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, rel.last_of(r, ["k"]).select("k", "v").collect())) == [("a", 3), ("b", 2)]
    assert sorted(map(tuple, rel.upsert(r, ["k"]).select("k", "v", "seq").collect())) == [("a", 3, 0), ("b", 2, 1)]


def test_missing_and_empty_responses(spark):
    j = spark.createDataFrame([(q, "a", "b", "a", 5.0) for q in range(5)] + [(5, "a", "b", "TIE", 0.0), (6, "a", "b", "a", 1.0)], "query_id long, config_a string, config_b string, winner string, total_delta double")
    texts = {0: ("x", "y"), 1: ("", "y"), 2: ("x", None), 4: ("x",), 5: ("", ""), 6: (None, "y")}
    r = spark.createDataFrame([(q, arm, t, 2 * q + i) for q, pair in texts.items() for i, (arm, t) in enumerate(zip("ab", pair))], "query_id long, arm string, response string, seq long")
    status = lambda **kw: [x["status"] for x in rel.extraction_status(j, r, 3.0, **kw).orderBy("query_id").collect()]
    assert status() == ["kept", "missing", "missing", "missing", "missing", "tie", "missing"]
    assert status(allow_empty=True) == ["kept", "kept", "kept", "missing", "missing", "tie", "weak"]
    assert set(rel.extraction_status(j, r).columns) == {*j.columns, "loser", "preferred", "rejected", "status"}


def test_equal_scores_tie_however_they_are_spread(spark):
    scores = rows(spark, 5000, scores=F.create_map(F.lit("x"), (F.col("id") * 7919 % 31 / 10), F.lit("y"), F.col("id") % 5 + 0.5))
    one, many = scores.coalesce(1), scores.repartition(7, "seq").sortWithinPartitions(F.col("seq").desc())
    for first, second in ((one, many), (many, one)):
        got = {r["framework"]: r for r in agg.overall_variance({"first": first, "second": second}).collect()}
        assert got["first"]["variance"] == got["second"]["variance"]
        assert {k: r["most_discriminating"] for k, r in got.items()} == {"first": True, "second": False}
    want = scores.agg(F.var_pop(F.col("scores")["x"] + F.col("scores")["y"])).first()[0]
    assert got["first"]["variance"] == pytest.approx(want, rel=1e-12)


def test_variance_of_odd_scores(spark):
    frame = lambda *totals: spark.createDataFrame([(None if t is None else {"x": t} if t != "none" else {},) for t in totals], "scores map<string,double>")
    variance = lambda **f: {r["framework"]: (r["n"], r["variance"], r["most_discriminating"]) for r in agg.overall_variance(f).collect()}
    assert variance(a=frame(1.0, 3.0, None, "none"), b=frame(5.0)) == {"a": (2, 1.0, True), "b": (1, 0.0, False)}
    assert variance(a=frame(1.0), b=frame(None, "none")) == {}
    assert variance(a=frame(1e6 + 1, 1e6 - 1), b=frame(1e30, 3e30)) == {"a": (2, 1.0, False), "b": (2, pytest.approx(1e60), True)}
    got = variance(a=frame(1.0, 3.0), b=frame(1.0, float("nan")))
    assert math.isnan(got["b"][1])
    assert got["a"] == (2, 1.0, False)


def test_group_split_does_not_leak(spark):
    out = rel.group_split(rows(spark, 100, q=F.col("id") % 20), "q", 0.12, "s")
    sides = out.groupBy("q").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert sides == 1
    assert out.where("split = 'test'").select("q").distinct().count() == 2


def test_orders(spark):
    r = spark.createDataFrame([(0, 2), (1, 1), (2, None), (3, 1)], "seq long, stage int").withColumns({"total_delta": F.lit(None).cast("double"), "score_delta": F.col("seq").cast("double")})
    order = lambda mode: [x["seq"] for x in rel.curriculum(r, mode).orderBy("pos").collect()]
    assert order("yoga") == [1, 3, 0, 2]
    assert order("reverse") == [2, 0, 1, 3]
    assert order("bookend") == [1, 3, 0, 2, 1, 3]
    assert order("difficulty") == [0, 1, 2, 3]
    assert sorted(order("random")) == [0, 1, 2, 3]


def test_batches(spark):
    r = rows(spark, 10, length=F.col("id") * 20)
    out = rel.batches(r, 4, most=100)
    assert out.count() == 8
    assert {x["batch"]: x["padded"] for x in out.collect()} == {0: 65, 1: 100}
    with pytest.raises(ValueError, match="no batch"):
        rel.batches(r, 11)


def test_balance_uses_least_group(spark):
    r = spark.createDataFrame([(i, s, float(i)) for i, s in enumerate([1, 1, 1, 2, 2, None])], "seq long, stage int, score_delta double").withColumn("total_delta", F.lit(None).cast("double"))
    assert sorted(x["seq"] for x in rel.balance(r).collect()) == [2, 4, 5]


def test_stratified_and_exact_samples(spark):
    r = rows(spark, 50, op=F.col("id") % 3)
    assert rel.stratified_sample(r, "op", 20, "s").where("chosen").count() == 20
    assert rel.sample(r, 7, "s").count() == 7


def test_pending_is_idempotent(spark):
    w = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "seq long, key string")
    first = rel.pending(w, w.where("key = 'b'"), "key")
    assert [x["seq"] for x in first.collect()] == [0]
    assert rel.pending(w, w, "key").count() == 0


def judged(spark):
    data = [("base", "x", "x"), ("base", "x", "TIE"), ("y", "base", "base"), ("y", "x", "x"), ("base", "x", "z")]
    return spark.createDataFrame(data, "config_a string, config_b string, winner string")


def test_win_rates_either_side(spark):
    got = {r["config"]: (r["wins"], r["losses"], r["ties"], r["total"]) for r in agg.win_rates(judged(spark), "base").collect()}
    assert got == {"x": (1, 0, 2, 3), "y": (0, 1, 0, 1)}
    loose = {r["config"]: r["total"] for r in agg.win_rates(judged(spark), "base", scope="config_b_only").collect()}
    assert loose == {"x": 4}


def test_correlation_without_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0)], "a double, b double, c double")
    r = agg.mean_abs_correlation(df, ["a", "b", "c"]).first()
    assert r["pairs"] == 1
    assert np.isclose(r["mean_abs_r"], abs(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]))


def test_intervals():
    low, high = statistics.parametric_interval(120, 200)
    assert (round(low, 3), round(high, 3)) == (0.53, 0.665)
    assert statistics.parametric_interval(0, 0) == (0.0, 0.0)
    low, high = statistics.resampled_interval(np.repeat([1, 0], [120, 80]))
    assert abs(low - 0.53) < 0.015
    assert abs(high - 0.67) < 0.015


def test_exact_intervals():
    ks = np.arange(-1, 58)
    terms = np.array([math.comb(57, k) * 0.2**k * 0.8 ** (57 - k) for k in range(58)])
    assert np.allclose(statistics.binomial_cdf(ks, 57, 0.2), np.concatenate([[0], np.cumsum(terms)]), atol=1e-12)
    low, high = statistics.exact_interval([120, 0, 5, 0], [200, 0, 5, 7])
    assert (low.round(3).tolist(), high.round(3).tolist()) == ([0.53, 0, 1, 0], [0.665, 0, 1, 0])
    low, high = statistics.exact_interval([6 * 10**8], [10**9])
    assert abs((high[0] - low[0]) / (2 * 1.959964 * (0.24 / 1e9) ** 0.5) - 1) < 1e-3


def test_except_rows_keeps_and_drops_repeats(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None), ("c", 2), ("c", 2)], "x string, y int")
    right = spark.createDataFrame([("a", 1), ("b", None)], "x string, y int")
    assert [tuple(r) for r in rel.except_rows(left, right).collect()] == [("c", 2), ("c", 2)]


def test_verdicts(spark):
    def v(m, c, r, ms, cs):
        df = spark.createDataFrame([("m", m, ms), ("c", c, cs), ("r", r, False)], "config string, win_rate double, significant boolean")
        return statistics.verdict(df, "m", "c", "r").first()["verdict"]

    assert v(0.8, 0.6, 0.5, True, False) == "PROVEN"
    assert v(0.62, 0.6, 0.5, True, False) == "PARTIALLY PROVEN"
    assert v(0.6, 0.7, 0.5, False, True) == "PARTIALLY PROVEN"
    assert v(0.5, 0.4, 0.6, False, False) == "DISPROVEN"


GRAPH = "graph string, seq long, extraction struct<entities:array<struct<name:string,dravya:string,guna:array<string>,karma:array<string>,samanya:array<string>,vishesha:array<string>,samavaya:array<string>,abhava:array<string>>>,global_abhava:array<string>>"


def test_graph(spark):
    e = lambda name, guna, cats, gaps: (name, "k", guna, [], cats, [], [], gaps)
    data = [("g", 0, ([e("A", ["old"], ["c"], ["x"]), e("B", ["p"], ["c"], [])], ["all"])), ("g", 1, ([e("A", ["new"], ["c"], ["y"])], [])), ("g", 2, None), ("empty", 0, ([], ["only"]))]
    x = spark.createDataFrame(data, GRAPH)
    found = graph.entities(x)
    assert [(r["name"], r["properties"]) for r in graph.nodes(found).orderBy("seq").collect()] == [("A", ["new"]), ("B", ["p"])]
    assert graph.category_index(found).first()["names"] == ["A", "B", "A"]
    got = {(r["graph"], r["query_type"]): r["context"] for r in graph.retrieve(found, x).collect()}
    assert got["g", "constraint"] == "## Entities\n- **A** (k)\n- **B** (k)\n\n## Absences & Constraints\n- [A] x\n- all\n- [A] y\n\n## Properties\n- **A**: new\n- **B**: p"
    assert got["g", "discrimination"].endswith("## Categories\n- **c**: A, B, A")
    assert got["empty", "general"] == "No knowledge extracted."


def test_external(spark):
    w = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "seq long, key string")
    done = external.resume(w, w.where("key = 'a'"), "key", "key", external.DeterministicProvider)
    assert [r["key"] for r in done.collect()] == ["b"]
    assert external.resume(w, done.select("key").union(w.where("key = 'a'").select("key")), "key", "key", external.DeterministicProvider).count() == 0
    calls = []

    def fail():
        calls.append(1)
        raise RuntimeError

    assert external.with_retries(fail, sleep=lambda _: None) is None
    assert len(calls) == 3
    one = external.answer(w, "key", external.DeterministicProvider, as_json=True).first()
    assert json.loads(one["answer"])["winner"] in "AB="


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"query": "a"}\n\n{"query": "é"}\n')
    df = files.json_lines(spark, str(tmp_path / "x.jsonl"), files.QUESTION)
    assert [r["query"] for r in df.orderBy("seq").collect()] == ["a", "é"]
    assert files.json_lines(spark, str(tmp_path / "none"), files.QUESTION).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"query": \n')
    with pytest.raises(Exception, match="MALFORMED"):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), files.QUESTION).collect()
    (tmp_path / "a.json").write_text('["x", "y"]')
    assert [r["query"] for r in files.string_array(spark, str(tmp_path / "a.json")).collect()] == ["x", "y"]
    assert files.settings("# c\nA = 1=2\n\nB=x") == {"A": "1=2", "B": "x"}
    files.write_train_valid(rel.systematic_split(rows(spark, 10, text=F.lit("t")), F.col("seq")), str(tmp_path / "out"), "text", "pos")
    assert spark.read.json(str(tmp_path / "out/train")).count() == 9
    p = files.paragraphs(spark.createDataFrame([("a" * 60 + "\n" + "b" * 60 + "\n\nshort",)], "value string"))
    assert [r["passage"] for r in p.collect()] == ["a" * 60 + " " + "b" * 60]


def test_stream_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq long, key string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        resume.run_once(spark, src, schema, "key", lambda b: b, out, mark)
        assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(4, "c")], "seq long, key string").write.mode("append").parquet(src)
    resume.run_once(spark, src, schema, "key", lambda b: b, out, mark)
    assert spark.read.parquet(out).count() == 3


def test_stream_of_pending_keys(spark, tmp_path):
    """First rows by key over restarts, late rows, missing keys and times, and a key that comes back after the delay."""
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    schema = "seq long, key string, ts timestamp, other string"
    done = spark.createDataFrame([("d",), ("d",), (None,)], "key string")

    def deliver(*values):
        frame = [(seq, key, None if day is None else datetime(2024, 1, 1) + timedelta(days=day), "x") for seq, key, day in values]
        spark.createDataFrame(frame, schema).repartition(3).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        resume.write_batches(resume.pending(stream, done, "key", "seq", "ts", "2 days"), out, mark, "update")
        return sorted(r["seq"] for r in spark.read.parquet(out).select("seq").collect())

    assert deliver((3, "a", 0), (1, "a", 0), (2, "d", 0), (4, "b", 1), (5, None, 1), (6, "n", None), (15, "n", 0)) == [1, 4, 5, 6]
    assert deliver((7, "a", 1), (8, None, 1), (9, "n", None), (10, "c", 5)) == [1, 4, 5, 6, 10]
    # Behind the watermark (day 3): dropped.  Day 6: a, whose last row is behind it, is new again.
    assert deliver((11, "z", 1), (12, "a", 6), (13, "n", 6), (14, "c", 6)) == [1, 4, 5, 6, 10, 12]
    assert deliver() == [1, 4, 5, 6, 10, 12]


def test_replayed_batch_is_written_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    rows = spark.createDataFrame([("base", "m", "m"), ("base", "m", "TIE"), ("m", "base", "base")], "config_a string, config_b string, winner string")
    rows.write.parquet(src)

    def stop(_):
        raise RuntimeError("stop")

    stream = lambda: resume.running_wins(spark.readStream.schema(rows.schema).parquet(src), "base")
    with pytest.raises(StreamingQueryException):
        resume.write_batches(stream(), out, mark, "update", stop)
    for _ in range(2):
        resume.write_batches(stream(), out, mark, "update")
    assert [tuple(r) for r in resume.latest(spark.read.parquet(out), "config").select("wins", "losses", "ties", "total").collect()] == [(1, 1, 1, 3)]


@pytest.mark.parametrize("split", [60, 500, 100_000])
def test_paragraphs_over_splits(spark, tmp_path, split):
    rng, want = random.Random(split), []
    for f in range(3):
        lines = [rng.choice(["", "  ", " é word", "w " * rng.randint(1, 30), "x"]) for _ in range(40)]
        (tmp_path / f"{f}.txt").write_text("\n".join(lines))
        blocks, block = [], []
        for line in [*lines, ""]:
            if line.strip():
                block.append(line.strip())
            elif block:
                blocks.append(" ".join(block))
                block = []
        want += [b for b in blocks if len(b) > 10]
    (tmp_path / "3.txt").write_text("")
    s = spark.newSession()
    s.conf.set("spark.sql.files.maxPartitionBytes", split)
    s.conf.set("spark.sql.files.openCostInBytes", 0)
    out = files.file_paragraphs(s, str(tmp_path), 10).orderBy("file", "block", "part")
    assert [r["passage"] for r in out.collect()] == want


def test_seq_of_files_and_registries(spark, tmp_path):
    """Unique, in order of the registry, then of file names, then of lines; larger files and wildcards too."""
    for folder, names in (("one", ("b", "a")), ("two", ("c",))):
        (tmp_path / folder).mkdir()
        for name in names:
            n = 2 if name == "a" else 200
            (tmp_path / folder / f"{name}.json").write_text("".join(f'{{"query": "{name}{i}"}}\n' for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        got = [r["query"] for r in files.json_lines(spark, str(tmp_path / "one/*.json"), "query string").orderBy("seq").collect()]
        assert got == [f"a{i}" for i in range(2)] + [f"b{i}" for i in range(200)]
        registry = [{"path": str(tmp_path / p), "kind": p, "source": p, "source_model": "m"} for p in ("two", "one")]
        both = files.labelled_union(spark, registry, "query string").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["query"] for r in both] == [f"c{i}" for i in range(200)] + got
    assert len({r["seq"] for r in both}) == 402
    assert files.labelled_union(spark, registry, "query string", set()).count() == 0


def test_ranks_and_totals_in_skewed_groups(spark):
    df = rows(spark, 300).withColumns({"g": F.when(F.col("seq") % 10 < 9, "big").otherwise("small"), "v": F.col("seq") % 4})
    got = rel.ranked(df, "g", F.col("seq"), totals={"t": F.col("v")}).orderBy("seq").collect()
    seen, total = {}, {}
    for r in got:
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        total[r["g"]] = total.get(r["g"], 0) + r["v"]
        assert (r["rank"], r["t"]) == (seen[r["g"]], total[r["g"]])


def test_stage_outside_the_table_fails(spark):
    stages = spark.createDataFrame([(i, "x") for i in range(1, 6)], "stage int, name string")
    with pytest.raises(Exception, match="no stage from 1 to 5"):
        rel.stage_lookup(spark.createDataFrame([(6,)], "stage int"), stages).collect()


def test_samples_are_no_single_task(spark):
    df = rows(spark, 100)
    for out in (rel.sample(df, 30, "s"), rel.group_split(df, "seq", 0.1, "s"), rel.stratified_sample(df, "seq", 30, "s")):
        assert "TakeOrderedAndProject" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("stages", "fails"), [([1, None, 2, None], False), ([None, None, 1], True), ([None], True), ([], False)])
def test_rows_without_a_stage(spark, stages, fails):
    df = spark.createDataFrame([(s,) for s in stages], "stage int")
    if fails:
        with pytest.raises(ValueError, match="have no stage"):
            rel.require_stage(df)
    else:
        assert rel.require_stage(df).count() == len(stages)


def test_report_of_a_comparison(spark):
    rates = statistics.with_intervals(spark.createDataFrame([("b", 120, 200, 0.6), ("a", 0, 0, 0.0)], "config string, wins long, total long, win_rate double"))
    lines = files.report(rates).split("\n")
    assert lines[2].split() == ["a", "N/A"]
    assert lines[3].split()[:3] == ["b", "60%", "[53-66%]"]
