"""Branch merge, conversation repair and URL filter on small tables, against plain code."""

import hashlib
import math
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from quillspark.llm import branch_merge as B
from quillspark.llm import conversation_repair as C
from quillspark.llm import url_filter as U

DOCS = "doc_id long, text string, lang string, source string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Branch merge.


def brute_merge(docs):
    """Rows as the query returns them, for documents of distinct ids."""
    code = lambda b, k, name: zlib.crc32(f"{b}:{k}:{name}".encode()) % 7
    out = []
    for doc_id, *values in docs:
        text, *columns = ("" if v is None else v for v in values)
        k = "" if doc_id is None else doc_id
        lines = text.split("\n")

        def edits(b, k=k, columns=columns, lines=lines):
            e = {}
            for name, v in zip(("lang", "source"), columns, strict=True):
                new = {0: "", 1: v + "!", 2: v + "?"}.get(code(b, k, name), v)
                if new != v:
                    e[name] = new
            for i, v in enumerate(lines):
                c = code(b, k, i)
                if c < 3:
                    e["line", i] = {0: None, 1: v + "!", 2: v + "?"}[c]
                elif c < 5:
                    e["gap", i] = "!" if c == 3 else "?"
            return e

        def state(e, columns=columns, lines=lines):
            t = []
            for i, v in enumerate(lines):
                t += [x for x in (e.get(("line", i), v), e.get(("gap", i))) if x is not None]
            return e.get("lang", columns[0]), e.get("source", columns[1]), sha("\n".join(t))

        left, right = edits("L"), edits("R")
        rl, rr = code("L", k, "row"), code("R", k, "row")
        if rl == 0 or rr == 0:
            against = (rl == 0 and rr != 0 and right != {}) or (rr == 0 and rl != 0 and left != {})
            kept = state(right) if against and rr != 0 else (None, None, None)
            out.append((doc_id, *kept, int(not against), 0, int(against), 0))
        else:
            n = [0, 0, 0, 0]
            for u in {**left, **right}:
                if u not in left or u not in right or left[u] == right[u]:
                    n[0] += 1
                elif u[0] == "gap":
                    n[3] += 1
                elif None in (left[u], right[u]):
                    n[2] += 1
                else:
                    n[1] += 1
            out.append((doc_id, *state(left | right), *n))
        if rl in (3, 4) or rr in (3, 4):
            c = rr if rr in (3, 4) else rl
            conflict = rl in (3, 4) and rr in (3, 4) and rl != rr
            out.append((None if doc_id is None else -1 - doc_id, *columns, sha("!" if c == 3 else "?"), int(not conflict), 0, 0, int(conflict)))
    return out


def merged(spark, docs, tmp_path):
    spark.createDataFrame(docs, DOCS).withColumn("doc", F.lit("clash")).withColumn("kind", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    return B.query(spark, str(tmp_path))


def test_branches_by_brute_force(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: "\n".join(rng.choice(["", "a", "b c", "\x85ü", "!"]) for _ in range(rng.randrange(1, 9)))
    pick = lambda *x: rng.choice(x)
    docs = [(i, pick(None, "", text(), text(), text()), pick(None, "", "en"), pick(None, "", "s")) for i in range(400)]
    docs += [(None, "x\ny", None, "s"), (1 << 40, "\n" * 3000 + "end", "en", "s")]
    got = [tuple(r) for r in merged(spark, docs, tmp_path).select("doc_id", "lang", "source", "text_sha256", *(f"n_{c}" for c in B.COUNTS)).collect()]
    assert sorted(got, key=repr) == sorted(brute_merge(docs), key=repr)
    assert all(sum(r[i] for r in got) for i in range(4, 8))


def test_branches_without_documents(spark, tmp_path):
    assert merged(spark, [], tmp_path).count() == 0


def test_an_id_that_repeats_is_one_document(spark, tmp_path):
    docs = [(5, "b", "en", "s"), (5, "a\nz", "en", "s"), (5, "a\nz", "en", "s")]
    got = [tuple(r) for r in merged(spark, docs, tmp_path).select("doc_id", "lang", "source", "text_sha256", *(f"n_{c}" for c in B.COUNTS)).collect()]
    assert sorted(got, key=repr) == sorted(brute_merge([(5, "a\nz", "en", "s")]), key=repr)


def test_branches_of_given_logs(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "en", "s"), (2, "x", "en", "s"), (3, "y", "de", "t")], DOCS)
    state = lambda op, *v: (op, *v, *[None] * (3 - len(v)))
    left = [("1", "line", 0, state("drop")), ("1", "gap", 1, state("insert", "n\nm")), ("2", "row", 0, state("drop")), ("9", "added", 0, state("add", "t", "en", "s")), ("1", "line", 7, state("drop"))]
    right = [("1", "line", 0, state("append", "!")), ("1", "gap", 1, state("insert", "o")), ("1", "lang", 0, state("set", "fr")), ("2", "line", 0, state("append", "?")), ("9", "added", 0, state("add", "t", "en", "u")), ("3", "row", 0, state("drop"))]
    out = B.merge(docs, spark.createDataFrame(left, B.LOG), spark.createDataFrame(right, B.LOG))
    assert {r["doc_id"]: tuple(r)[1:] for r in out.collect()} == {
        1: ("a!\nb\no\nc", "fr", "s", 2, 0, 1, 1),
        2: ("x?", "en", "s", 0, 0, 1, 0),
        3: (None, None, None, 1, 0, 0, 0),
        9: ("t", "en", "u", 0, 0, 0, 1),
    }


# Conversation repair.


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of a conversation's (turn, role, text), in any order, without nulls but for turns."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip("\x20\t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    nfa = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}

    @cache
    def best(i, q, inserted=0):
        found = [(0, "", ())] if i == len(rows) and q in "03" else []
        steps = []
        if i < len(rows):
            steps.append((2, "D", None, i + 1, q, 0))
            if faults[i] in ("", "truncated"):
                cut = 5 * (faults[i] == "truncated")
                if n := nfa.get((q, rows[i][1][:1])):
                    steps.append((cut, "K", rows[i][1:], i + 1, n, 0))
                for role in ("user", "assistant"):
                    if n := nfa.get((q, role[0])):
                        steps.append((cut + 1, "R", (role, rows[i][2]), i + 1, n, 0))
        if inserted < 4:
            for role in ("user", "assistant"):
                if n := nfa.get((q, role[0])):
                    steps.append((5, "I", (role, ""), i, n, inserted + 1))
        for cost, letter, row, j, n, k in steps:
            if after := best(j, n, k):
                found.append((cost + after[0], letter + after[1], ((row,) if row else ()) + after[2]))
        return min(found, default=None)

    cost, audit, repaired = best(0, "0")
    turns = {t for t, _, _ in rows} - {None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    n = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, [tuple(r) for r in repaired])


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["ok.", "a b", "", " \t\n", "why?", "no! \x0b", "é", "long text."]
    return [(rng.choice([None, *range(25)]), rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "sys"]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize(("long", "piece"), [(C.LONG, C.PIECE), (2, 3), (1, 1)])
def test_repair_by_brute_force(spark, long, piece):
    rows = conversations(piece, 220)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).repartition(3)
    got = {}
    for r in C.repair(df, long, piece).orderBy("part", "piece").collect():
        sums, audit, repaired = got.get(r["conv_id"], ([0] * 6, "", []))
        got[r["conv_id"]] = ([a + r[c] for a, c in zip(sums, C.COUNTS, strict=True)], audit + r["audit"], repaired + [tuple(x) for x in r["repaired"]])
    want = {c: brute_repair([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert {c: (*sums, audit, repaired) for c, (sums, audit, repaired) in got.items()} == want


def test_digests_of_pieces_are_those_of_whole_conversations(spark):
    df = spark.createDataFrame(conversations(9, 150), "conv_id long, turn long, role string, text string")
    one, other = (sorted((tuple(r) for r in C.digests(C.repair(df, *how)).collect()), key=repr) for how in ((C.LONG, C.PIECE), (2, 2)))
    assert one == other


def test_repair_of_nothing(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    assert C.digests(C.repair(spark.createDataFrame([], schema))).count() == 0
    dropped = next(t for t in range(99) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    spark.createDataFrame([(7, dropped, "user", "x."), (None, None, None, None)], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in C.query(spark, str(tmp_path)).collect()}
    assert got[7] == {"conv_id": 7, **dict.fromkeys(C.COUNTS, 0), "audit": "", "repaired_sha256": sha("")}
    assert set(got) == {7, None}


def test_one_very_long_conversation(spark):
    n = 9000
    df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('line ', id, if(id % 1000 = 1, '', '.')) as text")
    r = C.digests(C.repair(df)).collect()
    assert len(r) == 1
    assert (r[0]["truncated"], r[0]["illegal"], r[0]["cost"], len(r[0]["audit"])) == (9, 0, 36, n)


def test_automaton_is_small(spark):
    auto = C.Automaton()
    rng = random.Random(3)
    for _ in range(300):
        auto.audit([rng.randrange(12) for _ in range(40)])
    assert len(auto.vectors) < 200


# URL filter.

URLS = [
    None, "", "no scheme", "http://", "http://Net/", "http://a.NET/x", "http://net", "http://net?x=/", "http://xnet/", "http://www.example.net/en/1?a=b&c", "http://example.net/en",
    "http://example.com/de/1", "http://sub.example.com/de/", "http://example.com/DE/", "https://a.org/fr/2#x", "http://org/fr/", "a://b://net/", "x\n://net/\ny?", "http://net/" + "9" * 20000, "http://é.net/ü",
]


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    best = (None, None)
    for verdict, rule in U.RULES:
        of, rest = rule.split("/", 1)
        if (host == of or host.endswith("." + of)) and path.startswith("/" + rest) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return (host, path, *best)


def test_rules_by_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:6])], "page_id long, url string, host string")
    out = U.judge(df, U.fit(U.labelled_by(df))).collect()
    assert len(out) == len(URLS) + 6
    for r in out:
        host, path, rule, verdict = brute_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block")
        assert verdict in (None, r["verdict"])
        assert 0 <= r["score"] <= 1
    same = {}
    for r in out:
        assert same.setdefault(r["url"], r["score"]) == r["score"]


def test_entropy_and_counts(spark):
    df = spark.createDataFrame([("http://aab.c/x//12?p=1&q;r#z",), ("",), ("ééß",)], "u string")
    r = U.lexical(df.select("u"), "u").collect()
    chars = r[0]["u"]
    want = -sum(chars.count(c) / len(chars) * math.log2(chars.count(c) / len(chars)) for c in set(chars))
    assert r[0]["entropy"] == pytest.approx(want)
    assert (r[0]["depth"], r[0]["n_params"], r[0]["last_two"], r[0]["first_segment"], r[0]["n_host"]) == (2, 3, "aab.c", "x", 5)
    assert r[0]["digits"] == pytest.approx(3 / len(chars))
    assert (r[1]["entropy"], r[1]["digits"], r[2]["entropy"]) == (0, 0, 0)


def test_urls_without_labels_or_of_one_kind(spark):
    df = spark.createDataFrame([(1, "http://x.y/z"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in U.judge(df, U.fit(U.labelled_by(df))).collect()} == {"allow"}
    bad = spark.createDataFrame([(f"http://h{i}.x/", 1.0) for i in range(9)], "url string, label double")
    assert {r["verdict"] for r in U.judge(df, U.fit(bad)).collect()} == {"block"}
    assert U.judge(df.limit(0), U.fit(bad)).count() == 0


def test_trees_on_held_out_urls(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    good = [(f"https://{word(6)}.site{i % 7}.org/{word(5)}/{word(8)}", 0.0) for i in range(400)]
    bad = [(f"http://{word(4)}{rng.randrange(10**8)}.ads{i % 5}.biz/{rng.randrange(10**9)}/x?a={rng.randrange(10**9)}&b=2&c=3", 1.0) for i in range(400)]
    df = spark.createDataFrame(good + bad, "url string, label double")
    fold = F.crc32(F.col("url").cast("binary")) % 5 == 0
    out = U.judge(df.where(fold), U.fit(df.where(~fold)), rules=())
    right, n = out.agg(F.count_if((F.col("verdict") == "block") == (F.col("label") == 1)), F.count("*")).first()
    assert right >= 0.97 * n > 0
