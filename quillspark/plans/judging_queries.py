"""Judges with the deterministic provider, statistics by their bounds, joins and statuses with every branch in the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons
from ..functions import scoring, text
from ..operators import aggregates as agg
from ..operators import external, graph, judges, statistics
from ..operators import relational as rel
from .derived import cte, judgments, responses, scored_pairs, table
from .registry import query

STUB = external.provider("deterministic")
OTHER = external.provider("deterministic", "second")


def _byte(h: str, i: int) -> str:
    return f"('0x' || substring({h}, {2 * i + 1}, 2))::BIGINT"


def _scores(h: str, at: int, n: int) -> str:
    return "(" + " + ".join(f"1 + {_byte(h, at + i)} % 5" for i in range(n)) + ")::DOUBLE"


def _pairs(spark, d):
    """Pairs of responses to each question: the base on one side, the method on the other."""
    r = responses(spark, d).select("query_id", "arm", "response")
    a, b = (r.where(F.col("arm") == arm).select("query_id", F.col("arm").alias(f"config_{s}"), F.coalesce("response", F.lit("")).alias(f"response_{s}")) for arm, s in (("base", "a"), ("method", "b")))
    return a.join(b, "query_id").withColumns({"key": F.concat(F.lit("k"), "query_id"), "query": F.concat(F.lit("q"), "query_id")})


def _pairwise_sql(name: str, header: str = "") -> str:
    return (
        cte().rstrip()
        + f""", p AS (SELECT a.query_id, coalesce(a.response, '') AS ra, coalesce(b.response, '') AS rb, ('0x' || substring(md5('judge|k' || a.query_id), 1, 1))::BIGINT % 2 = 1 AS f
  FROM responses a JOIN responses b ON a.query_id = b.query_id AND a.arm = 'base' AND b.arm = 'method'),
  h AS (SELECT query_id, f, md5('{name}|{header}Question:' || chr(10) || 'q' || query_id || chr(10) || chr(10) || 'Response A:' || chr(10) || CASE WHEN f THEN rb ELSE ra END || chr(10) || chr(10) || 'Response B:' || chr(10) || CASE WHEN f THEN ra ELSE rb END) AS h FROM p)
  SELECT query_id, CASE WHEN {_byte('h', 0)} % 3 = 2 THEN 'TIE' WHEN ({_byte('h', 0)} % 3 = 0) <> f THEN 'base' ELSE 'method' END AS winner,
    CASE WHEN f THEN {_scores('h', 6, 5)} ELSE {_scores('h', 1, 5)} END AS total_a, CASE WHEN f THEN {_scores('h', 1, 5)} ELSE {_scores('h', 6, 5)} END AS total_b FROM h"""
    )


def _judged(rows):
    return rows.select("query_id", "winner", scoring.score_sum(F.col("scores_a")).alias("total_a"), scoring.score_sum(F.col("scores_b")).alias("total_b"))


@query(_pairwise_sql("stub"))
def judge_pairwise(spark, d):
    return _judged(judges.pairwise(_pairs(spark, d), STUB))


@query(_pairwise_sql("second"))
def judge_second_family(spark, d):
    return _judged(judges.pairwise(_pairs(spark, d), OTHER))


@query(_pairwise_sql("stub", "Both responses may use a given context; using it is no fault.' || chr(10) || chr(10) || '"))
def judge_context_aware(spark, d):
    return _judged(judges.context_aware(_pairs(spark, d), STUB))


def _items(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.concat(F.lit("q"), "item_id").alias("query"), F.col("text").alias("response"))


FACT = "md5('stub|Question: q' || item_id || chr(10) || chr(10) || 'Check the facts of this response:' || chr(10) || text)"


@query(f"SELECT item_id, {_byte('h', 11)} % 10 AS claims_checked, least({_byte('h', 11)} % 10, {_byte('h', 12)} % 10) AS claims_accurate FROM (SELECT item_id, {FACT} AS h FROM benchmark)")
def judge_factual(spark, d):
    return judges.factual(_items(spark, d), STUB).select("item_id", "claims_checked", "claims_accurate")


TOOLS = "md5('stub|Question: q' || item_id || chr(10) || chr(10) || 'Searches:' || chr(10) || 'Search 1: ' || item_id || ' -> N/A' || chr(10) || chr(10) || 'Final response:' || chr(10) || substring(text, 1, 2000))"


@query(f"SELECT item_id, 1 + {_byte('h', 13)} % 5 AS overall_tool_value FROM (SELECT item_id, {TOOLS} AS h FROM benchmark)")
def judge_tool_use(spark, d):
    calls = F.array(F.struct(F.col("item_id").cast("string").alias("query"), F.lit(None).cast("string").alias("result")))
    return judges.tool_use(_items(spark, d).withColumn("tool_calls", calls), STUB).select("item_id", "overall_tool_value")


FACETS = f"md5('stub|Rate by {', '.join(lexicons.FACET_DIMENSIONS)}.' || chr(10) || chr(10) || 'Question: q' || item_id || chr(10) || chr(10) || 'Response:' || chr(10) || text)"


@query(f"SELECT item_id, 'seven' AS framework, {_scores('h', 1, 7)} AS total, 7::BIGINT AS dims FROM (SELECT item_id, {FACETS} AS h FROM benchmark)")
def judge_pointwise(spark, d):
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x)
    return judges.pointwise(_items(spark, d), STUB, lexicons.FACET_DIMENSIONS, "seven").select("item_id", "framework", total.alias("total"), F.size("scores").cast("long").alias("dims"))


EXTRACTION = "struct<entities:array<struct<name:string,dravya:string,guna:array<string>,karma:array<string>,samanya:array<string>,vishesha:array<string>,samavaya:array<string>,abhava:array<string>>>,global_abhava:array<string>>"


@query(f"SELECT 'g' || (item_id % 2) AS graph, 'e' || ({_byte('h', 0)} % 4) AS name, 'p' || arg_max({_byte('h', 1)} % 7, item_id) AS property, min(item_id) * 1000000 AS seq FROM (SELECT item_id, md5('stub|Extract knowledge from:' || chr(10) || chr(10) || substring(text, 1, 4000)) AS h FROM benchmark) GROUP BY 1, 2")
def facet_extraction(spark, d):
    """Entities extracted from texts, upserted into a graph for each corpus."""
    docs = table(spark, d, "benchmark").select(F.concat(F.lit("g"), F.col("item_id") % 2).alias("graph"), F.col("item_id").alias("seq"), "text")
    found = judges.extract(docs, STUB, EXTRACTION)
    return graph.nodes(graph.entities(found)).select("graph", "name", F.get("properties", F.lit(0)).alias("property"), "seq")


@query("SELECT count(*)::BIGINT AS n, 0::BIGINT AS extracted, count(*)::BIGINT AS unchanged FROM benchmark")
def failing_provider(spark, d):
    """Without answers nothing is extracted, texts stay as they are, and no judgment is made."""
    never = external.provider("failing")
    rows = judges.rewritten(judges.extract(table(spark, d, "benchmark"), never, EXTRACTION), "text", never, "Rewrite:")
    judged = judges.pairwise(_pairs(spark, d), never).agg(F.count("*").alias("j"))
    one = rows.agg(F.count("*").alias("n"), F.count("extraction").alias("extracted"), F.count_if(F.col("rewritten") == F.col("text")).alias("unchanged"))
    return one.crossJoin(F.broadcast(judged)).select("n", (F.col("extracted") + F.col("j")).alias("extracted"), "unchanged")


def _answer_sql(prompt: str) -> str:
    return f"'answer ' || substring(md5('stub|' || {prompt}), 1, 8) || ' of ' || len(regexp_extract_all({prompt}, '[^ \\t\\n\\x0b\\f\\r\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+')) || ' words'"


@query(f"SELECT item_id, {_answer_sql("('Tag the claims:' || chr(10) || chr(10) || text)")} AS tagged, {_answer_sql("(CASE WHEN item_id % 2 = 0 THEN 'Stages: one, two' ELSE '' END || chr(10) || text)")} AS synthesis FROM benchmark")
def tagged_and_synthesized(spark, d):
    rows = judges.rewritten(table(spark, d, "benchmark"), "text", STUB, "Tag the claims:", "tagged")
    stages = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>"))
    return judges.synthesized(rows, "text", stages, STUB).select("item_id", "tagged", "synthesis")


EVIDENCE = "md5('stub|Does this need a search?' || chr(10) || text)"


@query(f"SELECT item_id, {_byte('h', 14)} % 2 = 1 OR ({_byte('h', 15)} % 10) / 10 < 0.6 AS searches FROM (SELECT item_id, {EVIDENCE} AS h FROM benchmark)")
def evidence_router(spark, d):
    rows = judges.evidence(table(spark, d, "benchmark"), "text", STUB)
    return rows.select("item_id", text.routing_decision(F.lit(None).cast("boolean"), F.col("needs"), F.col("confidence"), F.col("failed")).alias("searches"))


# --- statistics


def _bounds_sql(rows: str, keys: str, alpha: float = 0.05) -> str:
    """Quantiles of binomial distributions by summing their terms; ``rows`` has the keys, wins and total."""
    term = "CASE WHEN wins IN (0, total) THEN (k = wins)::DOUBLE ELSE exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) + k * ln(wins / total::DOUBLE) + (total - k) * ln(1 - wins / total::DOUBLE)) END"
    at = lambda q: f"min(k) FILTER (WHERE cdf >= {q}) / total::DOUBLE"
    return f"SELECT {keys}, wins, total, round({at(alpha / 2)}, 9) AS low, round({at(1 - alpha / 2)}, 9) AS high FROM (SELECT *, sum({term}) OVER (PARTITION BY {keys} ORDER BY k) AS cdf FROM (SELECT *, unnest(range(total + 1)) AS k FROM ({rows}))) GROUP BY {keys}, wins, total"


WINS = "SELECT config_b AS config, count(*) FILTER (WHERE winner = config_b)::BIGINT AS wins, count(*)::BIGINT AS total FROM judgments GROUP BY 1"


@query(cte() + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS alpha, * FROM ({_bounds_sql(WINS, 'config', x)})" for x in (0.1, 0.01)))
def bootstrap_bounds(spark, d):
    """Intervals of two levels."""
    rates = agg.win_rates(judgments(spark, d), "base", scope="config_b_only").select("config", "wins", "total")
    at = lambda x: rates.withColumn("i", statistics.interval(F.col("wins"), F.col("total"), x)).select(F.lit(x).alias("alpha"), "config", "wins", "total", F.round("i.low", 9).alias("low"), F.round("i.high", 9).alias("high"))
    return at(0.1).unionByName(at(0.01))


@query(_bounds_sql("SELECT lang, sum(quality)::BIGINT AS wins, count(quality)::BIGINT AS total FROM labels JOIN documents USING (doc_id) GROUP BY 1", "lang"))
def resampled_interval(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return statistics.resampled(rows, "lang", "quality").withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query("SELECT n, label, rate_text, verdict, replication FROM (VALUES (0, 'negligible', 'N/A', 'DISPROVEN', 'NOT CONFIRMED'), (10, 'small', '60% [50-70%]', 'PROVEN', 'PARTIAL'), (20, 'large', '62% [52-72%]', 'PARTIALLY PROVEN', 'CONFIRMED')) t(n, label, rate_text, verdict, replication)")
def labels_and_verdicts(spark, d):
    rows = spark.createDataFrame([(0, 0.0, 0.1, 0.5, 0.6, 0.5, False, 0), (10, 0.6, -0.3, 0.8, 0.7, 0.6, True, 1), (20, 0.625, 1.1, 0.62, 0.6, 0.5, True, 2)], "n int, p double, h double, best double, control double, random double, sig boolean, k int")
    c = F.col
    return rows.select("n", scoring.effect_label(c("h")).alias("label"), scoring.win_rate_text(c("n"), c("p"), c("p") - 0.1, c("p") + 0.1).alias("rate_text"), scoring.verdict(c("best"), c("control"), c("random"), c("sig"), F.lit(False)).alias("verdict"), scoring.replication_verdict(c("k")).alias("replication"))


SUMS = "SELECT 1 AS ord, 'five' AS framework, list_sum(sb) AS s FROM judgments UNION ALL SELECT 2, 'first two', sb[1] + sb[2] FROM judgments UNION ALL SELECT 3, 'copy', list_sum(sb) FROM judgments"


@query(cte() + f"SELECT framework, count(*)::BIGINT AS n, round(var_pop(s), 6) AS variance, framework = 'five' AS most_discriminating FROM ({SUMS}) GROUP BY framework")
def framework_variance(spark, d):
    """Three frameworks, two of them equal: the first one wins the tie."""
    b = judgments(spark, d).select(F.col("scores_b").alias("scores"))
    two = b.select(F.map_filter("scores", lambda k, _: k.isin(lexicons.DIMENSIONS[:2])).alias("scores"))
    return agg.overall_variance({"five": b, "first two": two, "copy": b}).withColumn("variance", F.round("variance", 6))


@query(cte() + "SELECT least(config_a, config_b) AS first, greatest(config_a, config_b) AS second, count(*) FILTER (WHERE winner = least(config_a, config_b))::BIGINT AS first_wins, count(*) FILTER (WHERE winner = greatest(config_a, config_b))::BIGINT AS second_wins, count(*) FILTER (WHERE winner = 'TIE')::BIGINT AS ties FROM judgments GROUP BY 1, 2")
def placebo_comparison(spark, d):
    return agg.pair_wins(judgments(spark, d))


@query("SELECT category, ord::INTEGER AS ord, (SELECT count(*) FROM documents WHERE coalesce(lang, 'unclassified') = category)::BIGINT AS docs FROM (VALUES ('en', 0), ('none of these', 1), ('de', 2), ('unclassified', 3)) t(category, ord)")
def category_groups(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("unclassified")).alias("category"))
    return agg.category_counts(docs, ["en", "none of these", "de"])


# --- joins


@query("SELECT doc_id, coalesce(l.quality, -1)::INTEGER AS quality FROM documents LEFT JOIN labels l USING (doc_id)")
def join_with_defaults(spark, d):
    return rel.with_defaults(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id", {"quality": -1})


@query("SELECT lang, n.doc_id AS first_doc FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l JOIN (SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY 1) n USING (lang)")
def join_first_match(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    return rel.first_match(docs.select("lang").distinct(), docs.select("lang", F.col("doc_id").alias("first_doc"), F.col("doc_id").alias("seq")), "lang")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_having(spark, d):
    return rel.having(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("WITH l AS (SELECT lang, doc_id % 5 AS k FROM documents) SELECT lang, k FROM l WHERE NOT EXISTS (SELECT 1 FROM documents r WHERE r.doc_id < 40 AND r.doc_id % 3 = 0 AND r.lang IS NOT DISTINCT FROM l.lang AND r.doc_id % 5 = l.k) UNION ALL SELECT lang, doc_id FROM documents WHERE doc_id % 3 <> 0")
def join_except(spark, d):
    """Rows that repeat, and rows that don't."""
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "lang", (F.col("doc_id") % 5).alias("k"))
    several = rel.except_rows(rows.select("lang", "k"), rows.where("doc_id < 40 and doc_id % 3 = 0").select("lang", "k"))
    single = docs.select("lang", F.col("doc_id").alias("k"))
    return several.unionByName(rel.except_rows(single, single.where("k % 3 = 0")))


@query("""WITH f AS (SELECT lang, substring(text, 1, 300) AS content, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, row_number() OVER (ORDER BY doc_id) AS g, doc_id FROM documents WHERE text IS NOT NULL),
  c AS (SELECT lang AS domain, string_agg(content, chr(10) || chr(10) ORDER BY doc_id) AS t FROM f WHERE r <= 151 GROUP BY 1), dflt AS (SELECT string_agg(content, chr(10) || chr(10) ORDER BY doc_id) AS t FROM f WHERE g <= 2)
  SELECT domain, substring(coalesce(c.t, (SELECT t FROM dflt)), 1, 300) AS context FROM (VALUES ('en'), ('de'), ('nowhere')) q(domain) LEFT JOIN c USING (domain)""")
def question_context(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("lang").alias("doc_type"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    return rel.context_or_default(spark.createDataFrame([("en",), ("de",), ("nowhere",)], "domain string"), docs, 300).select("domain", "context")


@query(cte() + "SELECT count(*)::BIGINT AS n FROM pairs")
def stages_present(spark, d):
    return rel.require_stage(scored_pairs(spark, d)).agg(F.count("*").alias("n"))


@query(cte() + "SELECT arm, round(avg(coalesce(CASE WHEN seq % 3 <> 0 THEN n_chars END, 0)), 6) AS n_chars, round(avg(coalesce(seq, 0)), 6) AS seq FROM responses GROUP BY 1")
def metric_means(spark, d):
    rows = responses(spark, d).select("arm", F.when(F.col("seq") % 3 != 0, F.col("n_chars")).alias("n_chars"), "seq")
    return agg.metric_means(rows, ["n_chars", "seq"]).withColumns({c: F.round(c, 6) for c in ("n_chars", "seq")})


# --- every status of an extraction, every split of a comparison


def _mixed(spark, d):
    """Judgments of which some lack a response, and some name an arm that was not judged."""
    j = judgments(spark, d)
    winner = F.when(F.col("seq") % 11 == 0, "elsewhere").otherwise(F.col("winner"))
    return j.withColumns({"total_delta": F.abs(scoring.score_sum(F.col("scores_b")) - scoring.score_sum(F.col("scores_a"))), "winner": winner})


LEFT = "SELECT * FROM responses WHERE seq % 13 <> 0"


@query(cte() + f"SELECT CASE WHEN w = 'TIE' THEN 'tie' WHEN w NOT IN (config_a, config_b) THEN 'mismatched' WHEN coalesce(x.response, '') = '' OR coalesce(y.response, '') = '' THEN 'missing' WHEN abs(list_sum(sb) - list_sum(sa)) < 3 THEN 'weak' ELSE 'kept' END AS status, count(*)::BIGINT AS n FROM (SELECT *, CASE WHEN seq % 11 = 0 THEN 'elsewhere' ELSE winner END AS w FROM judgments) j LEFT JOIN ({LEFT}) x ON x.query_id = j.query_id AND x.arm = j.config_a LEFT JOIN ({LEFT}) y ON y.query_id = j.query_id AND y.arm = j.config_b GROUP BY 1")
def extraction_statuses(spark, d):
    r = responses(spark, d).where("seq % 13 <> 0")
    return rel.extraction_status(_mixed(spark, d), r, 3.0).groupBy("status").agg(F.count("*").alias("n"))
