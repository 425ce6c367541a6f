"""Text functions over texts that hold what the lexicons look for: every document's whole text, and behind it one of the fragments below, by its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons, scratch
from ..functions import json_text, scoring, templates, text
from ..operators import relational as rel
from .derived import cte, judgments, responses, table
from .registry import query

FRAGMENTS = [
    "[PRAMANA] seen. [SMRITI] [SMRITI] told. [UNKNOWN]\n1. First thing\n 2) Second thing",
    "For example, water. For instance: ice, such as snow. Like the cold of it in winter is the case of frost.",
    "According to a study by them, research shows it. A grounded example of a real-world example, a known case.",
    "I am not sure. This may not be so; it's unclear and tentative. Evidence remains mixed, roughly, to the best of my knowledge.",
    "PRATIJNA: fire.\nHETU: smoke.\n**UDAHARANA: kitchen.\n3. UPANAYA: so here.\nNIGAMANA: fire.\nStep one\nCLAIM: x\nConclusion y",
    "[VIKALPA][UNCERTAIN][LIKELY] i'm not confident, treat as tentative; could not find an example. More research.",
    "What is the latest price today? How many are there, and who was it?",
    "The methodology and reasoning of critical thinking lead to a framework.",
    "The definition refers to a classification; compare and contrast, whereas unlike others they differentiate.",
    "The cause drives it because a force results in a process, therefore a limit cannot prevent the threshold.",
    "An experiment measured the average and the median; a survey of statistics, for example a case study.",
    "An expert consensus, according to the authority, historically shows a trend over time.",
    "<think>hidden. thought</think> Open answer. Second one! Third? <think>never closed",
    "<think>only thought</think>",
    "Take a look at one example. Consider this example in the field of study from there.",
    "Nothing of note here at all.",
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pattern(p: str) -> str:
    return p.replace("'", "''")


MARKED = f"WITH m AS (SELECT doc_id, coalesce(text, '') || chr(10) || [{', '.join(map(_quoted, FRAGMENTS))}][doc_id % {len(FRAGMENTS)} + 1] AS t FROM documents)\n"


def marked(spark, d):
    fragment = F.element_at(F.array(*map(F.lit, FRAGMENTS)), (F.col("doc_id") % len(FRAGMENTS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), fragment).alias("t"))


def _n(p: str, of: str = "t") -> str:
    return f"len(regexp_extract_all({of}, '{_pattern(p)}'))"


def _sum(patterns: list[str]) -> str:
    return "(" + " + ".join(_n(p, "lower(t)") for p in patterns) + ")::BIGINT"


TAGS = {t: _n(rf"\[{t}\]") for t in lexicons.CLAIM_TAGS}


@query(MARKED + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS tag, ({n})::BIGINT AS n FROM m" for t, n in {**TAGS, "total": " + ".join(TAGS.values())}.items()) + ")")
def claim_tags(spark, d):
    return marked(spark, d).select("doc_id", F.explode(text.tag_counts(F.col("t"))).alias("tag", "n")).withColumn("n", F.col("n").cast("long"))


@query(MARKED + f"SELECT doc_id, {_sum(lexicons.EXAMPLE_MARKERS)} AS examples, {_sum(lexicons.GROUNDING_MARKERS)} AS grounding, {_sum(lexicons.HEDGES)} AS hedges, {_sum(lexicons.HEDGES_SHORT)} AS hedges_short FROM m")
def markers(spark, d):
    t = F.col("t")
    found = text.marker_counts(t, examples=lexicons.EXAMPLE_MARKERS, grounding=lexicons.GROUNDING_MARKERS, hedges=lexicons.HEDGES, hedges_short=lexicons.HEDGES_SHORT)
    return marked(spark, d).select("doc_id", *(c.cast("long").alias(k) for k, c in found.items()))


STEPS = [_n(rf"(?i)(?:^|\n)\s*(?:\d+\.?\s*)?(?:\*\*)?{s}") for s in lexicons.SYLLOGISM_STEPS]
REASONING = _n(r"(?m)^\s*\d+[.)]\s") + " + " + _n(rf"(?m)^\s*(?:{'|'.join(lexicons.STEP_LABELS)})[:\s]")


@query(MARKED + f"SELECT doc_id, ({REASONING})::BIGINT AS steps, ({STEPS[2]})::BIGINT AS udaharana, least({', '.join(STEPS)})::BIGINT AS complete FROM m")
def reasoning_structure(spark, d):
    s = text.syllogism(F.col("t"))
    return marked(spark, d).select("doc_id", text.reasoning_steps(F.col("t")).cast("long").alias("steps"), s["udaharana"].cast("long").alias("udaharana"), s["complete"].cast("long").alias("complete"))


WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
WORDS = rf"len(list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> ''))::BIGINT"
CLAIMS = rf"len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: length(regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')) > 20))::BIGINT"


@query(MARKED + f"SELECT doc_id, ({' + '.join(TAGS[t] for t in lexicons.CLAIM_TAGS_SHORT)})::BIGINT AS tags, {CLAIMS} AS claims, least({', '.join(STEPS)})::BIGINT AS complete, {_sum(lexicons.GROUNDING_MARKERS)} AS grounded, {_sum(lexicons.HEDGES_SHORT)} AS hedging, (doc_id % 3)::BIGINT AS searches, {WORDS} AS words FROM m")
def response_structure(spark, d):
    s = text.structure(F.col("t"), F.array_repeat(F.lit("q"), (F.col("doc_id") % 3).cast("int")))
    rows = marked(spark, d).withColumn("s", s)
    fields = {"tags": F.col("s.tags")["total"], "claims": F.col("s.claim_count"), "complete": F.col("s.steps.complete"), "grounded": F.col("s.grounded_examples"), "hedging": F.col("s.hedging_count"), "searches": F.col("s.total_searches"), "words": F.col("s.word_count")}
    return rows.select("doc_id", *(c.cast("long").alias(k) for k, c in fields.items()))


@query(MARKED + rf"SELECT doc_id, array_to_string(string_split(regexp_replace(t, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))[1:2], ' ') AS first_two, substring(t, 1, 20) AS start FROM m")
def sentences(spark, d):
    return marked(spark, d).select("doc_id", text.first_sentences(F.col("t"), 2).alias("first_two"), text.truncated(F.col("t"), 20).alias("start"))




def _stripped(s: str) -> str:
    return rf"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"


CLOSED = _stripped("regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')")
ALL = _stripped(rf"regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>{WS}*', '', 'g'), '(?s)<think>.*$', '', 'g')")


@query(MARKED + f"SELECT doc_id, {CLOSED} AS closed, CASE WHEN {ALL} = '' THEN t ELSE {ALL} END AS everything FROM m")
def without_thinking(spark, d):
    return marked(spark, d).select("doc_id", text.strip_thinking(F.col("t")).alias("closed"), text.strip_all_thinking(F.col("t")).alias("everything"))


LETTER = r"[^\p{L}\p{N}_]"


def _term(t: str) -> str:
    return f"contains(lower(t), {_quoted(t)})" if " " in t else rf"regexp_matches(lower(t), '(?:^|{LETTER}){t}(?:$|{LETTER})')"


HITS = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{c}' AS category, " + " + ".join(f"({_term(t)})::BIGINT" for t in terms) + " AS hits FROM m" for i, (c, terms) in enumerate(lexicons.CATEGORIES.items()))


@query(MARKED + f", h AS ({HITS}) SELECT doc_id, category, hits FROM h WHERE hits >= 2")
def knowledge_categories(spark, d):
    return marked(spark, d).select("doc_id", F.explode(text.category_hits(F.col("t"))).alias("h")).select("doc_id", "h.category", F.col("h.hits").cast("long").alias("hits"))


TOP = "SELECT m.doc_id, coalesce(arg_min(category, ord - 100 * hits) FILTER (WHERE hits >= 2), 'unclassified') AS category FROM m LEFT JOIN h USING (doc_id) GROUP BY 1"


def _order_sql(order: list[str]) -> str:
    return "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(order)) + f" ELSE {len(order)} END"


@query(MARKED + f", h AS ({HITS}) SELECT doc_id, category, (row_number() OVER (ORDER BY {_order_sql(lexicons.ONTOLOGICAL_ORDER)}, doc_id) - 1)::BIGINT AS ontological, (row_number() OVER (ORDER BY {_order_sql(lexicons.TAXONOMY_ORDER)}, doc_id) - 1)::BIGINT AS taxonomic FROM ({TOP})")
def knowledge_order(spark, d):
    # Both orders read their rows twice, and a category is a scan of the whole text.
    rows = scratch.stored(marked(spark, d).select("doc_id", F.col("doc_id").alias("seq"), text.category(F.col("t")).alias("category")), "categories")
    one = rel.by_category(rows, lexicons.ONTOLOGICAL_ORDER).select("doc_id", "category", F.col("pos").alias("ontological"))
    return one.join(rel.by_category(rows, lexicons.TAXONOMY_ORDER).select("doc_id", F.col("pos").alias("taxonomic")), "doc_id")


@query(MARKED + f"SELECT doc_id, {' OR '.join(_n(p, 'lower(t)') + ' > 0' for p in lexicons.SEARCH_TRIGGERS)} AS use_search FROM m")
def search_triggers(spark, d):
    return marked(spark, d).select("doc_id", text.needs_search(F.col("t")).alias("use_search"))


@query("SELECT item_id, CASE WHEN item_id % 4 = 0 THEN item_id % 8 = 0 ELSE item_id % 5 = 0 OR coalesce(CASE WHEN item_id % 7 <> 0 THEN item_id % 2 = 0 END, true) OR coalesce(CASE WHEN item_id % 3 <> 0 THEN (item_id % 10) / 10 END, 0) < 0.6 END AS searches FROM benchmark")
def routing_decisions(spark, d):
    i = F.col("item_id")
    forced, needs, confidence = F.when(i % 4 == 0, i % 8 == 0), F.when(i % 7 != 0, i % 2 == 0), F.when(i % 3 != 0, (i % 10) / 10)
    return table(spark, d, "benchmark").select("item_id", text.routing_decision(forced, needs, confidence, i % 5 == 0).alias("searches"))


OUTPUTS = [
    ('{"a": 1}', '{"a": 1}', '{"a": 1}', '{"a": 1}', '{"a": 1}'),
    ('```json\n{"a": 2}\n```', '{"a": 2}', '{"a": 2}', '{"a": 2}', '{"a": 2}'),
    ('Sure: {"a": {"b": 3}} - ok', 'Sure: {"a": {"b": 3}} - ok', '{"a": {"b": 3}}', '{"a": {"b": 3}}', '{"a": {"b": 3}}'),
    ("```", None, None, None, None),
    ("no braces", "no braces", None, None, None),
    ('x {"a": 4} and {"c": 5}', 'x {"a": 4} and {"c": 5}', '{"a": 4}', '{"a": 4}', None),
    ('one ```json {"a": 6}``` two ```{"c": 7}```', 'one ```json {"a": 6}``` two ```{"c": 7}```', '{"a": 6}', '{"a": 6}', '{"a": 6}'),
    ('broken {"a": ', 'broken {"a":', None, None, None),
]


def _value(s: str | None) -> str:
    return "NULL" if s is None else _quoted(s)


@query("SELECT seq, unfenced, balanced, strict, loose, a FROM (VALUES " + ", ".join(f"({i}, {', '.join(_value(x) for x in (o[1], o[2], o[3], o[4]))}, {_value(None if o[3] is None else '{' + chr(34) + 'b' + chr(34) + ':3}' if 'b' in o[3] else o[3][-2])})" for i, o in enumerate(OUTPUTS)) + ") t(seq, unfenced, balanced, strict, loose, a)")
def json_out_of_output(spark, d):
    """Every way out of a model's output: bare, fenced, embedded, several objects, broken ones."""
    rows = spark.createDataFrame([(i, o[0]) for i, o in enumerate(OUTPUTS)], "seq int, t string")
    t = F.col("t")
    return rows.select("seq", json_text.unfenced(t).alias("unfenced"), json_text.first_balanced(t).alias("balanced"), json_text.salvage(t).alias("strict"), json_text.salvage_loose(t).alias("loose"), F.get_json_object(json_text.salvage(t), "$.a").alias("a"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.page'), 'none') AS page, '0.5' AS weight FROM events")
def json_defaults(spark, d):
    f = json_text.filled(F.col("props"), {"page": "none", "weight": 0.5})
    return table(spark, d, "events").select("event_id", f["page"].alias("page"), f["weight"].alias("weight"))


@query("SELECT item_id, 'Stage: s' || (item_id % 5) || chr(10) || 'Criterion: ' || substring(text, 1, 10) || chr(10) || '- a' || chr(10) || '- b' || chr(10) || 'References: x, y' || chr(10) || 'Concepts: k: v; l: ' || item_id AS stage, CASE WHEN item_id % 2 = 0 THEN 'Stages: one, two' ELSE '' END AS clause, 'Use this.' || chr(10) || chr(10) || text AS context, '## EN' || chr(10) || chr(10) || text AS document FROM benchmark")
def prompts(spark, d):
    i = F.col("item_id")
    stage = templates.stage_prompt(F.concat(F.lit("s"), i % 5), F.substring("text", 1, 10), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"), F.lit("y")), F.create_map(F.lit("k"), F.lit("v"), F.lit("l"), i.cast("string")))
    clause = templates.stages_clause(F.when(i % 2 == 0, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>")))
    return table(spark, d, "benchmark").select("item_id", stage.alias("stage"), clause.alias("clause"), templates.context_prompt("Use this.", F.col("text")).alias("context"), templates.document_text(F.lit("en"), F.col("text")).alias("document"))


@query("SELECT item_id, substring('Search 1: ' || item_id || ' -> ' || text || chr(10) || 'Search 2: N/A -> N/A', 1, 60) AS calls FROM benchmark")
def tool_call_texts(spark, d):
    one = lambda q, r: F.struct(q.cast("string").alias("query"), r.cast("string").alias("result"))
    calls = F.array(one(F.col("item_id"), F.col("text")), one(F.lit(None), F.lit(None)))
    return table(spark, d, "benchmark").select("item_id", templates.tool_calls_text(calls, 60).alias("calls"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'discrimination' WHEN 1 THEN 'force' WHEN 2 THEN 'constraint' ELSE 'general' END AS operation, CASE p_partkey % 2 WHEN 0 THEN 'short' ELSE 'name-' || (p_partkey % 3) END AS model, CASE p_partkey % 3 WHEN 0 THEN 'mid' ELSE 'a-b' END AS arm FROM part")
def names(spark, d):
    i = F.col("p_partkey")
    target = F.element_at(F.array(*map(F.lit, ("factual", "causal", "gap", "odd"))), (i % 4 + 1).cast("int"))
    model = F.when(i % 2 == 0, "org/Known").otherwise(F.concat(F.lit("org/NAME-"), i % 3))
    arm = F.when(i % 3 == 0, "pre-mid-end").otherwise("a-b")
    return table(spark, d, "part").select(i.alias("id"), templates.operation(target).alias("operation"), templates.short_model_name(model, {"org/Known": "short"}).alias("model"), templates.pretraining_arm(arm).alias("arm"))


@query(cte() + "SELECT query_id AS prompt, config_a AS chosen, config_b AS rejected FROM judgments")
def trainer_rows(spark, d):
    return judgments(spark, d).select(*templates.trainer_row(F.col("query_id"), F.col("config_a"), F.col("config_b")))


@query(cte() + "SELECT seq, CASE raw WHEN 'A' THEN o[1] WHEN 'B' THEN o[2] ELSE 'TIE' END AS winner, CASE WHEN o[1] = config_a THEN list_sum(sa) ELSE list_sum(sb) END AS total_a, CASE WHEN o[1] = config_a THEN list_sum(sb) ELSE list_sum(sa) END AS total_b FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN [config_a, config_b] ELSE [config_b, config_a] END AS o, ['A', 'B', 'TIE', 'odd'][seq % 4 + 1] AS raw FROM judgments)")
def realigned_judgments(spark, d):
    order = F.when(F.col("seq") % 2 == 0, F.array("config_a", "config_b")).otherwise(F.array("config_b", "config_a"))
    raw = F.element_at(F.array(*map(F.lit, ("A", "B", "TIE", "odd"))), (F.col("seq") % 4 + 1).cast("int"))
    j = judgments(spark, d).withColumn("r", scoring.realigned(order, raw, F.col("scores_a"), F.col("scores_b"), F.col("config_a")))
    return j.select("seq", "r.winner", scoring.score_sum(F.col("r.scores_a")).alias("total_a"), scoring.score_sum(F.col("r.scores_b")).alias("total_b"))


@query(cte() + "SELECT config || '|' || substring(response, 1, 60) AS key, config, query_id, CASE config WHEN 'raw' THEN response WHEN 'lang' THEN lang WHEN 'short' THEN substring(response, 1, 9) END AS response FROM (SELECT query_id, response, lang FROM responses WHERE arm = 'method'), (VALUES ('raw'), ('lang'), ('short'), ('none')) c(config)")
def strategies(spark, d):
    """Records fanned out over four strategies; the first passes the text through."""
    records = responses(spark, d).where("arm = 'method'").select("query_id", "response", "lang", F.col("response").alias("query"))
    ways = {"raw": F.col("response"), "lang": F.col("lang"), "short": F.substring("response", 1, 9), "none": F.lit(None)}
    return rel.fan_out(records, ways).select("key", "config", "query_id", "response")


@query("SELECT item_id, s::INTEGER AS stage, 'stage ' || s AS name FROM benchmark, (SELECT unnest(range(1, 6)) AS s)")
def question_stages(spark, d):
    stages = spark.createDataFrame([(i, f"stage {i}") for i in range(1, 6)], "stage int, name string")
    return rel.stage_lookup(rel.with_stages(table(spark, d, "benchmark")), stages).select("item_id", "stage", "name")


@query("SELECT mode, ord::INTEGER AS ord, stage::INTEGER AS stage FROM (VALUES ('yoga', 0, 1), ('yoga', 1, 2), ('yoga', 2, 3), ('yoga', 3, 4), ('yoga', 4, 5), ('reverse', 0, 5), ('reverse', 1, 4), ('reverse', 2, 3), ('reverse', 3, 2), ('reverse', 4, 1), ('bookend', 0, 1), ('bookend', 1, 2), ('bookend', 2, 3), ('bookend', 3, 4), ('bookend', 4, 5), ('bookend', 5, 1)) t(mode, ord, stage)")
def stage_orders(spark, d):
    return rel.stage_order(spark)


@query(cte() + "SELECT 'head' AS side, string_agg(stage, ',' ORDER BY seq) AS stages FROM (SELECT stage, seq FROM pairs ORDER BY seq LIMIT 10) UNION ALL SELECT 'tail', string_agg(stage, ',' ORDER BY seq) FROM (SELECT stage, seq FROM pairs ORDER BY seq DESC LIMIT 10)")
def sequence_ends(spark, d):
    from .derived import scored_pairs

    one = rel.ends(scored_pairs(spark, d), "stage")
    return one.select(F.explode(F.create_map(F.lit("head"), "head", F.lit("tail"), "tail")).alias("side", "s")).select("side", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("stages"))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM documents ORDER BY md5('h|' || doc_id), doc_id LIMIT 15) AS held FROM documents")
def random_holdout(spark, d):
    return rel.holdout(table(spark, d, "documents").select("doc_id"), 15, "h", "doc_id").select("doc_id", (F.col("split") == "holdout").alias("held"))


@query("SELECT doc_id, 'full|' || substring(text, 1, 60) AS key, 'full' AS config, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, 'general') AS target_op, coalesce(source, 'general') AS domain FROM documents")
def enriched_results(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("target_op"), F.col("source").alias("domain"), "text")
    return rel.enriched(rows, "full", F.substring("text", 1, 60)).select("doc_id", "key", "config", "target_op", "domain")
