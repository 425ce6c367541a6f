"""Judges, extraction and rewriting by a provider: prompts as columns, one call a row, answers parsed into columns.

A row whose call fails has null results; judgments of such rows are left out, so that a later run tries them again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, templates
from ..lexicons import DIMENSIONS
from .external import Provider, answer, answer_distinct, asked_in_tasks, with_retries

Make = Callable[[], Provider]


def _asked(work: DataFrame, prompt: Column, provider: Make, schema: str) -> DataFrame:
    return answer(work.withColumn("_prompt", prompt), "_prompt", provider, as_json=True, out="_answer").withColumn("_found", F.from_json("_answer", schema)).drop("_prompt", "_answer")


def pairwise(work: DataFrame, provider: Make, seed: str = "judge", header: str = "", dims: list[str] = DIMENSIONS) -> DataFrame:
    """key, query, config_a, config_b, response_a, response_b, ... + order, winner, scores_a, scores_b, reason.

    Which response stands first is a coin of seed and key; winner and scores are given back to their arms.
    ``header`` makes it a judge that knows of a context (see ``context_aware``); another provider, a judge of a second family.
    """
    flipped = scoring.coin(seed, F.col("key"))
    order = F.when(flipped, F.array("config_b", "config_a")).otherwise(F.array("config_a", "config_b"))
    prompt = F.concat(F.lit(header), templates.pairwise_prompt(F.col("query"), F.col("response_a"), F.col("response_b"), flipped))
    out = _asked(work, prompt, provider, "winner string, response_a map<string,double>, response_b map<string,double>, reason string").where("_found is not null")
    fair = scoring.realigned(F.col("order"), F.col("_found.winner"), F.col("_found.response_a"), F.col("_found.response_b"), F.col("config_a"))
    return out.withColumn("order", order).withColumn("_fair", fair).select("*", "_fair.winner", "_fair.scores_a", "_fair.scores_b", F.coalesce("_found.reason", F.lit("")).alias("reason")).drop("_fair", "_found")


def context_aware(work: DataFrame, provider: Make, seed: str = "judge") -> DataFrame:
    return pairwise(work, provider, seed, "Both responses may use a given context; using it is no fault.\n\n")


def factual(work: DataFrame, provider: Make) -> DataFrame:
    """query, response, ... + claims_checked, claims_accurate."""
    prompt = F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nCheck the facts of this response:\n"), F.col("response"))
    return _asked(work, prompt, provider, "claims_checked long, claims_accurate long").select("*", "_found.claims_checked", "_found.claims_accurate").drop("_found")


def tool_use(work: DataFrame, provider: Make, limit: int = 2000) -> DataFrame:
    """query, response, tool_calls, ... + overall_tool_value; the response is cut at ``limit``."""
    prompt = F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nSearches:\n"), templates.tool_calls_text(F.col("tool_calls")), F.lit("\n\nFinal response:\n"), F.substring("response", 1, limit))
    return _asked(work, prompt, provider, "overall_tool_value long").select("*", "_found.overall_tool_value").drop("_found")


def pointwise(work: DataFrame, provider: Make, dims: list[str], framework: str) -> DataFrame:
    """query, response, ... + framework, scores (a map over ``dims``, those that the judge left out missing)."""
    prompt = F.concat(F.lit(f"Rate by {', '.join(dims)}.\n\nQuestion: "), F.col("query"), F.lit("\n\nResponse:\n"), F.col("response"))
    found = _asked(work, prompt, provider, "scores map<string,double>").where("_found is not null")
    return found.withColumns({"framework": F.lit(framework), "scores": F.map_filter("_found.scores", lambda k, _: k.isin(dims))}).drop("_found")


def extract(docs: DataFrame, provider: Make, schema: str, limit: int = 4000, tries: int = 3) -> DataFrame:
    """text, ... + extraction (of ``schema``) of the first ``limit`` characters; an answer without entities is asked for again, null after ``tries``."""

    def one(p, text):
        for _ in range(tries):
            found = with_retries(lambda: p.call_json(f"Extract knowledge from:\n\n{text}"), tries=1)
            if found and "entities" in found:
                return json.dumps(found)
        return None

    start = F.substring(F.coalesce("text", F.lit("")), 1, limit)
    return docs.withColumn("_answer", asked_in_tasks(provider, one, "string")(start)).withColumn("extraction", F.from_json("_answer", schema)).drop("_answer")


def evidence(work: DataFrame, question: str, provider: Make) -> DataFrame:
    """needs, confidence and failed of the provider that decides whether to search."""
    found = _asked(work, F.concat(F.lit("Does this need a search?\n"), F.col(question)), provider, "needs_search boolean, confidence double")
    return found.select("*", F.col("_found.needs_search").alias("needs"), F.col("_found.confidence").alias("confidence"), F.col("_found").isNull().alias("failed")).drop("_found")


def rewritten(work: DataFrame, text: str, provider: Make, header: str, out: str = "rewritten") -> DataFrame:
    """The provider's version of a text (rewriting a question, tagging claims, formatting, synthesis), asked for once a different text; the text itself where it fails."""
    asked = answer_distinct(work.withColumn("_prompt", F.concat(F.lit(header + "\n\n"), F.col(text))), "_prompt", provider, out=out)
    return asked.withColumn(out, F.coalesce(out, text)).drop("_prompt")


def synthesized(work: DataFrame, text: str, stages: Column, provider: Make, out: str = "synthesis") -> DataFrame:
    """As ``rewritten``, with a clause that names the stages."""
    marked = work.withColumn("_staged", F.concat(templates.stages_clause(stages), F.lit("\n"), F.col(text)))
    asked = answer_distinct(marked, "_staged", provider, out=out)
    return asked.withColumn(out, F.coalesce(out, text)).drop("_staged")
