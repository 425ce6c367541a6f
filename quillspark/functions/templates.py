"""Prompts and messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import truncated


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def pairs_text(entries: Column) -> Column:
    """Map -> "k: v; k: v"."""
    return F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def messages(question: Column, answer: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def pairwise_prompt(question: Column, first: Column, second: Column, flipped: Column) -> Column:
    """Both responses, exchanged where ``flipped``."""
    a, b = F.when(flipped, second).otherwise(first), F.when(flipped, first).otherwise(second)
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nResponse A:\n"), a, F.lit("\n\nResponse B:\n"), b)


def stage_prompt(name: Column, criterion: Column, traits: Column, refs: Column, concepts: Column) -> Column:
    return F.concat(F.lit("Stage: "), name, F.lit("\nCriterion: "), criterion, F.lit("\n"), bullets(traits), F.lit("\nReferences: "), F.array_join(refs, ", "), F.lit("\nConcepts: "), pairs_text(concepts))


def stages_clause(stages: Column) -> Column:
    return F.when(F.size(stages) > 0, F.concat(F.lit("Stages: "), F.array_join(stages, ", "))).otherwise(F.lit(""))


def tool_calls_text(calls: Column, limit: int = 2000) -> Column:
    """array<struct<query, result>> -> one "Search i" line each, missing values as N/A, cut at ``limit`` characters."""
    return truncated(F.array_join(F.transform(calls, lambda c, i: F.format_string("Search %d: %s -> %s", i + 1, F.coalesce(c["query"], F.lit("N/A")), F.coalesce(c["result"], F.lit("N/A")))), "\n"), limit)


def context_prompt(header: str, context: Column) -> Column:
    return F.concat(F.lit(header + "\n\n"), context)


def document_text(doc_type: Column, content: Column) -> Column:
    return F.concat(F.lit("## "), F.upper(doc_type), F.lit("\n\n"), content)


def operation(target: Column) -> Column:
    """Question type -> operation."""
    # Fixed values.
    names = {"factual": "discrimination", "causal": "force", "gap": "constraint"}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[target], F.lit("general"))


def short_model_name(model_id: Column, known: dict[str, str]) -> Column:
    last = F.lower(F.element_at(F.split(model_id, "/"), -1))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[model_id], last) if known else last


def pretraining_arm(name: Column) -> Column:
    """The second part of a name of three or more parts, else the name."""
    parts = F.split(name, "-")
    return F.when(F.size(parts) >= 3, parts[1]).otherwise(name)


def trainer_row(query: Column, preferred: Column, rejected: Column) -> list[Column]:
    return [query.alias("prompt"), preferred.alias("chosen"), rejected.alias("rejected")]


def provenance(primary: Column, fallback: Column) -> Column:
    """text and source of a lookup with a fallback; a text that reports a failure counts as missing."""
    good = lambda x: F.when(~F.lower(x).contains("failed") & (x != ""), x)
    return F.struct(F.coalesce(good(primary), good(fallback), F.lit("search failed")).alias("text"), F.when(good(primary).isNotNull(), "primary").when(good(fallback).isNotNull(), "fallback").otherwise("failed").alias("source"))
