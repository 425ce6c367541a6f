"""Text metrics as column expressions.

Patterns run with Unicode classes and with line ends at \\n alone, which is
how the lists in ``lexicons`` are meant.  Lists of them are counted in one pass (``scan``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons
from .scan import FLAGS, Term, count_groups, counts, terms_of


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(FLAGS + pattern))


def tag_counts(text: Column, tags: list[str] = lexicons.CLAIM_TAGS) -> Column:
    """Map of bracketed label -> occurrences, with their total."""
    found = counts(text, [[rf"\[{t}\]"] for t in tags])
    total = reduce(lambda a, b: a + b, found)
    return F.create_map(*(x for t, c in zip([*tags, "total"], [*found, total], strict=True) for x in (F.lit(t), c)))


def marker_counts(text: Column, **lists: list[str]) -> dict[str, Column]:
    """How often the patterns of each list match in the lower-cased text, all of them in one pass."""
    return dict(zip(lists, counts(F.lower(text), list(lists.values())), strict=True))


def example_markers(text: Column) -> Column:
    return marker_counts(text, n=lexicons.EXAMPLE_MARKERS)["n"]


def grounding_markers(text: Column) -> Column:
    return marker_counts(text, n=lexicons.GROUNDING_MARKERS)["n"]


def hedges(text: Column, patterns: list[str] = lexicons.HEDGES) -> Column:
    return marker_counts(text, n=patterns)["n"]


def reasoning_steps(text: Column) -> Column:
    labelled = rf"(?m)^\s*(?:{'|'.join(lexicons.STEP_LABELS)})[:\s]"
    return count(text, r"(?m)^\s*\d+[.)]\s") + counts(text, [[labelled]])[0]


def syllogism(text: Column) -> Column:
    """Struct of the count of each step and of complete ones (the least count)."""
    # Without letters that other ones than their capitals stand for, if case is ignored.
    parts = [max(re.split("[isk]", s.lower()), key=len) for s in lexicons.SYLLOGISM_STEPS]
    held = count_groups(F.lower(text), [[Term(p)] for p in parts])
    step = lambda s: count(text, rf"(?i)(?:^|\n)\s*(?:\d+\.?\s*)?(?:\*\*)?{s}")
    steps = {s: F.when(F.get(held, F.lit(i)) == 0, 0).otherwise(step(s)) for i, s in enumerate(lexicons.SYLLOGISM_STEPS)}
    return F.struct(*(c.alias(s.lower()) for s, c in steps.items()), F.least(*steps.values()).alias("complete"))


def claims(text: Column, longer_than: int = 20) -> Column:
    """Sentences of more than so many characters."""
    return F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.length(strip(s)) > longer_than))


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def first_sentences(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"(?U)(?<=[.!?])\s+"), 1, n), " ")


def strip_thinking(text: Column) -> Column:
    """Without closed <think> blocks, stripped."""
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def strip_all_thinking(text: Column) -> Column:
    """Without closed and unclosed <think> blocks; the text itself where nothing would be left."""
    out = strip(F.regexp_replace(F.regexp_replace(text, r"(?sU)<think>.*?</think>\s*", ""), r"(?s)<think>.*$", ""))
    return F.when(out == "", text).otherwise(out)


def truncated(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def or_sentinel(text: Column, message: str = "[ERROR]") -> Column:
    return F.coalesce(text, F.lit(message))


def structure(text: Column, tool_queries: Column | None = None) -> Column:
    """All metrics of a response in one struct."""
    found = marker_counts(text, grounding=lexicons.GROUNDING_MARKERS, hedges=lexicons.HEDGES_SHORT)
    queries = F.coalesce(tool_queries, F.array().cast("array<string>")) if tool_queries is not None else F.array().cast("array<string>")
    return F.struct(
        tag_counts(text, lexicons.CLAIM_TAGS_SHORT).alias("tags"), claims(text).alias("claim_count"), syllogism(text).alias("steps"), found["grounding"].alias("grounded_examples"),
        found["hedges"].alias("hedging_count"), F.size(queries).alias("total_searches"), queries.alias("search_queries"), words(text).alias("word_count"),
    )


def category_term(term: str) -> Term:
    """A phrase with a space: as a substring; a single term: at word boundaries."""
    return Term(term.lower()) if " " in term else Term(term.lower(), True, True)


def category_hits(text: Column, categories: dict[str, list[str]] = lexicons.CATEGORIES, threshold: int = 2) -> Column:
    """array<struct<category, hits>> of the categories with that many different terms, most hits first; ties in order of declaration."""
    hits = count_groups(F.lower(text), [list(map(category_term, terms)) for terms in categories.values()], distinct=True)
    names = F.array(*map(F.lit, categories))
    scored = F.transform(hits, lambda n, i: F.struct((-n).alias("neg"), i.alias("ord")))
    found = F.array_sort(F.filter(scored, lambda s: s["neg"] <= -threshold))
    return F.transform(found, lambda s: F.struct(F.get(names, s["ord"]).alias("category"), (-s["neg"]).alias("hits")))


def category(text: Column, categories: dict[str, list[str]] = lexicons.CATEGORIES, threshold: int = 2) -> Column:
    hits = category_hits(text, categories, threshold)
    return F.coalesce(F.get(hits, F.lit(0))["category"], F.lit("unclassified"))


def needs_search(question: Column, triggers: list[str] = lexicons.SEARCH_TRIGGERS) -> Column:
    lowered, terms = F.lower(question), [terms_of(t, apart=False) for t in triggers]
    found = F.get(count_groups(lowered, [[x for t in terms for x in t or ()]], distinct=True), F.lit(0)) > 0
    rest = [t for t, x in zip(triggers, terms, strict=True) if x is None]
    return found | lowered.rlike("(?U)" + "|".join(f"(?:{t})" for t in rest)) if rest else found


def route(question: Column, triggers: list[str] = lexicons.SEARCH_TRIGGERS) -> Column:
    need = needs_search(question, triggers)
    return F.struct(need.alias("use_search"), F.when(need, "heuristic_search").otherwise("heuristic_no_search").alias("routing_reason"))


def routing_decision(forced: Column, needs: Column, confidence: Column, failed: Column) -> Column:
    """A forced decision stands; a failed classification, a need, or a confidence under 0.6 searches."""
    return F.coalesce(forced, failed | F.coalesce(needs, F.lit(True)) | (F.coalesce(confidence, F.lit(0.0)) < 0.6))
