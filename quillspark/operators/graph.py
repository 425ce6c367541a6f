"""Facet graphs from extracted entities, and retrieval of their text.

A graph is three frames: nodes, an index of categories and an index of gaps.
The two kinds of extraction differ only in the names of their fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import upsert

# Facet -> field of the extraction, for the two kinds.
FACETS = {
    "seven": {"kind": "dravya", "properties": "guna", "actions": "karma", "categories": "samanya", "differentiators": "vishesha", "relations": "samavaya", "gaps": "abhava", "global": "global_abhava"},
    "generic": {"kind": "entity_type", "properties": "attributes", "actions": "capabilities", "categories": "categories", "differentiators": "differentiators", "relations": "relationships", "gaps": "gaps", "global": "global_gaps"},
}
# Section titles by kind, question type and facet, in order.
SECTIONS = {
    "seven": {
        "discrimination": [("differentiators", "Key Differentiators"), ("categories", "Categories")],
        "force": [("actions", "Actions & Mechanisms"), ("properties", "Properties"), ("relations", "Structural Relationships")],
        "constraint": [("gaps", "Absences & Constraints"), ("properties", "Properties")],
        "general": [("properties", "Properties (Guna)"), ("actions", "Actions (Karma)"), ("differentiators", "Differentiators (Vishesha)"), ("relations", "Relationships (Samavaya)"), ("some_gaps", "Notable Absences")],
    },
    "generic": {
        "discrimination": [("differentiators", "Differentiators"), ("categories", "Categories")],
        "force": [("actions", "Capabilities & Mechanisms"), ("properties", "Attributes"), ("relations", "Relationships")],
        "constraint": [("gaps", "Gaps & Constraints"), ("properties", "Attributes")],
        "general": [("properties", "Attributes"), ("actions", "Capabilities"), ("differentiators", "Differentiators"), ("relations", "Relationships"), ("some_gaps", "Notable Gaps")],
    },
}
# What stands before a retrieved context.
HEADERS = {
    "seven": "## Reference Knowledge (7-category organized)\n\nThe following knowledge was extracted and organized using a 7-category ontology (entity, properties, actions, categories, differentiators, relationships, absences). Use it to inform your answer.\n\n",
    "generic": "## Reference Knowledge (Entity-organized)\n\nThe following knowledge was extracted and organized from source documents. Use it to inform your answer.\n\n",
}
LISTS = ["properties", "actions", "categories", "differentiators", "relations", "gaps"]


def entities(extractions: DataFrame, kind: str = "seven") -> DataFrame:
    """graph, seq, extraction -> one row for each entity, with seq (extraction, place); null extractions have none."""
    f = FACETS[kind]
    rows = extractions.where("extraction is not null").select("graph", F.col("seq").alias("_s"), F.posexplode("extraction.entities").alias("_p", "_e"))
    return rows.select("graph", (F.col("_s") * 1_000_000 + F.col("_p")).alias("seq"), F.coalesce(F.col("_e.name"), F.lit("unknown")).alias("name"), F.coalesce(F.col(f"_e.{f['kind']}"), F.lit("")).alias("kind"), *(F.coalesce(F.col(f"_e.{f[x]}"), F.array().cast("array<string>")).alias(x) for x in LISTS))


def nodes(found: DataFrame) -> DataFrame:
    """The last values of each name, at the place of its first appearance."""
    return upsert(found, ["graph", "name"])


def category_index(found: DataFrame) -> DataFrame:
    """Names of each category in order, every occurrence kept; ``seq`` is the first appearance."""
    rows = found.select("graph", "seq", "name", F.posexplode("categories").alias("_i", "category"))
    return rows.groupBy("graph", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_i", "name"))), lambda x: x["name"]).alias("names"), F.min(F.struct("seq", "_i")).alias("first"))


def gap_index(found: DataFrame, extractions: DataFrame, kind: str = "seven") -> DataFrame:
    """Every gap with its entity; gaps of a whole extraction have the entity _global and come after its entities."""
    own = found.select("graph", "seq", F.col("name").alias("entity"), F.posexplode("gaps").alias("i", "gap"))
    whole = extractions.where("extraction is not null").select("graph", (F.col("seq") * 1_000_000 + 999_999).alias("seq"), F.lit("_global").alias("entity"), F.posexplode(f"extraction.{FACETS[kind]['global']}").alias("i", "gap"))
    return own.unionByName(whole)


def _joined(*order: str, line: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_l")))), lambda x: x["_l"]), "\n")


def retrieve(found: DataFrame, extractions: DataFrame, kind: str = "seven") -> DataFrame:
    """graph, query_type, context for the four question types.

    Sections come in a fixed order, empty ones are left out, blank lines part them.
    A graph without entities has a fixed text.
    """
    n = nodes(found)
    line = lambda f: F.concat(F.lit("- **"), F.col("name"), F.lit("**: "), F.array_join(F.col(f), "; "))
    parts = [n.groupBy("graph").agg(_joined("seq", line=F.concat(F.lit("- **"), F.col("name"), F.lit("** ("), F.col("kind"), F.lit(")"))).alias("body")).withColumn("facet", F.lit("entities"))]
    for facet in ("properties", "actions", "differentiators", "relations"):
        parts.append(n.where(F.size(facet) > 0).groupBy("graph").agg(_joined("seq", line=line(facet)).alias("body")).withColumn("facet", F.lit(facet)))
    c = category_index(found)
    parts.append(c.groupBy("graph").agg(_joined("first", line=F.concat(F.lit("- **"), F.col("category"), F.lit("**: "), F.array_join("names", ", "))).alias("body")).withColumn("facet", F.lit("categories")))
    g = gap_index(found, extractions, kind)
    prefix = F.when(F.col("entity") == "_global", "").otherwise(F.concat(F.lit("["), F.col("entity"), F.lit("] ")))
    parts.append(g.groupBy("graph").agg(_joined("seq", "i", line=F.concat(F.lit("- "), prefix, F.col("gap"))).alias("body")).withColumn("facet", F.lit("gaps")))
    first = g.withColumn("r", F.row_number().over(Window.partitionBy("graph").orderBy("seq", "i"))).where("r <= 5")
    parts.append(first.groupBy("graph").agg(_joined("r", line=F.concat(F.lit("- "), F.col("gap"))).alias("body")).withColumn("facet", F.lit("some_gaps")))
    bodies = parts[0]
    for p in parts[1:]:
        bodies = bodies.unionByName(p)
    plan = [(q, i, f, t) for q, s in SECTIONS[kind].items() for i, (f, t) in enumerate([("entities", "Entities"), *s])]
    sections = found.sparkSession.createDataFrame(plan, "query_type string, ord int, facet string, title string")
    made = bodies.join(F.broadcast(sections), "facet").withColumn("text", F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.col("body")))
    text = made.groupBy("graph", "query_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("_t"), F.max(F.col("facet") == "entities").alias("_some"))
    every = extractions.select("graph").distinct().crossJoin(F.broadcast(sections.select("query_type").distinct()))
    return every.join(text, ["graph", "query_type"], "left").select("graph", "query_type", F.when(F.col("_some"), F.col("_t")).otherwise("No knowledge extracted.").alias("context"))


def prompt_context(retrieved: DataFrame, kind: str = "seven") -> DataFrame:
    return retrieved.withColumn("context", F.concat(F.lit(HEADERS[kind]), F.col("context")))
