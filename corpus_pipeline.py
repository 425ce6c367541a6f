"""From raw documents to token files, one operator of ``quillspark.llm`` a stage.

Every stage reads what its predecessor kept; all but the last return the
columns of ``documents``.  Other columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, mixing, ngram_jaccard, token_output, toxicity
from quillspark.llm.common import stored, table, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Every row is judged by its own text, repeated ones alike; null and empty texts are scored as texts without words.
    Without labels nothing is rejected but by the share of toxic labels, which is 0 then.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles, the one with the least id; where rows share that id, the one with the first text.

    Documents without words are linked with nothing and stay, as do rows without an id.
    """
    docs = docs.select(*COLUMNS)
    classes = stored(ngram_jaccard.linked(docs).where("doc_id = component_id").select("doc_id").distinct(), "stay")
    kept = docs.join(classes, "doc_id", "left_semi")
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rest = [c for c in COLUMNS if c != "doc_id"]
    first = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", *(F.col("r")[c].alias(c) for c in rest))
    return kept.join(several, "doc_id", "left_anti").unionByName(first.select(*COLUMNS)).unionByName(docs.where("doc_id is null"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark contaminates; null and empty texts have no words and stay, repeated rows fare alike."""
    marked = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy in the mix; the copy at which the budget is used up keeps the words it has in the mix, joined by spaces.

    A document without words takes no part of a budget of words and stays as it is.  The rows have no
    order here, as the next stage sorts them by id.
    """
    mixed = stored(mixing.mix(docs.select(*COLUMNS)), "mixed")
    copies = mixing.stream(mixed, ordered=False)
    words = F.regexp_extract_all("text", F.lit(mixing.WORD_RE), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text"))
    whole = copies.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)
    return whole.unionByName(mixed.where("size = 0").select(*COLUMNS))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold: a row for every row, a null text as the end id alone, rows of one id in order of a hash of the text."""
    return token_output.write_and_digest(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontaminate", remove_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Model scores and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(docs)
    return docs
