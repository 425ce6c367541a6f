"""Readers and writers of JSON lines, JSON values, text and settings.

Every reader adds ``seq``, the place of a record in its source, since order
decides ties later.  A missing path gives an empty frame.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.text import first_sentences, words
from ..operators.relational import difficulty, union_all

QUESTION = "query string, target_op string, domain string, difficulty string"
RESPONSE = "key string, query string, target_op string, domain string, config string, response string, word_count int, model string, provider string"
JUDGMENT = "key string, type string, query string, config_a string, config_b string, winner string, reason string, target_op string, domain string, order array<string>, scores_a map<string,double>, scores_b map<string,double>, comparison string, model string, judge_model string"
PAIR = "query string, preferred string, rejected string, stage int, dominant_dimension string, score_delta double, total_delta double, source string, source_model string, winner_config string, loser_config string"
SFT_EXAMPLE = "key string, messages array<struct<role:string,content:string>>, stage int, stage_name string, quality_dimension string, query string, target_op string, domain string"


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A relation given in code (questions, topics, registries), with ``seq`` in its order."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, seq long")


def exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system of the path, whichever it is; a path with wildcards exists if anything matches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


#: Bits of ``seq`` for the place in a file; the rank of the file stands above them.
PLACE_BITS = 42


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _with_seq(df: DataFrame, first_file: int = 0) -> tuple[DataFrame, int]:
    """seq: rank of the file by name (from ``first_file``), then the place in it; and the rank after the last file.

    A file's blocks but the last are read by tasks of their own, so that block start + number in the task grows
    through a file.  No row is moved; one row for each file is broadcast.
    """
    spark, names = df.sparkSession, sorted(df.inputFiles())
    ranks = spark.createDataFrame([(n, first_file + i) for i, n in enumerate(names)], "quill__file string, quill__rank long").withColumn("quill__file", _plain(F.col("quill__file")))
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.select("*", _plain(F.col("_metadata.file_path")).alias("quill__file"), (F.col("_metadata.file_block_start") + number).alias("quill__place"))
    seq = F.shiftleft("quill__rank", PLACE_BITS) + F.col("quill__place")
    return placed.join(F.broadcast(ranks), "quill__file").withColumn("seq", seq).drop("quill__file", "quill__rank", "quill__place"), first_file + len(names)


def _json_lines(spark: SparkSession, path: str, schema: str, strict: bool, first_file: int) -> tuple[DataFrame, int]:
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, seq long"), first_file
    return _with_seq(spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path), first_file)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One record a line; blank lines are skipped; a malformed line fails (``strict``) or becomes nulls; ``path`` may have wildcards."""
    return _json_lines(spark, path, schema, strict, 0)[0]


def json_array(spark: SparkSession, path: str, schema: str, fallback: DataFrame | None = None) -> DataFrame:
    """A file that holds one array of records; a missing file gives a warning and the first ten rows of ``fallback``, or none."""
    if exists(spark, path):
        return _with_seq(spark.read.schema(schema).option("multiLine", True).json(path))[0]
    warnings.warn(f"{path} is missing", stacklevel=2)
    return fallback.orderBy("seq").limit(10) if fallback is not None else spark.createDataFrame([], f"{schema}, seq long")


def string_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("seq", "query"))


def json_object(spark: SparkSession, path: str) -> DataFrame:
    """An object of objects: query, fields."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("query", "fields"))


def text_documents(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """doc_type, content, word_count of whole files; missing ones are skipped.  A file is one row, so it must fit in one; ``document_words`` counts larger ones."""
    frames = [spark.read.text(p, wholetext=True).select(F.lit(i).cast("long").alias("seq"), F.lit(k).alias("doc_type"), F.col("value").alias("content")) for i, (k, p) in enumerate(paths.items()) if exists(spark, p)]
    if not frames:
        return spark.createDataFrame([], "seq long, doc_type string, content string, word_count int")
    return reduce(DataFrame.unionByName, frames).withColumn("word_count", words(F.col("content")))


def document_words(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """seq, doc_type, word_count of ``text_documents``, counted line by line in splits, so that a document may be of any size, and a folder of many files."""
    frames = [spark.read.text(p, lineSep="\n").select(F.lit(i).cast("long").alias("seq"), F.lit(k).alias("doc_type"), words(F.col("value")).alias("_n")) for i, (k, p) in enumerate(paths.items()) if exists(spark, p)]
    if not frames:
        return spark.createDataFrame([], "seq long, doc_type string, word_count long")
    return reduce(DataFrame.unionByName, frames).groupBy("seq", "doc_type").agg(F.sum("_n").alias("word_count"))


def paragraphs(df: DataFrame, text: str = "value", longer_than: int = 100) -> DataFrame:
    """Blocks between blank lines, their lines joined by spaces, of more than so many characters."""
    rows = df.select("*", F.posexplode(F.split(text, r"\n\s*\n")).alias("passage_no", "_b"))
    return rows.withColumn("passage", F.regexp_replace(F.regexp_replace("_b", r"\s*\n\s*", " "), r"(?U)^\s+|\s+$", "")).where(F.length("passage") > longer_than).drop("_b")


def file_paragraphs(spark: SparkSession, path: str, longer_than: int = 100) -> DataFrame:
    """file, block, part, passage: ``paragraphs`` of text files that are read in splits, not whole.

    A split gives its whole paragraphs, and the fragments before its first and after its last blank line (one fragment, if it has none).
    Fragments of a file are put in order and joined from one that begins a paragraph to the next; only these, two a split, are shuffled,
    by file.  ``block`` and ``part`` are those of a paragraph's beginning and sort a file's paragraphs in order.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part, lines = None, 0, []
        row = lambda opened, closed: (*at, part, opened, closed, " ".join(lines).strip())
        for pdf in batches:
            rows = []
            for file, block, value in zip(pdf["file"], pdf["block"], pdf["value"], strict=True):
                if (file, block) != at:
                    if at:
                        rows.append(row(part > 0, False))
                    at, part, lines = (file, block), 0, []
                line = value.strip()
                if line:
                    lines.append(line)
                elif lines or not part:
                    rows.append(row(part > 0, True))
                    part, lines = part + 1, []
            yield pd.DataFrame(rows, columns=names)
        if at:
            yield pd.DataFrame([row(part > 0, False)], columns=names)

    names = ["file", "block", "part", "opened", "closed", "passage"]
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    parts = lines.mapInPandas(cut, "file string, block long, part long, opened boolean, closed boolean, passage string")
    # Parts are read twice: whole paragraphs, and fragments.
    parts = scratch.stored(parts.where((F.length("passage") > longer_than) | ~(F.col("opened") & F.col("closed"))), "paragraphs")
    whole = parts.where("opened and closed").select("file", "block", "part", "passage")
    fragments = parts.where("not (opened and closed)")
    order = Window.partitionBy("file").orderBy("block", "part")
    begun = F.sum(F.col("opened").cast("long")).over(order)
    groups = fragments.withColumn("_g", begun).groupBy("file", "_g")
    joined = groups.agg(F.array_sort(F.collect_list(F.struct("block", "part", "passage"))).alias("_f")).select("file", F.col("_f")[0]["block"].alias("block"), F.col("_f")[0]["part"].alias("part"), F.array_join(F.filter(F.transform("_f", lambda f: f["passage"]), lambda t: t != ""), " ").alias("passage"))
    return whole.unionByName(joined).where(F.length("passage") > longer_than)


def settings(text: str) -> dict[str, str]:
    """key=value lines; blank lines and comments are skipped, the first = parts."""
    lines = (x.strip() for x in text.splitlines())
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if x and x[0] != "#" and "=" in x)}


def first_existing(spark: SparkSession, *paths: str | None) -> str:
    for p in paths:
        if p and exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths}")


def runnable(spark: SparkSession, artifacts: dict[str, str]) -> DataFrame:
    """config of the arms whose artifact exists."""
    return spark.createDataFrame([(k,) for k, p in artifacts.items() if exists(spark, p)], "config string")


def labelled_union(spark: SparkSession, registry: list[dict], schema: str, kinds: set[str] | None = None) -> DataFrame:
    """All files of the registry (path, kind, source, source_model) as one frame; only the wanted kinds are opened.

    ``seq`` grows in order of the registry, then as in ``json_lines``.
    """
    frames, first = [], 0
    for r in registry:
        if kinds is None or r["kind"] in kinds:
            rows, first = _json_lines(spark, r["path"], schema, True, first)
            frames.append(rows.withColumns({"source": F.lit(r["source"]), "source_model": F.lit(r["source_model"]), "kind": F.lit(r["kind"])}))
    return union_all(frames) if frames else spark.createDataFrame([], f"{schema}, seq long, source string, source_model string, kind string")


def at_least(rows: DataFrame, k: float) -> DataFrame:
    """Rows whose total_delta (else score_delta, else 0) reaches k; all of them for k <= 0."""
    return rows if k <= 0 else rows.where(difficulty() >= k)


def lookup_connector(documents: DataFrame, limit: int = 2000) -> Callable[[DataFrame], DataFrame]:
    """The offline search: the document of the query's topic, cut; null where there is none."""

    def search(queries: DataFrame) -> DataFrame:
        return queries.join(documents.select(F.col("topic").alias("query"), F.substring("text", 1, limit).alias("result")), "query", "left")

    return search


def summary_connector(documents: DataFrame, most: int = 3, sentences: int = 5) -> Callable[[DataFrame], DataFrame]:
    """The offline encyclopedia: first sentences of the ``most`` first documents (topic, title, text, seq) of a topic, one paragraph each; without any, a text that says so.

    Only the first documents of a topic are gathered.
    """

    def search(queries: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("topic").orderBy("seq"))
        first = documents.withColumn("rank", rank).where(F.col("rank") <= most)
        part = F.concat("title", F.lit(": "), first_sentences(F.col("text"), sentences))
        found = first.groupBy(F.col("topic").alias("query")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("result"))
        return queries.join(found, "query", "left").withColumn("result", F.coalesce("result", F.lit("search failed: nothing found")))

    return search


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_ordered_json(df: DataFrame, path: str, *order: str) -> None:
    """One file in order; meant for data sets that a single trainer reads."""
    df.orderBy(*order).drop(*(set(order) & {"seq", "pos"})).coalesce(1).write.mode("overwrite").json(path)


def write_train_valid(df: DataFrame, path: str, column: str, *order: str) -> None:
    """Rows with split train and valid as two ordered data sets of one column."""
    for split in ("train", "valid"):
        df.where(F.col("split") == split).orderBy(*order).select(column).coalesce(1).write.mode("overwrite").json(f"{path}/{split}")


def write_corpus(df: DataFrame, path: str, *order: str, text: str = "text", whole: bool = True) -> None:
    """Texts with a blank line behind each, in one file, or else in files whose names are in order."""
    rows = df.orderBy(*order).select(F.concat(text, F.lit("\n")).alias("value"))
    (rows.coalesce(1) if whole else rows).write.mode("overwrite").text(path)


def write_array(df: DataFrame, path: str, *order: str) -> None:
    """Rows as one JSON array in order, one element a line; a file that one reader takes whole."""
    rows = df.select(*order, F.to_json(F.struct(*(c for c in df.columns if c not in {"seq", "pos"}))).alias("j"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct(*order, "j"))).alias("a"))
    one.select(F.concat(F.lit("[\n"), F.array_join(F.transform("a", lambda x: x["j"]), ",\n"), F.lit("\n]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_object(df: DataFrame, path: str) -> None:
    """A frame of one row as one JSON object."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def report_lines(rates: DataFrame) -> DataFrame:
    """config and line: each row of a comparison (config, total, win_rate, rate_text, effect, effect_size) at fixed widths."""
    without = F.format_string("%-25s %20s", F.col("config"), F.lit("N/A"))
    line = F.format_string("%-25s %20s %+10.3f %12s", F.col("config"), F.col("rate_text"), F.col("effect"), F.col("effect_size"))
    return rates.select("config", F.when(F.coalesce("total", F.lit(0)) == 0, without).otherwise(line).alias("line"))


def report(rates: DataFrame) -> str:
    """``report_lines`` in order of config under a heading; one line an arm."""
    head = [f"{'Config':<25} {'Win rate':>20} {'Effect':>10} {'Size':>12}", "-" * 70]
    return "\n".join([*head, *(r["line"] for r in report_lines(rates).orderBy("config").toLocalIterator())])


def local(path: str) -> str:
    return f"file://{Path(path).resolve()}"
