"""URL filters: rules first, gradient-boosted trees on lexical features for the rest; DataFrame functions and Spark ML only.

A rule (host and path prefix, allow or block) fits its host and all subdomains, if the url's path starts with the
rule's; the longest rule that fits wins, of equally long ones the first by text.  A url that no rule fits gets the verdict of the
trees (block from a score of 0.5 on).

Features, of the whole url: lengths of url, host and path, depth (path segments that aren't empty), share of digits, entropy of
the characters (all beyond ASCII count as one), number of parameters, and suffix statistics: smoothed share of blocked urls among
the labelled ones whose host ends in the same label, in the same two labels, and whose path begins with the same segment.

The statistics cover all labelled urls of one half (by crc32 of the url), each distinct url once; the trees are fitted on the other half, so that no
url's own label is in its features there.  That half is bounded: about ``SAMPLE`` distinct urls, chosen by hash.  Statistics come back to the
urls by an ordinary join on the suffix: Spark broadcasts them while they are small by its own threshold, and
splits the partitions of a hot suffix otherwise.  Counts are combined before the shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path, and features of the empty text or of the url as it stands.  Without labelled urls
all verdicts are allow (score 0); with labels of one kind only, all verdicts are that kind.  Repeated rows get equal results.  Columns of the input are kept, but for
those named as the results are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: Verdict and rule; of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Distinct labelled urls that the trees are fitted on, about.
SAMPLE = 20_000
TREES, DEPTH, STEP, BINS = 10, 3, 0.4, 32
#: Labelled urls, at the overall share, that a statistic starts with.
PRIOR = 4.0
BLOCK_FROM = 0.5
RESULTS = ("host", "path", "rule", "verdict", "score")
STATISTICS = ("last_label", "last_two", "first_segment")
LEXICAL = ("n_url", "n_host", "n_path", "depth", "digits", "entropy", "n_params")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_RE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_RE, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_RE, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the rule that wins, its verdict); nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        of, _, rest = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character; work is the length times the number of distinct ASCII characters at most."""
    ascii_ = F.regexp_replace(text, r"[^\x00-\x7F]", "\u0080")
    n = F.length(text)
    bits = lambda k: -(k / n) * F.log2(k / n)
    each = F.filter(F.array_distinct(F.split(ascii_, "")), lambda c: c != "")
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda a, c: a + bits(n - F.length(F.replace(ascii_, c, F.lit("")))))).otherwise(0.0)


def lexical(df: DataFrame, url: str) -> DataFrame:
    """Adds host, path, the lexical features and the values that statistics go by, for a frame without such columns."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    df = df.withColumn("host", host_of(u)).withColumn("path", path_of(u))
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    n = F.length(u)
    labels = F.split("host", r"\.", -1)
    return df.withColumns(
        {
            "n_url": n.cast("double"),
            "n_host": F.length("host").cast("double"),
            "n_path": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/", -1), lambda s: s != "")).cast("double"),
            "digits": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0),
            "entropy": entropy(u),
            "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]", -1))).cast("double"),
            "last_label": F.element_at(labels, -1),
            "last_two": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
            "first_segment": F.coalesce(F.get(F.split("path", "/", -1), F.lit(1)), F.lit("")),
        }
    )


@dataclass
class Model:
    """What ``fit`` has learned: the trees (None: the constant ``share`` decides), and a table of each statistic."""

    trees: GBTClassificationModel | None
    share: float
    statistics: dict[str, DataFrame]


def _statistics(labelled: DataFrame, name: str, share: float) -> DataFrame:
    counts = labelled.groupBy(name).agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    return stored(counts.select(name, ((F.col("blocked") + PRIOR * share) / (F.col("n") + PRIOR)).alias(f"{name}_share")), f"url-{name}")


def _with_statistics(df: DataFrame, model: Model) -> DataFrame:
    for name, shares in model.statistics.items():
        df = df.join(shares, name, "left").withColumn(f"{name}_share", F.coalesce(f"{name}_share", F.lit(model.share)))
    return df


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*LEXICAL, *(f"{n}_share" for n in STATISTICS)], outputCol="features").transform(df)


def fit(labelled: DataFrame) -> Model:
    """From ``url`` and ``label`` (1: block, 0: allow).  A url with both labels takes part with each."""
    rows = lexical(labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label")).distinct(), "url")
    halves = rows.withColumn("half", F.crc32(F.col("url").cast("binary")) % 2)
    n = {(r["half"], r["label"]): r["count"] for r in halves.groupBy("half", "label").count().collect()}
    total = sum(n.values())
    share = sum(v for (_, label), v in n.items() if label) / total if total else 0.0
    learn = halves.where("half = 0")
    model = Model(None, share, {name: _statistics(learn, name, share) for name in STATISTICS})
    if any((1, label) not in n for label in (0.0, 1.0)):
        return model
    chosen = F.shiftrightunsigned(F.xxhash64("url"), 11) / F.lit(2.0**53) < F.lit(min(1.0, SAMPLE / (n[1, 0.0] + n[1, 1.0])))
    sample = stored(_with_statistics(halves.where("half = 1").where(chosen), model).select("label", *LEXICAL, *(f"{s}_share" for s in STATISTICS)).repartition(2), "url-sample")
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=BINS, seed=1)
    return Model(trees.fit(_vectors(sample)), share, model.statistics)


def judge(df: DataFrame, model: Model, rules=RULES, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict (allow or block) and score (of the trees, 0 to 1, higher: block likelier; for every url)."""
    keep = [c for c in df.columns if c.lower() not in RESULTS]
    packed = df.select(F.struct(*keep).alias("row"), F.col(url).alias("url"))
    rows = lexical(packed, "url")
    if model.trees:
        scored = model.trees.transform(_vectors(_with_statistics(rows, model))).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = rows.withColumn("score", F.lit(model.share))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")
    return scored.select("row.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")


def labelled_by(df: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """url, label of the rows that a rule fits."""
    _, verdict = rule_of(host_of(F.col(url)), path_of(F.col(url)), rules)
    return df.select(F.col(url).alias("url"), (verdict == "block").cast("double").alias("label")).where("label is not null")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labelled_by(pages))).select("page_id", "host", "path", "rule", "verdict", "score")
