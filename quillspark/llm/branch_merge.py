"""Three-way merge of two branches of a document table by sparse edit logs.

A branch is known by its log: one entry for each unit that it changes, keyed by document and unit,
and nothing for what it leaves alone.  Units of a document are its row, its columns, its lines, the
gaps after its lines, and a whole row that the branch adds.  ``merge`` outer-joins the two logs on
(document, unit), classifies each pair of entries, gathers the resolved patches of a document, and
applies them to its base row.

Pairs: a change of one branch, or the same change of both, is one clean unit.  Different changes are one
conflict, resolved to the right branch's state: ``edit_delete`` where one of them drops the line,
``insert_insert`` for gaps and added rows, else ``edit_edit``.  A dropped row counts alone: as ``edit_delete`` if the other
branch keeps the row and changes a column, line or gap of it, else as clean.

Everything is a DataFrame operation; nothing is broadcast by request and nothing goes to the driver.  The logs are dealt by
(document, unit), so a document with very many lines is spread; its patches meet only where its own
text is.  The sizes that one task holds are those of single documents.

Defined results: a null text or column is empty, a null id is the id named by the empty text.  An id that
repeats is one document, of its least (text, lang, source).  A log with several entries for a unit has the least of
them.  An added row whose id the base has too is returned beside it.  Patches of lines that a document doesn't have do not apply,
but count; a document that the base lacks takes only added rows.  Empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

COLUMNS = ("lang", "source")
#: kind: row, lang, source, line, gap, added.  op: drop, set (text: the column's new value), append, insert, add (a row of text, lang, source).
STATE = "struct<op:string,text:string,lang:string,source:string>"
LOG = f"doc string, kind string, line int, state {STATE}"
KEY = ["doc", "kind", "line"]
COUNTS = ("clean", "edit_edit", "edit_delete", "insert_insert")


def key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def tidy_base(docs: DataFrame) -> DataFrame:
    """doc, text, lang, source: one row for each id, without nulls."""
    rows = docs.select(key(F.col("doc_id")).alias("doc"), F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *COLUMNS))).alias("row"))
    return rows.groupBy("doc").agg(F.min("row").alias("row")).select("doc", "row.*")


def state(op: str, text: Column | None = None, lang: Column | None = None, source: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(op).alias("op"), *((null if v is None else v).alias(n) for n, v in (("text", text), ("lang", lang), ("source", source))))


def coded_log(base: DataFrame, branch: str, new_id) -> DataFrame:
    """The log of a branch whose edits are chosen by crc32(``branch:doc:name``) mod 7 for each unit's name.

    Row: 0 drops it, 3 and 4 add a row (``new_id``: id column -> id) of text ``!`` or ``?``.  Columns: 0
    empties, 1 and 2 append.  Lines: 0 drops, 1 and 2 append, 3 and 4 insert a line after.  A column
    that keeps its value has no entry.
    """
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    units = base.withColumn("unit", F.explode(F.concat(F.array(*map(F.lit, (-3, -2, -1))), F.sequence(F.lit(0), n - 1))))
    u = F.col("unit")
    name = F.when(u == -3, F.lit("row")).when(u == -2, F.lit("lang")).when(u == -1, F.lit("source")).otherwise(u.cast("string"))
    units = units.withColumn("name", name).withColumn("code", F.crc32(F.concat(F.lit(f"{branch}:"), "doc", F.lit(":"), "name").cast("binary")) % 7).where("code < 5")
    code = F.col("code")
    mark = F.when(code.isin(1, 3), F.lit("!")).otherwise(F.lit("?"))
    value = F.when(u == -2, F.col("lang")).otherwise(F.col("source"))
    row = F.when(code == 0, state("drop")).when(code.isin(3, 4), state("add", mark, F.col("lang"), F.col("source")))
    column = F.when((code == 0) & (value != ""), state("set", F.lit(""))).when(code.isin(1, 2), state("set", F.concat(value, mark)))
    line = F.when(code == 0, state("drop")).when(code.isin(1, 2), state("append", mark)).otherwise(state("insert", mark))
    added = (u == -3) & (code != 0)
    inserted = (u >= 0) & (code > 2)
    return units.select(
        F.when(added, key(new_id(F.when(F.col("doc") != "", F.col("doc")).cast("long")))).otherwise(F.col("doc")).alias("doc"),
        F.when(added, "added").when(inserted, "gap").when(u >= 0, "line").otherwise(F.col("name")).alias("kind"),
        F.greatest(u, F.lit(0)).alias("line"),
        F.when(u == -3, row).when(u < 0, column).otherwise(line).cast(STATE).alias("state"),
    ).where("state is not null")


def _one_entry(log: DataFrame, side: str) -> DataFrame:
    return log.groupBy(*KEY).agg(F.min("state").alias(side))


def classified(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc, kind, line, l, r, pair: the outer join of the logs; ``pair`` is one of ``COUNTS``, null for a dropped row."""
    both = _one_entry(left, "l").join(_one_entry(right, "r"), KEY, "full_outer")
    drops = F.coalesce(F.col("l.op") == "drop", F.lit(False)) | F.coalesce(F.col("r.op") == "drop", F.lit(False))
    pair = (
        F.when(F.col("kind") == "row", None)
        .when(F.col("l").isNull() | F.col("r").isNull() | (F.col("l") == F.col("r")) | F.col("l").eqNullSafe(F.col("r")), "clean")
        .when(F.col("kind").isin("gap", "added"), "insert_insert")
        .when(drops, "edit_delete")
        .otherwise("edit_edit")
    )
    return both.withColumn("pair", pair)


def patches(pairs: DataFrame) -> DataFrame:
    """One row for each document of the logs: what each branch drops and changes, the pairs counted, and the units with both states."""
    inner = ~F.col("kind").isin("row", "added")
    return pairs.groupBy("doc").agg(
        F.coalesce(F.bool_or((F.col("kind") == "row") & F.col("l").isNotNull()), F.lit(False)).alias("l_drops"),
        F.coalesce(F.bool_or((F.col("kind") == "row") & F.col("r").isNotNull()), F.lit(False)).alias("r_drops"),
        F.count_if(inner & F.col("l").isNotNull()).alias("l_changes"),
        F.count_if(inner & F.col("r").isNotNull()).alias("r_changes"),
        *(F.count_if(inner & (F.col("pair") == c)).alias(c) for c in COUNTS),
        F.collect_list(F.when(F.col("kind") != "row", F.struct("kind", "line", "l", "r", "pair"))).alias("units"),
    )


def _patched_text(text: Column, chosen: Column) -> tuple[Column, Column]:
    """(lines and patches in one array, in order of line and kind; that array's text).  The second refers to the first as column ``pieces``."""
    piece = lambda line, kind, text, drop: F.struct(line.cast("int").alias("line"), F.lit(kind).alias("kind"), text.alias("text"), drop.alias("drop"))
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: piece(i, 0, x, F.lit(False)))
    of = lambda kind, k: F.transform(F.filter(chosen, lambda u: u["kind"] == kind), lambda u: piece(u["line"], k, F.coalesce(u["state"]["text"], F.lit("")), u["state"]["op"] == "drop"))
    beyond = F.filter(F.concat(of("line", 1), of("gap", 2)), lambda p: p["line"] < F.size(F.split(text, "\n", -1)))

    def out(x, j):
        after = F.get("pieces", j + 1)
        edited = (after["line"] == x["line"]) & (after["kind"] == 1)
        line = F.when(edited & after["drop"], None).when(edited, F.concat(x["text"], after["text"])).otherwise(x["text"])
        return F.when(x["kind"] == 0, line).when(x["kind"] == 2, x["text"])

    return F.array_sort(F.concat(lines, beyond)), F.array_join(F.transform("pieces", out), "\n")


def merge(docs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_clean, n_edit_edit, n_edit_delete, n_insert_insert for every id ever present; a dropped row has nulls.

    ``docs``: doc_id, text, lang, source.  ``left``, ``right``: logs (``LOG``).
    """
    return merged(tidy_base(docs), left, right, docs.schema["doc_id"].dataType)


def merged(base: DataFrame, left: DataFrame, right: DataFrame, id_type) -> DataFrame:
    no_units = F.expr(f"cast(array() as array<struct<kind:string,line:int,l:{STATE},r:{STATE},pair:string>>)")
    both = base.withColumn("in_base", F.lit(True)).join(patches(classified(left, right)), "doc", "full_outer")
    for c in ("l_drops", "r_drops", "in_base"):
        both = both.withColumn(c, F.coalesce(c, F.lit(False)))
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("l_changes", "r_changes", *COUNTS)} | {"units": F.coalesce("units", no_units)})
    drops = F.col("l_drops") | F.col("r_drops")
    against = (F.col("l_drops") & ~F.col("r_drops") & (F.col("r_changes") > 0)) | (F.col("r_drops") & ~F.col("l_drops") & (F.col("l_changes") > 0))
    both = both.withColumns({"drops": drops, "against": against, "gone": F.col("r_drops") | (F.col("l_drops") & ~against)})
    # The left branch dropped a row that the right one keeps and changed: its state is the right one's.
    right_only = F.col("drops") & ~F.col("gone")
    chosen = F.filter(F.transform("units", lambda u: F.struct(u["kind"].alias("kind"), u["line"].alias("line"), F.when(right_only, u["r"]).otherwise(F.coalesce(u["r"], u["l"])).alias("state"))), lambda u: u["state"].isNotNull())
    both = both.withColumn("chosen", chosen)
    pieces, text = _patched_text(F.coalesce("text", F.lit("")), F.col("chosen"))
    both = both.withColumn("pieces", pieces).withColumn("patched", text)

    def column(c: str) -> Column:
        set_to = F.filter("chosen", lambda u: u["kind"] == c)
        return F.coalesce(F.get(set_to, F.lit(0))["state"]["text"], F.col(c))

    def row(present: Column, values: dict[str, Column], counts: dict[str, Column]) -> Column:
        return F.struct(*(F.when(present, v).cast("string").alias(n) for n, v in values.items()), *(counts[c].cast("long").alias(f"n_{c}") for c in COUNTS))

    alone = {"clean": ~F.col("against"), "edit_delete": F.col("against")}
    own = row(~F.col("gone"), {"text": F.col("patched"), **{c: column(c) for c in COLUMNS}}, {c: F.when(F.col("drops"), alone.get(c, F.lit(False)).cast("long")).otherwise(F.col(c)) for c in COUNTS})
    new = F.transform(
        F.filter("units", lambda u: u["kind"] == "added"),
        lambda u: row(F.lit(True), {n: F.coalesce(u["r"], u["l"])[n] for n in ("text", *COLUMNS)}, {c: (u["pair"] == c).cast("long") for c in COUNTS}),
    )
    rows = F.concat(F.when(F.col("in_base"), F.array(own)).otherwise(F.filter(F.array(own), lambda _: F.lit(False))), new)
    return both.select(F.when(F.col("doc") != "", F.col("doc")).cast(id_type).alias("doc_id"), F.inline(rows))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = tidy_base(docs)
    left, right = (coded_log(base, b, lambda d: F.lit(-1) - d) for b in "LR")
    out = merged(base, left, right, docs.schema["doc_id"].dataType)
    return out.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), *(f"n_{c}" for c in COUNTS))


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({k}) + 1), lambda i: ascii(substr({k}, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""

ORACLE = f"""
WITH b AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(text, ''), coalesce(lang, ''), coalesce(source, '')) = 1
), n AS (
  SELECT *, unnest(['row', 'lang', 'source'] || list_transform(range(len(string_split(t, chr(10)))), lambda i: i::VARCHAR)) AS name FROM b
), kl AS (
  SELECT *, 'L:' || k || ':' || name AS a, 'R:' || k || ':' || name AS z FROM n
), c AS (
  SELECT *, ({_CRC.format(k="a")}) % 7 AS l, ({_CRC.format(k="z")}) % 7 AS r FROM kl
), x AS (
  SELECT *, try_cast(name AS INT) AS line FROM c
), u AS (
  SELECT doc_id, line, name, t, lang, source, l, r,
         CASE WHEN name = 'row' THEN NULL
              WHEN line IS NULL THEN (l < 3 AND NOT (l = 0 AND (CASE name WHEN 'lang' THEN lang ELSE source END) = ''))
              ELSE l < 3 END AS le,
         CASE WHEN name = 'row' THEN NULL
              WHEN line IS NULL THEN (r < 3 AND NOT (r = 0 AND (CASE name WHEN 'lang' THEN lang ELSE source END) = ''))
              ELSE r < 3 END AS re,
         line IS NOT NULL AND l IN (3, 4) AS lg, line IS NOT NULL AND r IN (3, 4) AS rg,
         CASE WHEN line IS NOT NULL THEN string_split(t, chr(10))[line + 1] END AS s
  FROM x
), d AS (
  SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source,
         max((name = 'row' AND l = 0)::INT) AS ld, max((name = 'row' AND r = 0)::INT) AS rd,
         max(CASE WHEN name = 'row' THEN l END) AS rl, max(CASE WHEN name = 'row' THEN r END) AS rr,
         count(*) FILTER (WHERE le OR lg) AS lc, count(*) FILTER (WHERE re OR rg) AS rc,
         count(*) FILTER (WHERE (le OR re) AND (NOT le OR NOT re OR l = r)) + count(*) FILTER (WHERE (lg OR rg) AND (NOT lg OR NOT rg OR l = r)) AS clean,
         count(*) FILTER (WHERE le AND re AND l <> r AND NOT (line IS NOT NULL AND (l = 0 OR r = 0))) AS ee,
         count(*) FILTER (WHERE le AND re AND l <> r AND line IS NOT NULL AND (l = 0 OR r = 0)) AS ed,
         count(*) FILTER (WHERE lg AND rg AND l <> r) AS ii,
         max(CASE WHEN name = 'lang' THEN CASE WHEN re THEN r WHEN le THEN l ELSE 9 END END) AS cl, max(CASE WHEN name = 'lang' THEN CASE WHEN re THEN r ELSE 9 END END) AS clr,
         max(CASE WHEN name = 'source' THEN CASE WHEN re THEN r WHEN le THEN l ELSE 9 END END) AS cs, max(CASE WHEN name = 'source' THEN CASE WHEN re THEN r ELSE 9 END END) AS csr,
         string_agg(nullif(CASE CASE WHEN re THEN r WHEN le THEN l ELSE 9 END WHEN 0 THEN '' WHEN 1 THEN s || '!' || chr(10) WHEN 2 THEN s || '?' || chr(10) ELSE s || chr(10) END
           || CASE CASE WHEN rg THEN r WHEN lg THEN l ELSE 9 END WHEN 3 THEN '!' || chr(10) WHEN 4 THEN '?' || chr(10) ELSE '' END, ''), '' ORDER BY line) AS tb,
         string_agg(nullif(CASE CASE WHEN re THEN r ELSE 9 END WHEN 0 THEN '' WHEN 1 THEN s || '!' || chr(10) WHEN 2 THEN s || '?' || chr(10) ELSE s || chr(10) END
           || CASE CASE WHEN rg THEN r ELSE 9 END WHEN 3 THEN '!' || chr(10) WHEN 4 THEN '?' || chr(10) ELSE '' END, ''), '' ORDER BY line) AS tr
  FROM u GROUP BY doc_id
), e AS (
  SELECT *, ld = 1 OR rd = 1 AS drops, (ld = 1 AND rd = 0 AND rc > 0) OR (rd = 1 AND ld = 0 AND lc > 0) AS against FROM d
), f AS (
  SELECT *, rd = 1 OR (ld = 1 AND NOT against) AS gone FROM e
)
SELECT doc_id,
       CASE WHEN NOT gone THEN CASE CASE WHEN drops THEN clr ELSE cl END WHEN 0 THEN '' WHEN 1 THEN lang || '!' WHEN 2 THEN lang || '?' ELSE lang END END AS lang,
       CASE WHEN NOT gone THEN CASE CASE WHEN drops THEN csr ELSE cs END WHEN 0 THEN '' WHEN 1 THEN source || '!' WHEN 2 THEN source || '?' ELSE source END END AS source,
       CASE WHEN NOT gone THEN sha256(coalesce(regexp_replace(CASE WHEN drops THEN tr ELSE tb END, '\\n$', ''), '')) END AS text_sha256,
       CASE WHEN drops THEN (NOT against)::BIGINT ELSE clean END AS n_clean, CASE WHEN drops THEN 0 ELSE ee END AS n_edit_edit,
       CASE WHEN drops THEN against::BIGINT ELSE ed END AS n_edit_delete, CASE WHEN drops THEN 0 ELSE ii END AS n_insert_insert
FROM f
UNION ALL
SELECT -1 - doc_id, lang, source, sha256(CASE WHEN rr IN (3, 4) THEN CASE rr WHEN 3 THEN '!' ELSE '?' END WHEN rl = 3 THEN '!' ELSE '?' END),
       (rl NOT IN (3, 4) OR rr NOT IN (3, 4) OR rl = rr)::BIGINT, 0, 0, (rl IN (3, 4) AND rr IN (3, 4) AND rl <> rr)::BIGINT
FROM f WHERE rl IN (3, 4) OR rr IN (3, 4)
"""
