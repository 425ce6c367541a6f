"""Conversation structure repair by a lazily determinised weighted automaton.

A conversation is legal if its role initials spell ``(s?(ua)+)?``.  Edits: keep a row (0), rerole it to what is
expected (1), delete it (2; required for blank rows and repeated ones), insert an empty row (5); a truncated row that stays costs 5 more.
The automaton of the expression has four states.  Scanning a conversation from its end, the costs that are still to
come from each state form a vector; less its minimum, that vector is a state of the determinised automaton.  States and transitions
(state, symbol of the row) -> (state, cost) are made when first met and kept in a table, so a
scan is one look-up a row.  The trace goes back over the scan, from the first row on, along tight arcs (those that
attain the vectors' minima), each time the ASCII-least; it is kept in a table as well.

Rows are range-sorted by conversation and turn, so a conversation is in one partition, or goes on in the next one.  Those inside a
partition, of up to ``LONG`` rows, are repaired while the partition is read.  What touches a border of partitions, or is longer, is
passed on: its repeated rows are found by a shuffle on their text, its rows are cut into pieces of ``PIECE``
rows, only one symbol a row meets in one place (its audit is as long), and every piece is repaired on its own.  So neither a
conversation with a third of all rows nor all rows of a null id are ever gathered; ``digests`` must do so for
a conversation in several pieces, as one hash goes over all of it.

Defined results: a null role or text is one space.  Rows of a null conversation id form one conversation.  Null turns come first.
Rows of one turn are in order of the md5 of role, newline and text, so rows that are equal stand together; the first of them is no
repetition.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored, table, tidy

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a.  The role expected, and the state after it.
EXPECTED, AFTER, ACCEPTS = "uuau", (2, 2, 3, 2), (0, 3)
ROLE = {"u": "user", "a": "assistant"}
#: A row's symbol: 3 * class (s, u, a, other) + 0, 1 if truncated, or 2 if it must go.
CLASSES = "sua"
LONG, PIECE = 4096, 1024
REPAIRED = "array<struct<role:string,text:string>>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Automaton:
    """The determinised automaton, as far as it has been needed."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.steps: dict[int, tuple[int, int]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, _ = self._state([0 if q in ACCEPTS else 1 << 40 for q in range(4)])

    def _state(self, costs: list[int]) -> tuple[int, int]:
        for _ in range(3):  # an insertion leads on; three lead anywhere
            costs = [min(c, INSERT + costs[AFTER[q]]) for q, c in enumerate(costs)]
        least = min(costs)
        v = tuple(c - least for c in costs)
        if v not in self.ids:
            self.ids[v] = len(self.vectors)
            self.vectors.append(v)
        return self.ids[v], least

    @staticmethod
    def consuming(q: int, symbol: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of the edits that consume a row."""
        kind, fault = divmod(symbol, 3)
        out = [("D", DELETE, q)]
        if fault < 2:
            cut = CUT * fault
            if kind == 0 and q == 0:
                out.append(("K", KEEP + cut, 1))
            elif kind < 3 and CLASSES[kind] == EXPECTED[q]:
                out.append(("K", KEEP + cut, AFTER[q]))
            out.append(("R", REROLE + cut, AFTER[q]))
        return out

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(state before a row, cost) from the state behind it."""
        at = state * 12 + symbol
        if at not in self.steps:
            v = self.vectors[state]
            self.steps[at] = self._state([min(c + v[n] for _, c, n in self.consuming(q, symbol)) for q in range(4)])
        return self.steps[at]

    def arc(self, state: int, symbol: int, q: int) -> tuple[str, int]:
        """The letters up to and with the one that consumes the row, and the state after it."""
        key = (state, symbol, q)
        if key not in self.arcs:
            before, cost = self.step(state, symbol)
            here, behind, letters, at = self.vectors[before], self.vectors[state], "", q
            while True:
                tight = [(x, n) for x, c, n in self.consuming(at, symbol) if here[at] + cost == c + behind[n]]
                if here[at] == INSERT + here[AFTER[at]]:
                    tight.append(("I", AFTER[at]))
                letter, n = min(tight)
                letters, at = letters + letter, n
                if letter != "I":
                    break
            self.arcs[key] = letters, at
        return self.arcs[key]

    def audit(self, symbols) -> tuple[int, list[str]]:
        """Least cost, and the letters of each row (insertions before it included); those after the last row come last."""
        state, cost, behind = self.end, 0, []
        for s in reversed(symbols):
            behind.append(state)
            state, c = self.step(state, s)
            cost += c
        cost += self.vectors[state][0]
        q, letters = 0, []
        for s, state in zip(symbols, reversed(behind), strict=True):
            x, q = self.arc(state, s, q)
            letters.append(x)
        tail = ""
        while q not in ACCEPTS:
            tail, q = tail + "I", AFTER[q]
        return cost, [*letters, tail]


def apply(letters: str, q: int, rows) -> tuple[list[dict], int]:
    """The repaired rows (of pairs of role and text) by an audit's letters from a state on, and the state after them."""
    out, rows = [], iter(rows)
    for x in letters:
        role, text = ("", "") if x == "I" else next(rows)
        if x == "D":
            continue
        if x != "K":
            role = ROLE[EXPECTED[q]]
        out.append({"role": role, "text": text})
        q = 1 if q == 0 and role[:1] == "s" else AFTER[q]
    return out, q


def illegal(symbols) -> int:
    legal = {(0, 1), (1, 2), (2, 1)}
    kinds = [s // 3 for s in symbols]
    return sum(pair not in legal for pair in zip(kinds, kinds[1:], strict=False))


def _fault(text: Column) -> Column:
    """2 if blank, 1 if truncated, else 0."""
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), 2).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), 1).otherwise(0)


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls, with the md5, class and fault of each row, in order inside of range partitions."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.withColumns({"digest": F.md5(F.concat_ws("\n", "role", "text").cast("binary")), "kind": kind, "fault": _fault(F.col("text"))})
    order = ["conv_id", "turn", "digest"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").withColumn("part", F.spark_partition_id())


RAW = "part int, at long, turn long, role string, text string, digest string, kind int, fault int"
WHOLE = f"whole boolean, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired {REPAIRED}"


def _in_partition(out: pa.Schema, long: int):
    """Repairs the conversations inside a partition; rows of the others come out as they are, with their position."""
    names = [n for n in out.names if n in ("conv_id", "part", "turn", "role", "text", "digest", "kind", "fault")]

    def whole(rows: list[dict], auto: Automaton) -> dict:
        seen, symbols, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for r in rows:
            key = (r["role"], r["text"])
            fault = "blank" if r["fault"] == 2 else "duplicate" if key in seen else "truncated" if r["fault"] else None
            seen.add(key)
            if fault:
                n[fault] += 1
            symbols.append(3 * r["kind"] + {None: 0, "truncated": 1}.get(fault, 2))
        cost, letters = auto.audit(symbols)
        turns = {r["turn"] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        audit = "".join(letters)
        return {"conv_id": rows[0]["conv_id"], "part": rows[0]["part"], "at": 0, "whole": True, **n, "gaps": gaps, "illegal": illegal(symbols), "cost": cost, "audit": audit, "repaired": apply(audit, 0, ((r["role"], r["text"]) for r in rows))[0]}

    def run(batches):
        auto, held, first, passing, at = Automaton(), [], True, False, 0
        ready: list[dict] = []

        def passed(rows: list[dict]):
            nonlocal at
            for r in rows:
                ready.append(r | {"whole": False, "at": at})
                at += 1

        for batch in batches:
            for r in batch.select(names).to_pylist():
                if held and (held[0]["conv_id"] != r["conv_id"]):
                    if first or passing:
                        passed(held)
                    else:
                        ready.append(whole(held, auto))
                    held, first, passing = [], False, False
                elif len(held) >= long:
                    passed(held)
                    held, passing = [], True
                held.append(r)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, out)
                ready.clear()
        passed(held)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, out)

    return run


def _scan(out: pa.Schema):
    """For each conversation's symbols by piece: each piece's letters, and the state that it starts from."""

    def run(batches):
        auto = Automaton()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                symbols = [s for p in r["pieces"] for s in p["symbols"]]
                cost, letters = auto.audit(symbols)
                at, q = 0, 0
                for i, p in enumerate(r["pieces"]):
                    n, last = len(p["symbols"]), i == len(r["pieces"]) - 1
                    mine = "".join(letters[at : at + n + last])
                    rows.append({"conv_id": r["conv_id"], "part": p["part"], "piece": p["piece"], "audit": mine, "state": q, "cost": 0 if i else cost, "illegal": 0 if i else illegal(symbols)})
                    kinds = iter(symbols[at : at + n])
                    for x in mine:
                        kind = None if x == "I" else next(kinds) // 3
                        if x != "D":
                            q = 1 if q == 0 and x == "K" and kind == 0 else AFTER[q]
                    at += n
            yield pa.RecordBatch.from_pylist(rows, out)

    return run


def _apply(out: pa.Schema):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                repaired, _ = apply(r["audit"], r["state"], ((x["role"], x["text"]) for x in r["rows"]))
                yield pa.RecordBatch.from_pylist([{k: v for k, v in r.items() if k in out.names} | {"repaired": repaired}], out)

    return run


def _map(df: DataFrame, make, schema: StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    return df.mapInArrow(tidy(make(to_arrow_schema(schema))), schema)


def repair(rows: DataFrame, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """conv_id, part, piece, whole, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    A conversation is one row (``whole``), or several, in order of part and piece: then each has its own part of
    audit and repaired rows, and the numbers add up.  ``rows``: conv_id, turn, role, text.  Conversations of over ``long`` rows are cut
    into pieces of ``piece`` rows.
    """
    id_type = rows.schema["conv_id"].dataType
    field = lambda ddl: StructType(StructType().add("conv_id", id_type).fields + StructType.fromDDL(ddl).fields)
    done = stored(_map(marked(rows), partial(_in_partition, long=long), field(f"{RAW}, {WHOLE}")), "repair")
    result = ["conv_id", "part", "piece", "whole", *COUNTS, "audit", "repaired"]
    whole = done.where("whole").withColumn("piece", F.lit(0).cast("long")).select(result)

    raw = done.where("not whole").select("conv_id", *(f.name for f in StructType.fromDDL(RAW).fields))
    first = raw.groupBy("conv_id", "role", "text").agg(F.min(F.struct("part", "at")).alias("first"))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.text") == F.col("b.text"))
    raw = raw.alias("a").join(first.alias("b"), same).select("a.*", (F.struct("part", "at") != F.col("first")).alias("again"))
    must_go = (F.col("fault") == 2) | F.col("again")
    symbol = 3 * F.col("kind") + F.when(must_go, 2).otherwise(F.col("fault"))
    raw = raw.withColumn("symbol", symbol).withColumn("piece", F.floor(F.col("at") / piece))
    counts = raw.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.count_if(F.col("fault") == 2).alias("blank"),
        F.count_if((F.col("fault") != 2) & F.col("again")).alias("duplicate"),
        F.count_if((F.col("fault") == 1) & ~F.col("again")).alias("truncated"),
    )
    keys = ["conv_id", "part", "piece"]
    pieces = raw.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "symbol", "role", "text"))).alias("rows"))
    symbols = pieces.select("conv_id", F.struct("part", "piece", F.transform("rows", lambda r: r["symbol"]).alias("symbols")).alias("p"))
    letters = _map(symbols.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("pieces")), _scan, field("part int, piece long, audit string, state int, cost long, illegal long"))
    of_first = ("gaps", "blank", "duplicate", "truncated")
    letters = letters.alias("a").join(counts.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.*", *of_first)
    at_first = F.row_number().over(_by_conversation()) == 1
    letters = letters.withColumn("is_first", at_first).withColumns({c: F.when(F.col("is_first"), F.col(c)).otherwise(0) for c in of_first})
    both = pieces.alias("a").join(letters.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.piece") == F.col("b.piece")))
    both = both.select("a.*", "audit", "state", *COUNTS, F.lit(False).alias("whole"))
    rest = _map(both, _apply, field("part int, piece long, whole boolean, " + ", ".join(f"{c} long" for c in COUNTS) + f", audit string, repaired {REPAIRED}"))
    return whole.unionByName(rest.select(result))


def _by_conversation():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("part", "piece")


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) mod 20: 0 drops, 1 empties, 2 takes ``.!?`` away, 3 repeats, 4 makes the role user; nulls are one space."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    code = F.crc32(name.cast("binary")) % 20
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).where("code != 0")
    rows = rows.withColumn("text", F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("code") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.withColumn("_", copies).select("conv_id", "turn", "role", "text")


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: numbers, audit, and the hash of ``role:text`` of its rows, joined by newlines."""
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    rows = repaired.withColumn("lines", lines)
    digest = lambda x: F.sha2(F.array_join(x, "\n").cast("binary"), 256).alias("repaired_sha256")
    whole = rows.where("whole").select("conv_id", *COUNTS, "audit", digest(F.col("lines")))
    parts = rows.where("not whole").groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in COUNTS), F.array_sort(F.collect_list(F.struct("part", "piece", "audit", "lines"))).alias("p"))
    audit = F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit")
    return whole.unionByName(parts.select("conv_id", *COUNTS, audit, digest(F.flatten(F.transform("p", lambda x: x["lines"])))))


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = rows.select("conv_id").distinct()
    found = digests(repair(damage(rows)))
    out = ids.alias("a").join(found.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left")
    return out.select("a.conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""


def _plus(cost: str, letter: str, of: str) -> str:
    """Of a cost of eight digits followed by letters: the cost plus some, the letter put in front."""
    return f"lpad((substr({of}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || '{letter}' || substr({of}, 9)"


def _consume(q: int) -> str:
    """The cheapest edit that consumes a row in state q, without insertions, from columns v0 to v3 behind it."""
    keep = {0: f"WHEN i = 's' THEN {_plus('cut', 'K', 'v1')} WHEN i = 'u' THEN {_plus('cut', 'K', 'v2')}"}.get(q, f"WHEN i = '{EXPECTED[q]}' THEN {_plus('cut', 'K', f'v{AFTER[q]}')}")
    return f"least({_plus('2', 'D', f'v{q}')}, CASE WHEN gone THEN '~' {keep} ELSE '~' END, CASE WHEN gone THEN '~' ELSE {_plus('cut + 1', 'R', f'v{AFTER[q]}')} END)"


def _closed(level: str) -> str:
    return ", ".join(f"least({level}{q}, {_plus('5', 'I', f'{level}{AFTER[q]}')}) AS {chr(ord(level) + 1)}{q}" for q in range(4))


ORACLE = f"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), c AS (
  SELECT *, ({_CRC}) % 20 AS code FROM r
), d AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE code <> 0
), n AS (
  SELECT *, substr(role, 1, 1) AS i, row_number() OVER o AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS time,
         lead(substr(role, 1, 1)) OVER o AS after
  FROM d WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text), role, text, copy)
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN time > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM n
), g AS (
  SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE after IS NOT NULL AND i || after NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
), back AS (
  SELECT conv_id, size + 1 AS pos, '00000000' AS v0, '00000010II' AS v1, '00000005I' AS v2, '00000000' AS v3 FROM g
  UNION ALL
  SELECT conv_id, pos, {", ".join(f"d{q}" for q in range(4))} FROM (SELECT conv_id, pos, {_closed("c")} FROM (SELECT conv_id, pos, {_closed("b")} FROM (SELECT conv_id, pos, {_closed("a")} FROM (
    SELECT conv_id, pos, {", ".join(f"{_consume(q)} AS a{q}" for q in range(4))} FROM (
      SELECT f.conv_id, f.pos, f.i, f.fault IN ('blank', 'duplicate') AS gone, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS cut, v0, v1, v2, v3
      FROM back JOIN f ON f.conv_id IS NOT DISTINCT FROM back.conv_id AND f.pos = back.pos - 1)))))
), best AS (
  SELECT conv_id, substr(v0, 1, 8)::BIGINT AS cost, substr(v0, 9) AS audit FROM back WHERE pos = 1
), walk AS (
  SELECT conv_id, audit, 0 AS step, 0 AS used, 'x' AS last, NULL::VARCHAR AS line FROM best
  UNION ALL
  SELECT conv_id, audit, step + 1, used + (x <> 'I')::INT, CASE WHEN x = 'D' THEN last WHEN x = 'K' THEN i ELSE want END,
         CASE WHEN x = 'D' THEN NULL ELSE CASE WHEN x = 'K' THEN role ELSE CASE want WHEN 'u' THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END END
  FROM (SELECT walk.conv_id, audit, step, used, last, substr(audit, step + 1, 1) AS x, CASE WHEN last = 'u' THEN 'a' ELSE 'u' END AS want, f.i, f.role, f.text
        FROM walk LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.pos = used + 1 WHERE step < length(audit))
), text AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY step) AS t FROM walk GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM o.conv_id
"""
