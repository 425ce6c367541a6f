"""JSON out of model output."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip

OPEN = r"(?s)^```[^\n]*\n"
BRACE = re.compile("[{}]")


def unfenced(text: Column) -> Column:
    """Without the first line and the closing fence, if the text begins with a fence; null for a fence of one line."""
    t = strip(text)
    inner = strip(F.regexp_replace(F.regexp_replace(t, OPEN, ""), r"(?s)```\s*$", ""))
    return F.when(~t.startswith("```"), t).when(t.contains("\n"), inner)


def fenced_blocks(text: Column) -> Column:
    """What stands behind each fence mark, without a json label."""
    return F.transform(F.slice(F.split(text, "```"), 2, 1_000_000), lambda p: strip(F.regexp_replace(strip(p), r"(?i)^json", "")))


@F.pandas_udf(StringType())
def first_balanced(text: pd.Series) -> pd.Series:
    """From the first brace to the one that closes it; braces count wherever they stand."""

    def one(t):
        if t is None or (start := t.find("{")) < 0:
            return None
        depth = 0
        for m in BRACE.finditer(t, start):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return t[start : m.end()]
        return None

    return text.map(one)


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; the parser alone would not mind what follows it."""
    one = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(F.try_parse_json(one).isNotNull() & (F.json_array_length(one) == 1), F.lit(False))


def valid(text: Column) -> Column:
    return F.when(is_json(text), text)


def salvage(text: Column) -> Column:
    """The text itself, its first fenced block, or its first balanced object, whichever is JSON; else null."""
    t = strip(text)
    block = strip(F.regexp_extract(t, r"(?s)```(?:json)?\s*\n?(.*?)```", 1))
    return F.coalesce(valid(t), valid(F.when(block != "", block)), valid(first_balanced(t)))


def salvage_loose(text: Column) -> Column:
    """The first fenced part that is JSON, the text itself, or all from the first brace to the last."""
    part = F.get(F.filter(fenced_blocks(text), is_json), F.lit(0))
    outer = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(part, valid(text), valid(F.when(outer != "", outer)))


def filled(parsed: Column, defaults: dict[str, object]) -> Column:
    """Struct of string fields of a JSON text, with defaults for those that are missing."""
    return F.struct(*(F.coalesce(F.get_json_object(parsed, f"$.{k}"), F.lit(v).cast("string")).alias(k) for k, v in defaults.items()))
