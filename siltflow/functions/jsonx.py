"""JSON inside prose, and lenient reading of replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*\n(.*?)```", re.S)
#: The verdicts a reply may give when it proposes nothing.
NO_ACTION = ("already_covered", "not_a_gap", "unverified", "dropped_on_review", "unanalyzed")


#: What a scan for braces has to tell apart: a string, closed or not, and a brace.
_PIECE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)


def balanced(text: str | None) -> str | None:
    """The first balanced object of the first fenced block, or of the text; braces in strings don't count. Null if there is none."""
    text = text or ""
    if m := _FENCE.search(text):
        text = m[1]
    start, depth = text.find("{"), 0
    for m in _PIECE.finditer(text, start) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[start : m.end()]
    return None


def balanced_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(balanced)

    return run(text)


def first_of(raw: Column, *names: str) -> Column:
    """The first of the fields (snake or camel case) that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(raw, f"$.{n}")), F.lit("")) for n in names])


def no_action_kind(kind: Column) -> Column:
    return F.when(kind.isin(list(NO_ACTION)), kind).otherwise("unverified")


def valid(raw: str) -> bool:
    try:
        json.loads(raw)
        return True
    except ValueError:
        return False
