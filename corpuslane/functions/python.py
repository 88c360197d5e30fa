"""The few text functions that no built-in expresses, as Arrow-batched pandas UDFs.

Null gives null in both.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def balanced_object(text: str | None) -> str | None:
    """The earliest ``{...}`` of a text whose braces balance outside string literals; None if there is none. One pass."""
    if text is None:
        return None
    open_, best, quoted, escaped = [], None, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
        elif c == '"':
            quoted = bool(open_)
        elif c == "{":
            open_.append(i)
        elif c == "}" and open_:
            start = open_.pop()
            if best is None or start < best[0]:
                best = (start, i + 1)
            if not open_:
                break
    return text[best[0] : best[1]] if best else None


def first_json_object(text: Column | str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([balanced_object(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """Ratio of matching blocks of two texts, between 0 and 1, in lower case."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else difflib.SequenceMatcher(None, s.lower(), t.lower(), autojunk=False).ratio() for s, t in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)
