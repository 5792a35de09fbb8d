"""Offsets of evidence in texts: all of a text's items in one forward pass."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: bytes that searches from the beginning may read in one text.
BUDGET = 64 << 20


def offsets(text: bytes, evidence: list[bytes], anchors: list[bytes], budget: int = BUDGET) -> list[int]:
    """Where each item stands: at or after the place of the one before, else where it first stands, else where its anchor
    does, else 0.  The next search begins at the place found, not behind it.  A search from the beginning costs twice the
    text; when the budget is spent there are no more."""
    out, cursor = [], 0
    for item, anchor in zip(evidence, anchors, strict=True):
        at = text.find(item, cursor)
        if at < 0:
            if budget <= 0:
                out.append(0)
                continue
            budget -= 2 * len(text)
            at = text.find(item)
            at = text.find(anchor) if at < 0 else at
            if at < 0:
                out.append(0)
                continue
        cursor = at
        out.append(at)
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _located(text: pd.Series, evidence: pd.Series, anchors: pd.Series) -> pd.Series:
    plain = lambda xs: [(x or "").encode() for x in xs]
    return pd.Series([None if t is None or e is None or a is None else offsets(t.encode(), plain(e), plain(a)) for t, e, a in zip(text, evidence, anchors, strict=True)], dtype=object)


def locate(text: Column, evidence: Column, anchors: Column) -> Column:
    """The byte offset of each of an array of evidence, whose anchors are looked for where it isn't found; null for null."""
    return _located(text, evidence, anchors)
