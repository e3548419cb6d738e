"""Evaluate long expressions once per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, keep: Sequence[str], cols: dict[str, Column]) -> DataFrame:
    """``keep`` plus computed columns behind a generator.

    A filter above a plain projection is pushed into it, and every later use may
    be merged with it, so a long pattern chain would run several times per row.
    Neither crosses a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*keep, F.inline(F.array(row)))
