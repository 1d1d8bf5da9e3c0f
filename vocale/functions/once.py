"""Columns that are worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns through a one-row generator.

    A later filter on a plain computed column is pushed below it and evaluates the expression
    again for every use; a filter on generated columns stays above. Costly text columns are added
    this way.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))
