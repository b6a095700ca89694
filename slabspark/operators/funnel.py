"""Outcome funnels: every row has one outcome, jobs count them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_counts(labelled: DataFrame, column: str = "outcome") -> DataFrame:
    return labelled.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def outcome_row(labelled: DataFrame, outcomes: Sequence[str], column: str = "outcome") -> DataFrame:
    """Counts as one wide row, zero where an outcome did not occur."""
    return labelled.agg(F.count(F.lit(1)).alias("total"),
                        *[F.count_if(F.col(column) == o).alias(o) for o in outcomes])
