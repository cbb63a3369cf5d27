"""Plan-shaping helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame) -> DataFrame:
    """Projection fence: re-emit every column through ``inline`` of a
    one-element array.

    Catalyst substitutes an alias's full expression when it pushes a filter
    below a projection and when it collapses projections.  For the heavy
    text classifiers that duplicates regex work per row and makes plans
    grow combinatorially.  A filter cannot move below a Generate on columns
    the Generate produces, and projections do not collapse across it, so
    everything above the fence sees plain attributes.  Cost: one struct per
    row, no shuffle, no materialisation.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def evenly(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly to three tasks a core, before work that takes far
    longer than the rows take to move: the tasks do not follow the row groups of
    the input (a rebalance would join them up to its advisory size)."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)
