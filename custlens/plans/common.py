"""Small shared plan pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows in ``order``: planned as TakeOrderedAndProject, which keeps
    k rows per partition and merges them, so memory is bounded by k."""
    return df.orderBy(*order).limit(k)


def unpivot_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide -> long (``Metric``, ``Value``) with values as doubles."""
    wide = df.select(*ids, *[df[m].cast("double").alias(m) for m in metrics])
    return wide.unpivot(ids, metrics, "Metric", "Value")


def sort_bounded(df: DataFrame, *order: Column) -> DataFrame:
    """Order a result whose size is bounded by a dimension (weekdays, RFM
    segments, regions, calendar months, N per region).

    The bounded rows are moved into one partition and sorted there: no
    range-sampling job, and every upstream stage keeps its parallelism
    (``coalesce(1)`` would pull the producing stage into one task).  Never use
    this on customer- or fact-scale results; those use ``orderBy`` (a
    distributed range sort).
    """
    return df.repartition(1).sortWithinPartitions(*order)
