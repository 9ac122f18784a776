"""Distributed global ordering, calendars and histogram bins.

A window ``ORDER BY`` without ``PARTITION BY`` runs in a single task
(``Exchange SinglePartition``).  :func:`global_rank` instead range-partitions the
rows, numbers them inside each range partition and adds per-partition offsets
from a table with one row per partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlens.config import ensure_checkpoint_dir
from custlens.functions.numeric import UNITS, exact_units, inexact_rest

_PART = "__gr_part"


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    *,
    rank_col: str = "Rank",
    count_col: str | None = None,
    sum_col: str | None = None,
    cum_col: str | None = None,
    total_col: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add the 1-based position of every row in ``order`` (a total order).

    Optional outputs: ``count_col`` (number of rows), ``cum_col`` (running sum
    of ``sum_col`` in that order, inclusive; summed exactly, so its digits do not depend
    on the partitions) and ``total_col`` (sum over all).

    Plan: range exchange on the order keys (sampled bounds, so equal-size
    partitions even when one value holds many rows, as long as the keys end in
    a unique column) -> sort within each partition and number the rows there
    (``monotonically_increasing_id`` follows the sorted row order inside a
    task) -> reliable checkpoint, which fixes the partition assignment and
    the numbering and cuts lineage (a recomputation could sample other
    bounds) -> join with the per-partition offsets, a table of at most
    ``num_partitions`` rows that is broadcast.  Only a running sum needs a
    window, partitioned by range partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id()
    staged = (
        df.repartitionByRange(n_parts, *order)
        .sortWithinPartitions(*order)
        .withColumns({
            _PART: part,
            # ids are (partition index << 33) + position within the partition
            "__gr_lrank": F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33) + 1,
        })
        .checkpoint(eager=True)
    )

    local = staged
    part_aggs = [F.count(F.lit(1)).alias("__gr_pn")]
    if sum_col is not None:
        running = (
            Window.partitionBy(_PART).orderBy("__gr_lrank")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        # Exact units and, where a value does not fit them, doubles; both 0 if absent.
        units = F.coalesce(exact_units(F.col(sum_col)), F.lit(0).cast("decimal(38,0)"))
        rest = F.coalesce(inexact_rest(F.col(sum_col)), F.lit(0.0))
        local = local.withColumns({"__gr_lcum": F.sum(units).over(running), "__gr_lrest": F.sum(rest).over(running)})
        part_aggs += [F.sum(units).alias("__gr_ps"), F.sum(rest).alias("__gr_pr")]

    # One row per range partition: bounded by n_parts, so a single-task window
    # and a broadcast are both safe here.
    parts = staged.groupBy(_PART).agg(*part_aggs)
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offset_cols = [
        F.col(_PART),
        F.coalesce(F.sum("__gr_pn").over(before), F.lit(0)).alias("__gr_off"),
        F.sum("__gr_pn").over(whole).alias("__gr_n"),
    ]
    if sum_col is not None:
        offset_cols += [
            F.coalesce(F.sum("__gr_ps").over(before), F.lit(0).cast("decimal(38,0)")).alias("__gr_soff"),
            F.sum("__gr_ps").over(whole).alias("__gr_stot"),
            F.coalesce(F.sum("__gr_pr").over(before), F.lit(0.0)).alias("__gr_roff"),
            F.sum("__gr_pr").over(whole).alias("__gr_rtot"),
        ]
    offsets = parts.select(*offset_cols)

    out = local.join(F.broadcast(offsets), _PART)
    new_cols = {rank_col: (F.col("__gr_off") + F.col("__gr_lrank")).cast("bigint")}
    if count_col:
        new_cols[count_col] = F.col("__gr_n").cast("bigint")
    if sum_col is not None and cum_col:
        new_cols[cum_col] = (F.col("__gr_soff") + F.col("__gr_lcum")).cast("double") / UNITS + (
            F.col("__gr_roff") + F.col("__gr_lrest"))
    if sum_col is not None and total_col:
        new_cols[total_col] = F.col("__gr_stot").cast("double") / UNITS + F.col("__gr_rtot")
    out = out.withColumns(new_cols)
    return out.drop(_PART, "__gr_lrank", "__gr_lcum", "__gr_lrest", "__gr_off", "__gr_n", "__gr_soff",
                    "__gr_stot", "__gr_roff", "__gr_rtot")


def quartile_of_rank(rank: Column, n: Column) -> Column:
    """Quartile label 1..4 of distinct ranks 1..n, as equal-frequency binning.

    Edges are the linearly interpolated 25/50/75 % points of 1..n, i.e.
    1 + (n-1)p, with right-closed bins: label 1 iff rank <= 1 + (n-1)/4, and so
    on.  This is not ``ntile(4)``; the two differ when n mod 4 is 2 or 3.
    """
    span = n - 1
    return (
        F.when(rank <= 1 + span * 0.25, 1)
        .when(rank <= 1 + span * 0.5, 2)
        .when(rank <= 1 + span * 0.75, 3)
        .otherwise(4)
    )


def month_spine(bounds: DataFrame, start_col: str, end_col: str, month_col: str) -> DataFrame:
    """One row per month between two month starts (inclusive) per input row.

    The number of rows produced per input row is bounded by the calendar span.
    """
    months = F.sequence(F.col(start_col), F.col(end_col), F.expr("INTERVAL 1 MONTH"))
    keep = [c for c in bounds.columns if c not in (start_col, end_col)]
    return bounds.select(*keep, F.explode(months).alias(month_col))


def fill_month_gaps(
    per_month: DataFrame, keys: list[str], month_col: str, measures: list[str]
) -> DataFrame:
    """Add zero-valued rows for months missing between each key's first and
    last month, in one pass over ``per_month`` (one row per key and month).

    The first and last month are attached with a window over the key; the row
    of each key's first month then emits every month of the span (its own with
    its values, the others with zeros) while other rows emit only themselves,
    and a sum per (key, month) merges them.  A second read of ``per_month``
    to find the bounds would be pruned differently by Catalyst and recompute
    it from the fact.  Rows per key are bounded by the calendar span.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    bounded = per_month.withColumns({
        "__fm_s": F.min(month_col).over(w),
        "__fm_e": F.max(month_col).over(w),
    })
    months = F.when(
        F.col(month_col) == F.col("__fm_s"),
        F.sequence(F.col("__fm_s"), F.col("__fm_e"), F.expr("INTERVAL 1 MONTH")),
    ).otherwise(F.array(F.col(month_col)))
    exploded = bounded.select(*keys, F.col(month_col).alias("__fm_own"), *measures,
                              F.explode(months).alias(month_col))
    own = F.col(month_col) == F.col("__fm_own")
    return exploded.groupBy(*keys, month_col).agg(*[
        F.sum(F.when(own, F.col(m)).otherwise(F.lit(0).cast(per_month.schema[m].dataType))).alias(m)
        for m in measures
    ])


def nice_step(span: float, max_bins: int) -> float:
    """Smallest step of the form {1, 2, 5} x 10^k with ceil(span/step) <= max_bins."""
    if not span or span <= 0 or math.isnan(span):
        return 1.0
    k = math.floor(math.log10(span / max_bins)) - 1
    while True:
        for m in (1, 2, 5):
            step = m * 10.0 ** k
            if math.ceil(span / step) <= max_bins:
                return step
        k += 1


def histogram(df: DataFrame, value_col: str, max_bins: int = 20) -> DataFrame:
    """Equal-width bins over ``value_col`` with at most ``max_bins`` bins.

    Bin edges are our definition (the original delegated them to a chart
    library): step from :func:`nice_step`, ``lo = floor(min/step)*step``, bins
    ``[lo + i*step, lo + (i+1)*step)`` with the maximum falling into the last
    bin.  Only non-empty bins are returned (``BinStart``, ``BinEnd``,
    ``Count``).

    The input is read once: it is reduced to counts per distinct value (partial
    aggregation; far fewer rows than the input) and that table is checkpointed.
    The extremes -- the only values brought to the driver -- and the bins are
    then computed from the checkpoint.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    value = F.col(value_col).cast("double")
    counts = (
        df.where(value.isNotNull())
        .groupBy(value.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .checkpoint(eager=True)
    )
    stats = counts.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    lo_v, hi_v = stats["lo"], stats["hi"]
    if lo_v is None:
        return spark.createDataFrame([], "BinStart double, BinEnd double, Count bigint")
    step = nice_step(hi_v - lo_v, max_bins)
    lo = math.floor(lo_v / step) * step
    n_bins = max(1, math.ceil((hi_v - lo) / step))
    idx = F.least(F.floor((F.col("_v") - F.lit(lo)) / F.lit(step)), F.lit(n_bins - 1))
    start = F.lit(lo) + idx * F.lit(step)
    return (
        counts.groupBy(start.alias("BinStart"))
        .agg(F.sum("_n").alias("Count"))
        .select("BinStart", (F.col("BinStart") + F.lit(step)).alias("BinEnd"), F.col("Count").cast("bigint"))
    )
