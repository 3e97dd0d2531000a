"""Ranking, tiling and shares that hold up when one group is very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tillroll.functions import divide_rounded, order_columns
from tillroll.session import freeze

# monotonically_increasing_id() = partition number * 2^33 + row in partition.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def pct_of_total(df: DataFrame, column: str, name: str = "pct_of_total") -> DataFrame:
    """Add the percentage of the column's grand total.

    The total is a window over all rows, so ``df`` must be a finished summary
    of a few rows (buckets, quartiles), never line items.
    """
    total = F.sum(column).over(Window.partitionBy())
    return (
        df.withColumn("_total", total)
        .withColumn(name, divide_rounded(F.col(column), F.col("_total"), scale_by=100))
        .drop("_total")
    )


def top_ranked(
    df: DataFrame, group: str, value: str, n: int = 3, method: str = "rank"
) -> DataFrame:
    """Rows whose rank by ``value``, highest first, is at most ``n`` in ``group``.

    Same result as filtering ``rank()`` or ``dense_rank()`` over a window, ties
    included, without gathering the tied rows of a group in one task. The rank
    of a row depends only on how many rows hold each larger value. So rows are
    first counted per value; each group's ``n`` largest values, which are at
    most ``n`` rows from each task, settle the ranks; and the rows fetch theirs
    in a join. That join needs no hint: AQE broadcasts the ranks once it has
    measured them small, and splits a skewed key if they are not.
    """
    if method not in ("rank", "dense_rank"):
        raise ValueError(f"unknown ranking method {method!r}")
    best_first = Window.partitionBy(group).orderBy(F.col(value).desc())
    so_far = best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = (
        df.groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("_tied"))
        .withColumn("_place", F.row_number().over(best_first))
        .filter(F.col("_place") <= n)
    )
    if method == "rank":
        ahead = F.sum("_tied").over(so_far) - F.col("_tied")
        ranks = ranks.withColumn("_place", ahead + 1).filter(F.col("_place") <= n)
    ranks = ranks.select(
        F.col(group).alias("_group"),
        F.col(value).alias("_value"),
        F.col("_place").cast("bigint").alias("ranking"),
    )
    return df.join(
        ranks,
        F.col(group).eqNullSafe(F.col("_group")) & F.col(value).eqNullSafe(F.col("_value")),
    ).drop("_group", "_value")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the row's place in the order, from 0 without gaps, without one task for all rows.

    Rows are range-partitioned and sorted, numbered within their partition and written once,
    which fixes the numbers; the rows ahead of each partition are added from a table of one
    row per partition. Among rows equal in ``order`` the places are arbitrary.
    """
    sorted_ = _sorted_ranges(df, order, "numbered")
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit(_ROW_MASK))
    return sorted_.join(F.broadcast(_range_starts(sorted_)), "_partition").select(
        *df.columns, place.alias(name)
    )


def _sorted_ranges(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """The rows in sorted ranges, written once, with ``_partition`` and ``_id``."""
    by = order_columns(order)
    stored = freeze(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id()),
        label,
    )
    return stored.withColumn("_partition", F.shiftright("_id", _ROW_BITS))


def _range_starts(ranges: DataFrame) -> DataFrame:
    """``_start``, the rows ahead of each range, and ``_total``, all rows."""
    earlier = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.groupBy(F.shiftright("_id", _ROW_BITS).alias("_partition"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_partition",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
            F.sum("_rows").over(Window.partitionBy()).alias("_total"),
        )
    )


def with_running_values(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    running: str = "running_total",
    previous: str = "previous",
) -> DataFrame:
    """``sum(value)`` over all rows so far and ``lag(value, 1, 0)``, at any number of rows.

    A window without a partition key takes all rows through one task. Here they are
    cut into sorted ranges, written once; within a range the window is partitioned by it,
    and what earlier ranges carry over, their total and their last value, comes from a
    table of one row per range, small enough to broadcast whatever the size of the data.
    ``order`` must end in a unique key. A NULL value adds nothing; the first row has 0
    before it.
    """
    ranges = _sorted_ranges(df, order, "running")
    here = Window.partitionBy("_partition").orderBy("_id")
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranges.groupBy("_partition")
        .agg(F.sum(value).alias("_sum"), F.max(F.struct("_id", value)).alias("_end"))
        .select(
            F.col("_partition").alias("_range"),
            F.sum("_sum").over(earlier).alias("_before"),
            F.col(f"_end.{value}").alias("_end"),
            F.row_number().over(Window.orderBy("_partition")).alias("_n"),
        )
    )
    # Every range has rows, so the last value before a range is that of the one ahead.
    last = Window.orderBy("_range")
    carried = carried.withColumn("_last", F.lag("_end", 1).over(last))
    joined = ranges.join(F.broadcast(carried), F.col("_partition") == F.col("_range"))
    inside = F.sum(value).over(so_far)
    total = F.when(
        inside.isNull() & F.col("_before").isNull(), F.lit(None)
    ).otherwise(F.coalesce("_before", F.lit(0)) + F.coalesce(inside, F.lit(0)))
    first_here = F.row_number().over(here) == 1
    before = F.when(
        first_here, F.when(F.col("_n") == 1, F.lit(0)).otherwise(F.col("_last"))
    ).otherwise(F.lag(value, 1).over(here))
    return joined.select(*df.columns, total.alias(running), before.alias(previous))


def exact_ntile(df: DataFrame, k: int, order: Sequence[str], name: str) -> DataFrame:
    """``ntile(k)`` over the whole table without moving it into one task.

    ``order`` lists column names, ``-`` for descending, and must end in a unique
    key. The rows are range-partitioned and sorted,
    numbered within their partition, and written once so that the numbers stay
    fixed. The rows ahead of each partition follow from the partition sizes,
    a table of one row per range partition whatever the size of the data, which is
    why it may be broadcast. Position and row count then give the tile: with
    ``size, extra = divmod(rows, k)`` the first ``extra`` tiles hold
    ``size + 1`` rows and the others ``size``.
    """
    ranges = _sorted_ranges(df, order, "ntile")
    position = F.col("_start") + F.col("_id").bitwiseAND(F.lit(_ROW_MASK))
    size = F.expr(f"_total div {int(k)}")
    extra = F.col("_total") % int(k)
    in_larger = F.col("_position") < F.col("_extra") * (F.col("_size") + 1)
    larger = F.expr("_position div (_size + 1) + 1")
    smaller = F.expr("(_position - _extra) div greatest(_size, 1) + 1")
    return (
        ranges.join(F.broadcast(_range_starts(ranges)), "_partition")
        .withColumns({"_position": position, "_size": size, "_extra": extra})
        .withColumn(name, F.when(in_larger, larger).otherwise(smaller))
        .select(*df.columns, name)
    )
