"""First looks at a table: sizes, ranges, samples, top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillroll.functions import order_columns


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def distinct_invoices(df: DataFrame) -> DataFrame:
    """Exact number of invoices; de-duplicated before and after the shuffle."""
    return df.agg(F.countDistinct("invoiceno").alias("unique_invoices"))


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("invoicedate").alias("first_date"), F.max("invoicedate").alias("last_date")
    )


def top_k(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``, column names with ``-`` for descending.

    Each task keeps only its own ``n`` best rows, so one small merge remains.
    End ``order`` with a unique key to make ties come out the same every time.
    """
    return df.orderBy(*order_columns(order)).limit(n)


def preview(df: DataFrame, n: int = 10, order: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows to look at: any, or the first by ``order``."""
    return df.limit(n) if order is None else top_k(df, order, n)


def distinct_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()
