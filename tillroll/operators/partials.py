"""Summaries that merge: exact partial sums, and distinct counts as bitmaps.

Reports on the lines of several extracts follow from the summaries of each, merged in
any order, without the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tillroll.functions import (
    divide_rounded,
    exact_as,
    exact_revenue_sum,
    exact_sum,
    month_start,
)
from tillroll.operators.quality import clean_sales
from tillroll.operators.windows import numbered

GRAIN = ("month", "country", "customerid")
# All decimals of the line values, and digits for any sum of them.
_TOTAL_DIGITS = 38


def revenue_partials(df: DataFrame) -> DataFrame:
    """Exact clean revenue, units and lines by month, country and customer."""
    month = month_start(F.col("invoicedate")).alias("month")
    total = exact_revenue_sum(df)
    clean = clean_sales(df)
    made = clean.groupBy(month, "country", "customerid").agg(
        total.alias("revenue"),
        F.sum("quantity").alias("units"),
        F.count(F.lit(1)).alias("lines"),
    )
    kind = made.schema["revenue"].dataType
    whole = T.DecimalType(_TOTAL_DIGITS, kind.scale)
    return made.withColumn("revenue", exact_as(F.col("revenue"), whole, "revenue"))


def merge_partials(*parts: DataFrame) -> DataFrame:
    """The partial sums of all lines behind some partial sums."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    kind = whole.schema["revenue"].dataType
    return whole.groupBy(*GRAIN).agg(
        exact_as(exact_sum(F.col("revenue")), kind, "revenue").alias("revenue"),
        F.sum("units").alias("units"),
        F.sum("lines").alias("lines"),
    )


def revenue_from_partials(partials: DataFrame, *by: str) -> DataFrame:
    """Revenue by some of ``month``, ``country`` and ``customerid``, rounded once at the end."""
    rounded = F.round(exact_sum(F.col("revenue")), 2).alias("total_revenue")
    made = partials.groupBy(*by).agg(rounded)
    if "month" in by:
        made = made.withColumn("month", F.col("month").cast("timestamp_ntz"))
    return made


def new_invoice_numbers(df: DataFrame, known: DataFrame, first: int) -> DataFrame:
    """Numbers from ``first`` on for the clean invoices not in ``known`` (``invoiceno``, ``number``).

    They are given over ranges sorted by country and month, so the invoices of both lie close
    together: a bitmap holds many of them, and there are few bitmaps. An invoice with lines in
    several goes by the smallest of each.
    """
    month = month_start(F.col("invoicedate"))
    fresh = (
        clean_sales(df)
        .groupBy("invoiceno")
        .agg(F.min("country").alias("_country"), F.min(month).alias("_month"))
        .join(known, "invoiceno", "left_anti")
    )
    return numbered(fresh, ["_country", "_month", "invoiceno"], "number").select(
        "invoiceno", (F.col("number") + F.lit(first)).alias("number")
    )


def invoice_bitmaps(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """The clean invoices of each country and month as bitmaps over their numbers.

    A row holds the numbers of one bucket of 32,768. A country's rows are spread over its
    months and buckets, so one with most invoices is in many tasks. The numbers are shuffled,
    at most 32,768 for a row, and made into bitmaps once they are together: a bitmap takes
    4 KB however few invoices it holds, so no task makes one for its share of a bucket.
    """
    month = month_start(F.col("invoicedate")).alias("month")
    sold = clean_sales(df).select("invoiceno", "country", month).distinct()
    return (
        sold.join(numbers, "invoiceno")
        .select("country", "month", F.bitmap_bucket_number("number").alias("bucket"), "number")
        .repartition("country", "month", "bucket")
        .groupBy("country", "month", "bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("invoices"))
    )


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """The bitmaps of all lines behind some bitmaps."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("country", "month", "bucket").agg(
        F.bitmap_or_agg("invoices").alias("invoices")
    )


def invoices_from_bitmaps(bitmaps: DataFrame, *by: str) -> DataFrame:
    """Distinct invoices by country, month, both or neither; an invoice counts once in each.

    Bitmaps of a group are united per bucket first, then their sizes are added up.
    """
    united = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("invoices").alias("invoices"))
    return united.groupBy(*by).agg(
        F.coalesce(F.sum(F.bitmap_count("invoices")), F.lit(0)).alias("unique_invoices")
    )


def avg_order_value_from(partials: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Clean revenue per distinct invoice in each country, from the summaries alone."""
    revenue = revenue_from_partials(partials, "country")
    counts = invoices_from_bitmaps(bitmaps, "country").withColumnRenamed("country", "_country")
    average = divide_rounded(F.col("total_revenue"), F.col("unique_invoices"))
    return revenue.join(counts, F.col("country").eqNullSafe(F.col("_country"))).select(
        "country",
        average.alias("avg_order_value"),
        F.col("unique_invoices").alias("unique_invoice_total"),
    )
