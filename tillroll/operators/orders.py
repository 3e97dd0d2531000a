"""Order values: averages per country and invoice size buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tillroll.functions import (
    DOUBLE_PRICE_TYPE,
    divide_rounded,
    exact_as,
    exact_revenue_sum,
    month_start,
    rounded_revenue_sum,
)
from tillroll.operators.quality import clean_sales
from tillroll.operators.windows import pct_of_total
from tillroll.schema import INVOICE_BUCKETS


def avg_order_value(df: DataFrame, with_counts: bool = False) -> DataFrame:
    """Clean revenue per distinct invoice in each country.

    The one distinct count makes Spark aggregate by country and invoice before
    country, so a dominant country is spread over all tasks.
    """
    totals = (
        clean_sales(df)
        .groupBy("country")
        .agg(
            F.countDistinct("invoiceno").alias("unique_invoice_total"),
            rounded_revenue_sum(df).alias("total_revenue"),
        )
    )
    average = divide_rounded(F.col("total_revenue"), F.col("unique_invoice_total"))
    columns = ["country", average.alias("avg_order_value")]
    return totals.select(*columns, *(["unique_invoice_total"] if with_counts else []))


def _bucket(value: Column) -> Column:
    result = None
    for name, low, high in INVOICE_BUCKETS:
        tests = [] if low is None else [value >= low]
        tests += [] if high is None else [value < high]
        inside = tests[0] if len(tests) == 1 else tests[0] & tests[1]
        result = F.when(inside, name) if result is None else result.when(inside, name)
    return result


def invoice_buckets(df: DataFrame) -> DataFrame:
    """Each clean invoice with its value and size bucket."""
    return (
        clean_sales(df)
        .groupBy("invoiceno")
        .agg(rounded_revenue_sum(df).alias("total_invoice_value"))
        .withColumn("revenue_buckets", _bucket(F.col("total_invoice_value")))
    )


def invoice_bucket_counts(df: DataFrame) -> DataFrame:
    """Invoices in each size bucket."""
    return (
        invoice_buckets(df)
        .groupBy("revenue_buckets")
        .agg(F.count("revenue_buckets").alias("bucket_count"))
    )


def invoice_bucket_share(df: DataFrame) -> DataFrame:
    """Invoices in each size bucket and their percentage of all invoices."""
    counts = (
        invoice_buckets(df)
        .groupBy("revenue_buckets")
        .agg(F.count(F.lit(1)).alias("bucket_count"))
    )
    return pct_of_total(counts, "bucket_count")


# Digits for the money of one invoice; they leave room for a quantity beside it.
_INVOICE_DIGITS = 28


def invoice_grain(df: DataFrame) -> DataFrame:
    """Clean revenue by invoice, customer, country and month, shaped as lines.

    Each row is one unit at a price that is the exact sum, so every report on revenue
    by month, country, invoice or customer gives the same result on it as on the
    lines: sums of sums are exact, and rounding comes after. Country counts of invoices
    are kept as well. What is below a line's level (products, quantities) is gone. The sums
    have all decimals of the prices; one too long for 28 digits is an error.
    """
    price_type = df.schema["unitprice"].dataType
    decimal = price_type if isinstance(price_type, T.DecimalType) else DOUBLE_PRICE_TYPE
    kind = T.DecimalType(_INVOICE_DIGITS, min(decimal.scale, _INVOICE_DIGITS))
    total = exact_as(exact_revenue_sum(df), kind, "invoice value").alias("unitprice")
    month = month_start(F.col("invoicedate")).cast("timestamp_ntz").alias("invoicedate")
    return (
        clean_sales(df)
        .groupBy("invoiceno", "customerid", "country", month)
        .agg(total)
        .withColumn("quantity", F.lit(1).cast("bigint"))
    )
