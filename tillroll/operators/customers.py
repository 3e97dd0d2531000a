"""Customer spend: top customers and spend quartiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.functions import rounded_revenue_sum
from tillroll.operators.explore import top_k
from tillroll.operators.quality import clean_sales
from tillroll.operators.windows import exact_ntile, pct_of_total


def top_customers(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` highest-spending pairs of customer and country.

    A customer who buys from two countries counts as two.
    """
    spend = (
        clean_sales(df)
        .groupBy("customerid", "country")
        .agg(rounded_revenue_sum(df).alias("total_revenue"))
    )
    return top_k(spend, ["-total_revenue", "customerid", "country"], n)


def customer_revenue(df: DataFrame) -> DataFrame:
    """Clean revenue per customer, over all countries."""
    return (
        clean_sales(df)
        .groupBy("customerid")
        .agg(rounded_revenue_sum(df).alias("total_revenue"))
    )


def customer_quartiles(df: DataFrame, k: int = 4) -> DataFrame:
    """Customers in ``k`` groups of equal size, highest spend in group 1.

    The lower customer id goes first where totals tie. Runs a job at once,
    which writes the sorted customers to the shared folder.
    """
    order = ["-total_revenue", "customerid"]
    return exact_ntile(customer_revenue(df), k, order, "rev_quartiles")


def quartile_summary(quartiles: DataFrame) -> DataFrame:
    """Customers and revenue in each quartile."""
    return quartiles.groupBy("rev_quartiles").agg(
        F.count("customerid").alias("customer_count"),
        F.round(F.sum("total_revenue"), 2).alias("quartile_revenue"),
    )


def quartile_share(quartiles: DataFrame) -> DataFrame:
    """Revenue of each quartile and its percentage of the total."""
    summary = quartile_summary(quartiles).select("rev_quartiles", "quartile_revenue")
    return pct_of_total(summary, "quartile_revenue")
