"""Revenue by country and by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillroll.functions import (
    exact_revenue_sum,
    month_start,
    order_columns,
    rounded_revenue_sum,
)
from tillroll.operators.quality import clean_sales
from tillroll.operators.windows import with_running_values


def revenue_by_country(df: DataFrame, scope: str = "clean") -> DataFrame:
    """Revenue per country.

    ``raw`` takes every row, cancellations included; ``positive`` keeps rows
    with a positive quantity and does not round; ``clean`` takes completed
    sales to known customers.
    """
    if scope == "raw":
        rows, total = df, rounded_revenue_sum(df)
    elif scope == "positive":
        rows, total = df.filter(F.col("quantity") > 0), exact_revenue_sum(df)
    elif scope == "clean":
        rows, total = clean_sales(df), rounded_revenue_sum(df)
    else:
        raise ValueError(f"unknown scope {scope!r}")
    return rows.groupBy("country").agg(total.alias("total_revenue"))


def monthly_revenue(df: DataFrame) -> DataFrame:
    """Clean revenue per calendar month; months without sales are absent."""
    return (
        clean_sales(df)
        .groupBy(month_start(F.col("invoicedate")).alias("month"))
        .agg(rounded_revenue_sum(df).alias("total_revenue"))
        .withColumn("month", F.col("month").cast("timestamp_ntz"))
    )


# The windows below have no partition key. They are for monthly summaries,
# which have one row per month however many lines lie behind them. Sales without
# a date make a last month, NULL.


def month_over_month(monthly: DataFrame) -> DataFrame:
    """Each month beside the one before it in the data, 0 for the first."""
    previous = F.lag("total_revenue", 1, 0).over(Window.orderBy(*order_columns(["month"])))
    return monthly.withColumn("previous_month", previous).withColumn(
        "revenue_change", F.round(F.col("total_revenue") - F.col("previous_month"), 2)
    )


def running_total(monthly: DataFrame) -> DataFrame:
    """Revenue of the month and all months before it."""
    up_to_month = Window.orderBy(*order_columns(["month"])).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return monthly.withColumn(
        "running_total", F.round(F.sum("total_revenue").over(up_to_month), 2)
    )


def best_worst_month(monthly: DataFrame) -> DataFrame:
    """The month with most revenue and the month with least, in two rows.

    The earlier month wins a tie; a single month appears in both rows. Both come from
    one aggregate over the months. A NULL month comes last, as in ``ORDER BY``.
    """
    month, revenue = F.col("month"), F.col("total_revenue")
    # Days from here on, as a number, so that the earlier month can be the larger one.
    day = F.datediff(month.cast("date"), F.lit("1970-01-01").cast("date"))
    row = F.struct(month.alias("month"), revenue.alias("total_revenue"))
    early = F.coalesce(day, F.lit(_LAST_DAY))
    ends = monthly.filter(revenue.isNotNull()).agg(
        F.max_by(row, F.struct(revenue, -early)).alias("best"),
        F.min_by(row, F.struct(revenue, early)).alias("worst"),
    )
    both = ends.select(F.explode(F.array("best", "worst")).alias("row"))
    return both.filter(F.col("row").isNotNull()).select("row.month", "row.total_revenue")


# Later than any month.
_LAST_DAY = 2_000_000_000


def daily_revenue(df: DataFrame) -> DataFrame:
    """Clean revenue per calendar day; days without sales are absent."""
    return (
        clean_sales(df)
        .groupBy(F.col("invoicedate").cast("date").alias("day"))
        .agg(rounded_revenue_sum(df).alias("total_revenue"))
        .withColumn("day", F.col("day").cast("timestamp_ntz"))
    )


def running_days(daily: DataFrame) -> DataFrame:
    """Each day with the revenue so far and the change on the day before it in the data.

    Days may be many (or invoices, see ``running_invoices``), so no window spans them all.
    """
    made = with_running_values(daily, "total_revenue", ["day"], "running_total", "previous_day")
    return made.withColumn(
        "revenue_change", F.round(F.col("total_revenue") - F.col("previous_day"), 2)
    )


def running_invoices(df: DataFrame) -> DataFrame:
    """Each clean invoice in order of time with the revenue of all up to it."""
    invoices = (
        clean_sales(df)
        .groupBy("invoiceno")
        .agg(
            F.min("invoicedate").alias("invoicedate"),
            rounded_revenue_sum(df).alias("total_invoice_value"),
        )
    )
    return with_running_values(
        invoices, "total_invoice_value", ["invoicedate", "invoiceno"], "running_total",
        "previous_value",
    )
