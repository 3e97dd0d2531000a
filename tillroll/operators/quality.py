"""Data-quality predicates and the cleaning filter built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.schema import CANCELLED_PREFIX


def cancelled() -> Column:
    """The invoice was cancelled; the prefix is case-sensitive."""
    return F.col("invoiceno").startswith(CANCELLED_PREFIX)


# Each predicate finds the rows with one defect. A row may have several, so
# the counts of different defects do not add up to the rows removed.
DEFECTS = {
    "cancelled": cancelled,
    "quantity": lambda: F.col("quantity") <= 0,
    "price": lambda: F.col("unitprice") <= 0,
    "customer": lambda: F.col("customerid").isNull(),
}


def quality_rows(df: DataFrame, defect: str) -> DataFrame:
    """The rows with one defect."""
    return df.filter(DEFECTS[defect]())


def quality_count(df: DataFrame, defect: str) -> DataFrame:
    """How many rows have one defect."""
    return quality_rows(df, defect).agg(F.count(F.lit(1)).alias("row_count"))


def quality_profile(df: DataFrame) -> DataFrame:
    """All defect counts in one pass over the table."""
    counts = [F.count_if(test()).alias(f"{name}_rows") for name, test in DEFECTS.items()]
    return df.agg(F.count(F.lit(1)).alias("total_rows"), *counts)


def clean_sales(df: DataFrame) -> DataFrame:
    """Completed sales to known customers.

    Rows whose invoice, quantity or price is NULL fail the filter too.
    """
    return df.filter(
        ~cancelled()
        & (F.col("quantity") > 0)
        & (F.col("unitprice") > 0)
        & F.col("customerid").isNotNull()
    )


def clean_cancelled_check(df: DataFrame) -> DataFrame:
    """Cancelled rows left in the clean set; zero if the filter works."""
    return (
        clean_sales(df).filter(cancelled()).agg(F.count("invoiceno").alias("cancelled_rows"))
    )
