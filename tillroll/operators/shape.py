"""Added and retyped columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tillroll.functions import month_start, parse_invoice_date, revenue


def with_revenue(df: DataFrame) -> DataFrame:
    """Add ``revenue``, the value of the line."""
    return df.withColumn("revenue", revenue())


def with_invoice_timestamp(df: DataFrame, strict: bool = True) -> DataFrame:
    """Replace a text ``invoicedate`` by a timestamp.

    A column that is a timestamp already is left alone, so the step can be
    repeated. Text that is no date is an error, or NULL with ``strict=False``.
    """
    if not isinstance(df.schema["invoicedate"].dataType, T.StringType):
        return df
    return df.withColumn("invoicedate", parse_invoice_date(F.col("invoicedate"), strict))


def with_month(df: DataFrame) -> DataFrame:
    """Add ``month``, the first instant of the invoice's month."""
    return df.withColumn("month", month_start(F.col("invoicedate")).cast("timestamp_ntz"))
