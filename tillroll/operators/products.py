"""Best-selling products, overall and per country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.functions import rounded_revenue_sum
from tillroll.operators.explore import distinct_lines, top_k
from tillroll.operators.quality import clean_sales
from tillroll.operators.shape import with_revenue
from tillroll.operators.windows import top_ranked
from tillroll.session import freeze


def top_lines_by_quantity(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest distinct single lines with a price.

    Each quantity in use belongs to at least one distinct line, and so does each
    product's largest. So the answer lies within the ``n`` largest quantities, and also
    at or above the ``n``-th largest of the products' largest ones. Both bounds are
    found first, in passes over one and two columns with small shuffles, and only
    the lines that reach the greater are de-duplicated, instead of shuffling the
    whole table for ``n`` rows.
    """
    priced = df.filter(F.col("unitprice") != 0)

    def nth_largest(quantities: DataFrame) -> Column:
        # NULL if there are fewer than n to be had.
        reached = F.when(F.count("quantity") == n, F.min("quantity"))
        return top_k(quantities, ["-quantity"], n).agg(reached).scalar()

    of_all = nth_largest(priced.select("quantity").distinct())
    of_products = nth_largest(
        priced.groupBy("stockcode").agg(F.max("quantity").alias("quantity")).select("quantity")
    )
    # With neither bound every line is kept.
    large_enough = F.coalesce(F.col("quantity") >= F.greatest(of_all, of_products), F.lit(True))
    lines = distinct_lines(
        priced.filter(large_enough), ["stockcode", "description", "quantity", "unitprice"]
    )
    order = ["-quantity", "stockcode", "description", "unitprice"]
    return with_revenue(top_k(lines, order, n))


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` products with most units sold.

    Counts every priced line with a positive quantity, which is wider than the
    clean set: unknown customers and negative prices are in.
    """
    totals = (
        df.filter((F.col("unitprice") != 0) & (F.col("quantity") > 0))
        .groupBy("stockcode", "description")
        .agg(
            F.sum("quantity").alias("total_quantity_sold"),
            rounded_revenue_sum(df).alias("total_revenue"),
        )
    )
    return top_k(totals, ["-total_quantity_sold", "stockcode", "description"], n)


_COUNTRY_LINE = ("stockcode", "description", "quantity", "country")


def distinct_country_lines(df: DataFrame) -> DataFrame:
    """The distinct clean lines that ``top_lines_by_country`` ranks."""
    return clean_sales(df).select(*_COUNTRY_LINE).distinct()


def top_lines_by_country(df: DataFrame, n: int = 3, distinct: bool = False) -> DataFrame:
    """Distinct single lines with the ``n`` top ranks by quantity per country.

    Those lines hold one of their country's ``n`` largest quantities. A first
    job, run when this is called, finds these pairs and stores them, so that Spark
    knows their size when it plans the rest: it broadcasts them if they are small, as
    they are for any real list of countries, and joins by shuffle if not. Only
    the lines that match are then de-duplicated and ranked. ``distinct`` says that ``df``
    is the result of ``distinct_country_lines`` already.
    """
    lines = df if distinct else clean_sales(df).select(*_COUNTRY_LINE)
    largest_first = Window.partitionBy("country").orderBy(F.col("quantity").desc())
    largest = freeze(
        lines.select("country", "quantity")
        .distinct()
        .withColumn("_place", F.row_number().over(largest_first))
        .filter(F.col("_place") <= n)
        .select(F.col("country").alias("_country"), F.col("quantity").alias("_quantity")),
        "largest",
    )
    matches = F.col("country").eqNullSafe(F.col("_country")) & (
        F.col("quantity") == F.col("_quantity")
    )
    found = lines.join(largest, matches, "left_semi")
    return top_ranked(found if distinct else found.distinct(), "country", "quantity", n)


def top_products_by_country(df: DataFrame, n: int = 3, method: str = "rank") -> DataFrame:
    """Products with the ``n`` top ranks by units sold in each country.

    ``rank`` leaves gaps after ties, ``dense_rank`` does not; both keep every
    tied product.
    """
    totals = (
        clean_sales(df)
        .groupBy("stockcode", "description", "country")
        .agg(F.sum("quantity").alias("total_quantity"))
    )
    return top_ranked(totals, "country", "total_quantity", n, method)
