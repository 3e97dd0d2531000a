"""The reports that prune or re-rank against plain SQL on random, tie-heavy tables."""

from __future__ import annotations

import random
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import rows

from tillroll import operators as ops

CLEAN = """(SELECT * FROM t WHERE invoiceno NOT LIKE 'C%' AND quantity > 0
            AND unitprice > 0 AND customerid IS NOT NULL)"""


@pytest.fixture(params=[1, 2])
def table(spark, request):
    draw = random.Random(request.param)

    def line():
        # A third of the rows share one country, one product and one customer.
        hot = draw.random() < 0.33
        product = 0 if hot else draw.randrange(12)
        return (
            draw.choice(["", "", "", "C", "c"]) + str(draw.randrange(80)),
            f"p{product}",
            draw.choice([f"name {product}", None]),
            draw.choice([None, -2, 0, 1, 1, 2, 2, 3, 7]),
            datetime(2011, draw.randrange(1, 13), draw.randrange(1, 29)),
            draw.choice([None, Decimal("0"), Decimal("0.001"), Decimal("1.5"), Decimal("20")]),
            1 if hot else draw.choice([None, *range(2, 30)]),
            "hot" if hot else draw.choice([None, "A", "B", "D"]),
        )

    df = spark.createDataFrame(
        [line() for _ in range(900)],
        "invoiceno string, stockcode string, description string, quantity long, "
        "invoicedate timestamp_ntz, unitprice decimal(12,4), customerid long, country string",
    ).repartition(5).cache()
    df.createOrReplaceTempView("t")
    yield df
    df.unpersist()


def same(spark, df, sql):
    expected = spark.sql(sql)
    assert rows(df.select(*expected.columns)) == rows(expected)


@pytest.mark.parametrize("n", [1, 3, 10, 500])
def test_top_lines_by_quantity(spark, table, n):
    same(spark, ops.top_lines_by_quantity(table, n), f"""
        SELECT DISTINCT stockcode, description, quantity, unitprice,
               quantity * unitprice AS revenue FROM t WHERE unitprice <> 0
        ORDER BY quantity DESC NULLS LAST, stockcode NULLS LAST, description NULLS LAST,
                 unitprice NULLS LAST LIMIT {n}""")


@pytest.mark.parametrize("n", [1, 3])
def test_top_lines_by_country(spark, table, n):
    same(spark, ops.top_lines_by_country(table, n), f"""
        SELECT * FROM (
            SELECT stockcode, description, quantity, country,
                   rank() OVER (PARTITION BY country ORDER BY quantity DESC) AS ranking
            FROM (SELECT DISTINCT stockcode, description, quantity, country FROM {CLEAN}))
        WHERE ranking <= {n}""")


@pytest.mark.parametrize("method", ["rank", "dense_rank"])
def test_top_products_by_country(spark, table, method):
    same(spark, ops.top_products_by_country(table, 3, method), f"""
        SELECT * FROM (
            SELECT *, {method}() OVER (PARTITION BY country ORDER BY total_quantity DESC) AS ranking
            FROM (SELECT stockcode, description, country, sum(quantity) AS total_quantity
                  FROM {CLEAN} GROUP BY ALL))
        WHERE ranking <= 3""")


def test_customer_quartiles(spark, table):
    same(spark, ops.customer_quartiles(table), f"""
        SELECT *, ntile(4) OVER (ORDER BY total_revenue DESC, customerid) AS rev_quartiles
        FROM (SELECT customerid, round(sum(quantity * unitprice), 2) AS total_revenue
              FROM {CLEAN} GROUP BY customerid)""")


def test_average_order_value(spark, table):
    same(spark, ops.avg_order_value(table, with_counts=True).drop("avg_order_value"), f"""
        SELECT country, count(DISTINCT invoiceno) AS unique_invoice_total
        FROM {CLEAN} GROUP BY country""")


def test_top_customers(spark, table):
    same(spark, ops.top_customers(table, 20), f"""
        SELECT customerid, country, round(sum(quantity * unitprice), 2) AS total_revenue
        FROM {CLEAN} GROUP BY customerid, country
        ORDER BY total_revenue DESC, customerid, country NULLS LAST LIMIT 20""")


def test_empty_table(spark, table):
    empty = table.limit(0)
    assert ops.row_count(empty).first()[0] == 0
    assert ops.quality_profile(empty).first().total_rows == 0
    for df in (
        ops.top_lines_by_quantity(empty), ops.top_lines_by_country(empty),
        ops.top_products_by_country(empty), ops.customer_quartiles(empty),
        ops.quartile_share(ops.customer_quartiles(empty)), ops.invoice_bucket_share(empty),
        ops.month_over_month(ops.monthly_revenue(empty)),
        ops.best_worst_month(ops.monthly_revenue(empty)),
    ):
        assert df.collect() == []
