"""Relations between reports that hold on any data."""

from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from tillroll import operators as ops
from tillroll.functions import exact_revenue_sum
from tillroll.sources import read_retail, save_retail, star_sales

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sales") / "retail")
    save_retail(star_sales(spark, str(TESTDATA / "sf0.01")), path)
    return read_retail(spark, path)


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_stored_table_equals_view(spark, sales):
    view = star_sales(spark, str(TESTDATA / "sf0.01"))
    assert view.exceptAll(sales).count() == 0 and sales.exceptAll(view).count() == 0


def test_clean_set_has_no_defects(sales):
    clean = ops.clean_sales(sales)
    profile = ops.quality_profile(clean).first().asDict()
    assert profile.pop("total_rows") == clean.count()
    assert set(profile.values()) == {0}


def test_all_totals_agree(sales):
    """Up to the rounding of each group: some prices are below a penny."""
    exact = ops.clean_sales(sales).agg(exact_revenue_sum(sales)).first()[0]
    monthly = ops.monthly_revenue(sales)
    quartiles = ops.quartile_summary(ops.customer_quartiles(sales))
    for df, column in (
        (monthly, "total_revenue"),
        (ops.revenue_by_country(sales), "total_revenue"),
        (ops.customer_revenue(sales), "total_revenue"),
        (ops.invoice_buckets(sales), "total_invoice_value"),
    ):
        assert abs(total(df, column) - exact) <= Decimal("0.005") * df.count()
    customers = ops.customer_revenue(sales)
    assert total(quartiles, "quartile_revenue") == total(customers, "total_revenue")
    assert total(monthly, "total_revenue") == last_month(ops.running_total(monthly)).running_total


def last_month(df):
    """Sales without a date come last."""
    return df.orderBy(F.desc_nulls_first("month")).first()


def test_changes_add_up_to_the_last_month(sales):
    changes = ops.month_over_month(ops.monthly_revenue(sales))
    assert total(changes, "revenue_change") == last_month(changes).total_revenue


def test_shares_add_up_to_a_hundred(sales):
    for shares in (ops.invoice_bucket_share(sales),
                   ops.quartile_share(ops.customer_quartiles(sales))):
        found = shares.agg(F.sum("pct_of_total"), F.count("*")).first()
        assert abs(found[0] - 100) <= 0.005 * found[1] + 1e-9


def test_quartile_sizes_differ_by_at_most_one(sales):
    sizes = [r[1] for r in rows(ops.customer_quartiles(sales).groupBy("rev_quartiles").count())]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    assert sizes == sorted(sizes, reverse=True)


def test_invoice_counts_agree(sales):
    per_country = ops.avg_order_value(sales, with_counts=True)
    clean = ops.clean_sales(sales)
    invoices = ops.distinct_invoices(clean).first()[0]
    assert total(per_country, "unique_invoice_total") == invoices
    assert total(ops.invoice_bucket_counts(sales), "bucket_count") == invoices


def test_results_do_not_depend_on_partitioning(sales):
    def results(df):
        return [
            rows(ops.month_over_month(ops.monthly_revenue(df))),
            rows(ops.avg_order_value(df, with_counts=True)),
            rows(ops.quartile_share(ops.customer_quartiles(df))),
            rows(ops.top_products_by_country(df)),
            rows(ops.top_lines_by_country(df)),
        ]

    assert results(sales) == results(sales.repartition(13, F.rand(seed=1)))
