"""Known answers on a table small enough to work out by hand."""

from __future__ import annotations

from datetime import datetime

from conftest import rows

from tillroll import operators as ops


def by_key(df, *columns):
    return {row[0]: row[1:] for row in rows(df, *columns)}


def test_counts_and_range(mini):
    assert rows(ops.row_count(mini)) == [(13,)]
    assert rows(ops.distinct_invoices(mini)) == [(11,)]
    assert rows(ops.date_range(mini)) == [
        (datetime(2010, 12, 1, 8, 26), datetime(2011, 3, 3, 9, 0))
    ]


def test_quality_counts_agree_with_profile_and_rows(mini):
    expected = {"cancelled": 1, "quantity": 2, "price": 2, "customer": 2}
    profile = ops.quality_profile(mini).first().asDict()
    assert profile["total_rows"] == 13
    for defect, count in expected.items():
        assert rows(ops.quality_count(mini, defect)) == [(count,)]
        assert ops.quality_rows(mini, defect).count() == count
        assert profile[f"{defect}_rows"] == count


def test_clean_set_keeps_lower_case_c(mini):
    invoices = {row.invoiceno for row in ops.clean_sales(mini).collect()}
    assert "c536375" in invoices and "C536371" not in invoices
    assert ops.clean_sales(mini).count() == 9
    assert rows(ops.clean_cancelled_check(mini)) == [(0,)]


def test_clean_set_drops_null_invoice(spark, mini):
    nameless = mini.limit(1).selectExpr("cast(null as string) as invoiceno", *mini.columns[1:])
    assert ops.clean_sales(mini.unionByName(nameless)).count() == 9


def test_revenue_by_country(mini):
    def revenue(scope):
        return by_key(ops.revenue_by_country(mini, scope))

    assert revenue("raw") == {
        "EIRE": (65.0,), "France": (1019.99,), "United Kingdom": (1409.90,)
    }
    assert revenue("positive") == {
        "EIRE": (79.0,), "France": (1019.99,), "United Kingdom": (1409.90,)
    }
    assert revenue("clean") == {
        "EIRE": (79.0,), "France": (1019.99,), "United Kingdom": (1399.90,)
    }


def test_top_products(mini):
    found = ops.top_products(mini, 10).select(
        "stockcode", "total_quantity_sold", "total_revenue"
    )
    assert [(r[0], r[1], float(r[2])) for r in found.collect()] == [
        ("A3", 107, 1014.0), ("A1", 24, 259.9), ("A2", 20, 210.0), ("A4", 5, 5.0),
        ("A5", 3, 1019.99),
    ]
    assert [r.stockcode for r in ops.top_products(mini, 2).collect()] == ["A3", "A1"]


def test_months(mini):
    monthly = ops.monthly_revenue(mini)
    assert rows(ops.month_over_month(monthly)) == [
        (datetime(2010, 12, 1), 399.9, 0.0, 399.9),
        (datetime(2011, 1, 1), 1079.0, 399.9, 679.1),
        (datetime(2011, 3, 1), 1019.99, 1079.0, -59.01),
    ]
    assert rows(ops.running_total(monthly), "month", "running_total") == [
        (datetime(2010, 12, 1), 399.9),
        (datetime(2011, 1, 1), 1478.9),
        (datetime(2011, 3, 1), 2498.89),
    ]
    assert [(r[0].month, float(r[1])) for r in ops.best_worst_month(monthly).collect()] == [
        (1, 1079.0), (12, 399.9)
    ]


def test_one_month_is_best_and_worst(mini):
    monthly = ops.monthly_revenue(mini.filter("invoiceno = '536370'"))
    assert rows(ops.best_worst_month(monthly)) == [(datetime(2011, 3, 1), 999.99)] * 2


def test_avg_order_value(mini):
    assert by_key(ops.avg_order_value(mini, with_counts=True)) == {
        "EIRE": (39.5, 2), "France": (510.0, 2), "United Kingdom": (466.63, 3)
    }
    assert ops.avg_order_value(mini).columns == ["country", "avg_order_value"]


def test_buckets(mini):
    assert by_key(ops.invoice_bucket_share(mini)) == {
        "Small": (4, 57.14), "Medium": (2, 28.57), "Large": (1, 14.29)
    }
    assert by_key(ops.invoice_bucket_counts(mini)) == {
        "Small": (4,), "Medium": (2,), "Large": (1,)
    }
    named = by_key(ops.invoice_buckets(mini), "invoiceno", "revenue_buckets")
    assert named["536365"] == ("Small",) and named["536366"] == ("Medium",)
    assert named["536367"] == ("Large",) and named["536370"] == ("Medium",)


def test_ranks_per_country(mini):
    def ranks(country, method):
        top = ops.top_products_by_country(mini, 3, method).filter(f"country = '{country}'")
        return rows(top, "stockcode", "total_quantity", "ranking")

    assert ranks("EIRE", "rank") == [("A1", 10, 1), ("A2", 10, 1), ("A3", 7, 3)]
    assert ranks("EIRE", "dense_rank") == [
        ("A1", 10, 1), ("A2", 10, 1), ("A3", 7, 2), ("A4", 5, 3)
    ]
    assert ranks("United Kingdom", "rank") == [("A1", 10, 2), ("A2", 10, 2), ("A3", 100, 1)]
    assert ranks("France", "rank") == [("A5", 3, 1)]


def test_top_lines(mini):
    largest = ops.top_lines_by_quantity(mini, 3).collect()
    assert [(r.stockcode, r.quantity, float(r.unitprice)) for r in largest] == [
        ("A3", 100, 10.0), ("A1", 10, 5.0), ("A1", 10, 19.99)
    ]
    assert float(largest[0].revenue) == 1000.0
    # Fewer lines than asked for: two of the thirteen have no price.
    assert ops.top_lines_by_quantity(mini, 50).count() == 11
    france = ops.top_lines_by_country(mini).filter("country = 'France'")
    assert rows(france, "quantity", "ranking") == [(1, 2), (2, 1)]


def test_customer_in_two_countries(mini):
    top = [(r[0], r[1], float(r[2])) for r in ops.top_customers(mini, 20).collect()]
    assert top == [
        (12584, "France", 1019.99), (13047, "United Kingdom", 1000.0),
        (17850, "United Kingdom", 399.9), (17850, "EIRE", 50.0), (12583, "EIRE", 29.0),
    ]


def test_quartiles(mini):
    tiles = by_key(ops.customer_quartiles(mini))
    assert tiles == {
        12584: (1019.99, 1), 13047: (1000.0, 2), 17850: (449.9, 3), 12583: (29.0, 4)
    }
    summary = by_key(ops.quartile_summary(ops.customer_quartiles(mini)))
    assert summary == {1: (1, 1019.99), 2: (1, 1000.0), 3: (1, 449.9), 4: (1, 29.0)}
    share = by_key(ops.quartile_share(ops.customer_quartiles(mini)))
    assert share == {
        1: (1019.99, 40.82), 2: (1000.0, 40.02), 3: (449.9, 18.0), 4: (29.0, 1.16)
    }


def test_preview(mini):
    assert ops.preview(mini, 4).count() == 4
    first = ops.preview(mini, 1, ["invoiceno"]).first()
    assert first.invoiceno == "536365" and first.description == 'WHITE "HEART", X'
