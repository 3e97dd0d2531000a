"""Money and date expressions at their edges."""

from __future__ import annotations

import random
from contextlib import contextmanager
from datetime import datetime
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillroll.functions import (
    as_invoice_text,
    divide_rounded,
    exact_revenue_sum,
    month_start,
    parse_invoice_date,
    round_half_away,
)
from tillroll.operators import (
    clean_sales,
    month_over_month,
    monthly_revenue,
    revenue_by_country,
    running_total,
    with_invoice_timestamp,
    with_month,
    with_revenue,
)


@contextmanager
def setting(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def test_rounding_agrees_with_the_other_engine(spark):
    draw = random.Random(3)
    values = [1.005, -1.005, 2.675, 0.0, 0.125, 1e9 + 0.005]
    values += [draw.randrange(-(10**7), 10**7) / 1000 for _ in range(20000)]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double")
             .select(round_half_away(F.col("v"))).collect()]
    numbers = pa.table({"i": range(len(values)), "v": values})  # noqa: F841
    expected = duckdb.sql("SELECT round(v, 2) FROM numbers ORDER BY i").fetchall()
    assert found == [row[0] for row in expected]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "a long, b long")
    assert rows(df.select(divide_rounded(F.col("a"), F.col("b")))) == [(0.33,), (None,)]


def sales(spark, lines, price="decimal(12,4)"):
    full = [("1", "s", "d", q, datetime(2011, 1, 1), p, 7, "X") for q, p in lines]
    return spark.createDataFrame(
        full,
        "invoiceno string, stockcode string, description string, quantity long, "
        f"invoicedate timestamp_ntz, unitprice {price}, customerid long, country string",
    )


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("precision, scale", [(12, 4), (12, 2), (15, 3), (18, 2), (9, 0)])
def test_sums_are_exact(spark, ansi, precision, scale):
    draw = random.Random(5)
    # Large prices and small quantities: 400 * 9 * 10^15 still fits a BIGINT.
    largest = 10 ** min(precision, 15)
    lines = [
        (draw.randrange(-9, 10), Decimal(draw.randrange(largest)).scaleb(-scale))
        for _ in range(400)
    ]
    with setting(spark, "spark.sql.ansi.enabled", ansi):
        df = sales(spark, lines, f"decimal({precision},{scale})")
        found = df.agg(exact_revenue_sum(df)).first()[0]
    assert found == sum(q * p for q, p in lines)


BOTH_MODES = pytest.mark.parametrize("ansi", ["true", "false"])


@BOTH_MODES
def test_large_sums_are_right_in_every_mode(spark, ansi):
    with setting(spark, "spark.sql.ansi.enabled", ansi):
        df = sales(spark, [(2**62, Decimal("1.0"))] * 3)
        assert df.agg(exact_revenue_sum(df)).first()[0] == 3 * 2**62
        df = sales(spark, [(10**10, Decimal("99999.00"))] * 2)
        assert df.agg(exact_revenue_sum(df)).first()[0] == 2 * 10**10 * 99999


@BOTH_MODES
def test_a_sum_past_all_digits_is_an_error_in_every_mode(spark, ansi):
    df = sales(spark, [(10**19 // 2, Decimal(10**18 - 1))] * 9, "decimal(18,0)")
    df = df.crossJoin(spark.range(10))
    with setting(spark, "spark.sql.ansi.enabled", ansi):
        with pytest.raises(Exception, match="overflow|OVERFLOW|OUT_OF_RANGE"):
            df.agg(exact_revenue_sum(df)).collect()


@BOTH_MODES
def test_double_prices_are_never_rounded(spark, ansi):
    with setting(spark, "spark.sql.ansi.enabled", ansi):
        df = sales(spark, [(10**6, 0.00012)], price="double")
        assert df.agg(exact_revenue_sum(df)).first()[0] == 120
        df = sales(spark, [(1, 1e-15)], price="double")
        with pytest.raises(Exception, match="price does not fit"):
            df.agg(exact_revenue_sum(df)).collect()
        df = sales(spark, [(10**14, 1.5)], price="double")
        with pytest.raises(Exception, match="quantity does not fit"):
            df.agg(exact_revenue_sum(df)).collect()


def test_sub_penny_price_is_a_price(spark):
    df = sales(spark, [(1000, Decimal("0.001"))])
    assert clean_sales(df).count() == 1
    assert rows(revenue_by_country(df)) == [("X", 1.0)]


def test_double_prices_are_summed_exactly(spark):
    df = sales(spark, [(1, 0.1)] * 10, price="double")
    assert df.agg(exact_revenue_sum(df)).first()[0] == 1


def test_null_price_or_quantity_adds_nothing(spark):
    df = sales(spark, [(None, Decimal("2")), (3, None), (2, Decimal("1.5"))])
    assert rows(revenue_by_country(df, "raw")) == [("X", 3.0)]


def test_revenue_column(spark):
    df = with_revenue(sales(spark, [(3, Decimal("1.25"))]))
    assert rows(df, "revenue") == [(3.75,)]


TEXTS = {
    "12/1/2010 8:26": datetime(2010, 12, 1, 8, 26),
    "1/4/2011 10:00": datetime(2011, 1, 4, 10, 0),
    "01/04/2011 08:05": datetime(2011, 1, 4, 8, 5),
    "3/27/2011 2:30": datetime(2011, 3, 27, 2, 30),  # skipped by some zones' clocks
}


@pytest.mark.parametrize("zone", ["UTC", "Europe/London", "America/Sao_Paulo", "Asia/Beirut"])
@pytest.mark.parametrize("strict", [True, False])
def test_dates_do_not_depend_on_the_session_zone(spark, zone, strict):
    with setting(spark, "spark.sql.session.timeZone", zone):
        df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
        parsed = df.select(parse_invoice_date(F.col("t"), strict).alias("p"))
        assert [r.p for r in parsed.collect()] == list(TEXTS.values())
        text_again = parsed.select(as_invoice_text(F.col("p")).alias("t"))
        again = text_again.select(parse_invoice_date(F.col("t")).alias("p"))
        assert [r.p for r in again.collect()] == list(TEXTS.values())
        months = parsed.select(month_start(F.col("p")).cast("string"))
        assert [r[0] for r in months.collect()] == [
            "2010-12-01", "2011-01-01", "2011-01-01", "2011-03-01"
        ]


@pytest.mark.parametrize("text", ["2010-12-01 08:26", "13/1/2010 8:26", "", "2/30/2011 1:00"])
@BOTH_MODES
def test_bad_dates(spark, text, ansi):
    df = spark.createDataFrame([(text,)], "invoicedate string")
    with setting(spark, "spark.sql.ansi.enabled", ansi):
        with pytest.raises(Exception, match="cannot parse as"):
            with_invoice_timestamp(df).collect()
        assert rows(with_invoice_timestamp(df, strict=False)) == [(None,)]


def test_a_missing_date_stays_missing(spark):
    df = spark.createDataFrame([(None,), (datetime(2011, 1, 1, 8, 5),)], "t timestamp_ntz")
    text = df.select(as_invoice_text(F.col("t")).alias("invoicedate"))
    assert rows(text) == [("1/1/2011 8:05",), (None,)]
    assert rows(with_invoice_timestamp(text)) == [(datetime(2011, 1, 1, 8, 5),), (None,)]


def test_seconds_are_not_dropped(spark):
    df = spark.createDataFrame([(datetime(2011, 1, 1, 8, 5, 9),)], "t timestamp_ntz")
    with pytest.raises(Exception, match="no seconds"):
        df.select(as_invoice_text(F.col("t"))).collect()


def test_months_without_a_date_come_last(spark):
    monthly = spark.createDataFrame(
        [(datetime(2011, 2, 1), Decimal(20)), (None, Decimal(7)), (datetime(2011, 1, 1), Decimal(10))],
        "month timestamp_ntz, total_revenue decimal(20,2)",
    )
    known = duckdb.sql("""
        SELECT m, v, lag(v, 1, 0) OVER (ORDER BY m), sum(v) OVER (ORDER BY m) FROM
        (VALUES (TIMESTAMP '2011-02-01', 20), (NULL, 7), (TIMESTAMP '2011-01-01', 10)) t(m, v)""")
    expected = sorted(known.fetchall(), key=str)
    changes = month_over_month(monthly).select("month", "total_revenue", "previous_month")
    sums = running_total(monthly).select("month", "running_total")
    assert sorted([tuple(r) for r in changes.collect()], key=str) == [
        (m, v, before) for m, v, before, _ in expected
    ]
    assert sorted([tuple(r) for r in sums.collect()], key=str) == sorted(
        [(m, total) for m, _, _, total in expected], key=str
    )


def test_retype_can_be_repeated(mini):
    assert with_invoice_timestamp(mini) is mini


def test_month_column(mini):
    months = {r.month for r in with_month(mini).collect()}
    assert months == {datetime(2010, 12, 1), datetime(2011, 1, 1), datetime(2011, 3, 1)}
    assert dict(monthly_revenue(mini).dtypes)["month"] == "timestamp_ntz"
