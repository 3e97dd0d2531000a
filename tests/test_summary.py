"""Mergeable summaries equal the full run after any split; running values equal the window."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from tillroll import operators as ops
from tillroll.functions import exact_sum, order_columns
from tillroll.operators import partials
from tillroll.schema import TYPED_SCHEMA
from tillroll.sources import SalesSummary, VersionConflict

LINES = st.lists(
    st.tuples(
        st.sampled_from(["1", "2", "3", "C4", "5", "6", "7"]),
        st.integers(-2, 9),
        st.sampled_from([None, *range(0, 100, 9)]),
        st.decimals(0, 20, places=4),
        st.sampled_from([None, 1, 2]),
        st.sampled_from([None, "EIRE", "France"]),
        st.integers(0, 2),
    ),
    max_size=25,
)


def table(spark, lines):
    made = [
        (i, "s", "d", q, None if day is None else datetime(2011, 1, 1) + timedelta(day), p, c, n)
        for i, q, day, p, c, n, _ in lines
    ]
    return spark.createDataFrame(made, TYPED_SCHEMA)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(LINES)
def test_any_split_gives_the_full_run(spark, tmp_path_factory, lines):
    whole = table(spark, lines)
    summary = SalesSummary(spark, str(tmp_path_factory.mktemp("s") / "s"))
    for k in (2, 0, 1, 2):
        summary = summary.add(table(spark, [x for x in lines if x[-1] == k]), f"part-{k}")
    assert summary.extracts == ["part-0", "part-1", "part-2"]
    assert rows(summary.revenue("month")) == rows(ops.monthly_revenue(whole))
    assert rows(summary.revenue("country")) == rows(ops.revenue_by_country(whole))
    assert rows(summary.avg_order_value(), "country", "avg_order_value", "unique_invoice_total") == (
        rows(ops.avg_order_value(whole, with_counts=True))
    )
    clean = ops.clean_sales(ops.with_month(whole)).withColumn("month", F.col("month").cast("date"))
    for by in (["country", "month"], ["month"], []):
        counted = clean.groupBy(*by).agg(F.countDistinct("invoiceno").alias("unique_invoices"))
        assert rows(summary.invoices(*by)) == rows(counted)


def test_updates_read_the_extract_alone(spark, mini, tmp_path):
    summary = SalesSummary(spark, str(tmp_path / "s"))
    assert summary.extracts == [] and summary.version is None
    one = summary.add(mini, "one")
    assert one.add(mini, "one") is one
    two = one.add(mini.limit(0), "two")
    assert two.version == 2 and rows(two.revenue("month")) == rows(one.revenue("month"))
    # A writer that opened the first version comes too late.
    with pytest.raises(VersionConflict):
        one.add(mini, "three")
    assert SalesSummary(spark, str(tmp_path / "s")).extracts == ["one", "two"]


def test_many_invoices_fill_several_buckets(spark, tmp_path):
    n = 70_000
    lines = spark.range(2 * n).select(
        (F.col("id") % n).cast("string").alias("invoiceno"), F.lit("s").alias("stockcode"),
        F.lit("d").alias("description"), F.lit(1).cast("bigint").alias("quantity"),
        F.lit(datetime(2011, 1, 1)).cast("timestamp_ntz").alias("invoicedate"),
        F.lit(Decimal("1.0000")).cast("decimal(12,4)").alias("unitprice"),
        F.lit(7).cast("bigint").alias("customerid"), F.lit("EIRE").alias("country"),
    )
    summary = SalesSummary(spark, str(tmp_path / "s"))
    summary = summary.add(lines.filter("invoiceno % 2 = 0"), "a").add(lines, "b")
    assert summary.invoices("country").first().unique_invoices == n
    numbers = summary._table("invoices").agg(F.min("number"), F.max("number"), F.count_distinct("number"))
    assert tuple(numbers.first()) == (1, n, n)
    assert summary._table("bitmaps").count() == 3


def test_bitmaps_are_few_where_invoices_mix_countries_and_months(spark):
    n, groups = 70_000, 28
    lines = spark.range(2 * n).select(
        (F.col("id") % n).cast("string").alias("invoiceno"), F.lit("s").alias("stockcode"),
        F.lit("d").alias("description"), F.lit(1).cast("bigint").alias("quantity"),
        F.add_months(F.lit("2011-01-01").cast("date"), (F.col("id") % 7).cast("int"))
        .cast("timestamp_ntz").alias("invoicedate"),
        F.lit(Decimal("1.0000")).cast("decimal(12,4)").alias("unitprice"),
        F.lit(7).cast("bigint").alias("customerid"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("c"), F.col("id") % 4)).alias("country"),
    )
    none = spark.createDataFrame([], "invoiceno string, number bigint")
    maps = ops.invoice_bitmaps(lines, ops.new_invoice_numbers(lines, none, 1))
    # One for each country and month, and one more for each further bucket of the numbers.
    assert maps.count() == groups + 2
    by = ["country", "month"]
    month = F.col("invoicedate").cast("date").alias("month")
    counted = lines.groupBy("country", month).agg(F.countDistinct("invoiceno").alias("unique_invoices"))
    assert rows(ops.invoices_from_bitmaps(maps, *by)) == rows(counted)


def test_partial_sums_too_long_are_refused(spark):
    big = spark.createDataFrame([(Decimal("9" * 34 + ".9999"),)] * 2, "v decimal(38,4)")
    with pytest.raises(Exception, match="38 digits|NUMERIC_VALUE_OUT_OF_RANGE"):
        big.agg(exact_sum(F.col("v"))).collect()


def windowed(df, value, order):
    by = Window.orderBy(*order_columns(order))
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        *df.columns, F.sum(value).over(so_far).alias("running_total"),
        F.lag(value, 1, 0).over(by).alias("previous"),
    )


CASES = {
    "none": [],
    "one": [(1, 5)],
    "nulls": [(i, None if i % 3 else i) for i in range(40)],
    "nulls first": [(i, None) for i in range(30)] + [(100, 4), (None, 9)],
    "only nulls": [(i, None) for i in range(9)],
    "many": [(i * 7919 % 1009, i % 13 - 6) for i in range(1009)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("order", ["k", "-k"])
def test_running_values_equal_the_window(spark, case, order):
    df = spark.createDataFrame(CASES[case], "k int, v bigint").repartition(3)
    assert rows(ops.with_running_values(df, "v", [order])) == rows(windowed(df, "v", [order]))


def test_running_days_and_invoices(spark, mini):
    days = ops.daily_revenue(mini)
    want = windowed(days, "total_revenue", ["day"])
    assert rows(ops.running_days(days), "day", "running_total", "previous_day") == rows(
        want, "day", "running_total", "previous"
    )
    assert ops.running_invoices(mini).count() == 7


def test_no_single_partition_over_all_rows(spark, mini):
    for df in (ops.running_days(ops.daily_revenue(mini)), ops.running_invoices(mini)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows_ = [line for line in plan.splitlines() if "Window [" in line and "_partition" not in line]
        assert all(re.search("_range|_sum|_end", line) for line in rows_)


def test_numbers_are_gapless(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k")).repartition(7)
    found = ops.numbered(df, ["k"], "n").collect()
    assert [r.k for r in sorted(found, key=lambda r: r.n)] == sorted(r.k for r in found)
    assert sorted(r.n for r in found) == list(range(500))


def test_merging_is_the_same_in_any_order(spark, mini):
    parts = [partials.revenue_partials(mini.filter(f"quantity % 3 = {k}")) for k in range(3)]
    whole = rows(partials.revenue_partials(mini))
    assert rows(partials.merge_partials(*parts)) == whole
    assert rows(partials.merge_partials(partials.merge_partials(parts[2], parts[1]), parts[0])) == whole


@pytest.mark.parametrize("kind", ["decimal(18,6)", "double"])
def test_invoice_sums_are_exact(spark, kind):
    lines = spark.range(1001).select(
        F.col("id").cast("string").alias("invoiceno"), F.lit("s").alias("stockcode"),
        F.lit("d").alias("description"), F.lit(1).cast("bigint").alias("quantity"),
        F.lit(datetime(2011, 1, 1)).cast("timestamp_ntz").alias("invoicedate"),
        F.when(F.col("id") == 0, "0.00004").otherwise("0.00006").cast(kind).alias("unitprice"),
        F.lit(7).cast("bigint").alias("customerid"), F.lit("EIRE").alias("country"),
    )
    grain = ops.invoice_grain(lines)
    assert grain.count() == 1001
    for report in (ops.revenue_by_country, ops.monthly_revenue):
        assert rows(report(grain)) == rows(report(lines))
    assert rows(ops.revenue_by_country(lines, "positive")) == rows(ops.revenue_by_country(grain, "positive"))


def test_an_invoice_too_long_is_refused(spark, mini):
    wide = mini.limit(3).withColumn("unitprice", F.lit("9" * 17 + ".5").cast("decimal(20,1)"))
    wide = wide.withColumn("quantity", F.lit(10**12))
    fits = ops.invoice_grain(wide.filter("quantity < 0"))
    assert fits.collect() == []
    with pytest.raises(Exception, match="does not fit"):
        ops.invoice_grain(wide.withColumn("customerid", F.lit(1).cast("bigint")).withColumn(
            "invoiceno", F.lit("1"))).collect()
