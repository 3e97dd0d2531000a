"""What Spark makes of the operators: the plan has to suit a large table."""

from __future__ import annotations

import re

import pytest

from tillroll import operators as ops
from tillroll.plans.reports import SEVERAL_READS
from tillroll.sources import read_retail, save_retail


@pytest.fixture(scope="module")
def stored(spark, mini, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "retail")
    save_retail(mini, path)
    return read_retail(spark, path)


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def tree(df) -> str:
    """The executed plan as a tree, without the plan it started from."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def columns_read(text: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*)>", text)]


def test_cleaning_filter_reaches_the_files(stored):
    text = plan(ops.monthly_revenue(stored))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    for part in ("Not(StringStartsWith(invoiceno,C))", "GreaterThan(quantity,0)",
                 "GreaterThan(unitprice,0", "IsNotNull(customerid)"):
        assert part in pushed


def test_only_needed_columns_are_read(stored):
    assert columns_read(plan(ops.monthly_revenue(stored))) == [
        {"invoiceno", "quantity", "invoicedate", "unitprice", "customerid"}
    ]
    assert columns_read(plan(ops.quality_count(stored, "price"))) == [{"unitprice"}]
    assert columns_read(plan(ops.row_count(stored))) == [set()]


@pytest.mark.parametrize(
    "operator",
    [ops.revenue_by_country, ops.monthly_revenue, ops.customer_revenue, ops.invoice_buckets],
)
def test_grouped_sums_take_one_shuffle_of_partial_sums(stored, operator):
    text = tree(operator(stored))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text and "SinglePartition" not in text
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_order_values_need_no_expand(stored):
    text = tree(ops.avg_order_value(stored))
    assert "Expand" not in text
    assert re.search(r"Exchange hashpartitioning\(country#\d+, invoiceno#\d+", text)


@pytest.mark.parametrize("method", ["rank", "dense_rank"])
def test_country_ranks_limit_before_the_shuffle_and_reuse_totals(stored, method):
    text = tree(ops.top_products_by_country(stored, 3, method))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "ReusedExchange" in text
    assert "SinglePartition" not in text
    assert len(re.findall(r"FileScan", text)) == 1


def test_best_and_worst_month_share_one_scan(stored):
    text = tree(ops.best_worst_month(ops.monthly_revenue(stored)))
    assert text.count("FileScan") == 1
    # Both ends come from one aggregate over the months, which are computed once.
    assert "Union" not in text and "ReusedExchange" not in text
    assert len(re.findall("partial_max_by", text)) == 1


@pytest.mark.parametrize("operator", [ops.top_customers, ops.top_products])
def test_top_k_never_sorts_everything(stored, operator):
    text = tree(operator(stored))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


def test_quartiles_never_put_customers_in_one_partition(stored):
    text = tree(ops.customer_quartiles(stored))
    # The one single-partition step holds partition sizes, not customers.
    (single,) = re.findall(r"Exchange SinglePartition.*?\n(.*?)FileScan", text, re.S)
    assert "HashAggregate(keys=[_groupingexpression" in single
    assert text.count("FileScan") == 2


def test_monthly_windows_work_on_months_only(stored):
    text = tree(ops.month_over_month(ops.monthly_revenue(stored)))
    before_window, below = text.split("Exchange SinglePartition")
    assert "Window" in before_window and "partial_sum" in below


def test_no_python_in_any_plan(stored):
    frames = [
        ops.month_over_month(ops.monthly_revenue(stored)),
        ops.invoice_bucket_share(stored),
        ops.customer_quartiles(stored),
        ops.top_products_by_country(stored),
        ops.quality_profile(stored),
    ]
    for df in frames:
        assert not re.search(r"Python|Arrow|Pandas", tree(df))


def test_what_is_stored_for_several_reads_is_narrow(stored):
    prepare, _ = SEVERAL_READS["top_lines_by_country"]
    assert prepare(stored).columns == ["stockcode", "description", "quantity", "country"]
    assert "HashAggregate" in tree(prepare(stored))
    prepare, report = SEVERAL_READS["export_extract"]
    summary = prepare(stored)
    keys = ["invoiceno", "customerid", "country", "invoicedate"]
    assert set(summary.columns) == {*keys, "unitprice", "quantity"}
    assert summary.count() == ops.clean_sales(stored).select(
        "invoiceno", "customerid", "country", "invoicedate"
    ).distinct().count()
    assert sorted(map(str, report(summary).collect())) == sorted(
        map(str, report(stored).collect())
    )
