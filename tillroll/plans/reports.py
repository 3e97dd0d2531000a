"""Every report by name, each a function of the typed retail table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tillroll import operators as ops
from tillroll.functions import as_invoice_text, order_columns
from tillroll.schema import COLUMNS
from tillroll.session import freeze, remove_at_exit, scratch_path
from tillroll.sources import (
    SalesSummary,
    load_retail_csv,
    publish_version,
    read_extract,
    read_months,
    read_quarantine,
    read_retail,
    read_retail_csv,
    replace_months,
    retype_table,
    save_months,
    save_retail,
    star_sales,
    write_extracts,
    write_retail_csv,
)

Report = Callable[[DataFrame], DataFrame]


# Column names with "-" for descending order.
_REVENUE_ORDER = ("-total_revenue", "country")
_AVERAGE_ORDER = ("-avg_order_value", "country")
_SPEND_ORDER = ("-total_revenue", "customerid")


def _sorted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_columns(order))


def _raw(df: DataFrame) -> DataFrame:
    """The table as an extract holds it, with its dates as text."""
    return df.withColumn("invoicedate", as_invoice_text(F.col("invoicedate")))


def _stored(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, label)
    save_retail(df, path, mode="overwrite")
    remove_at_exit(spark, path)
    return read_retail(spark, path)


def load_csv(df: DataFrame) -> DataFrame:
    """Write an extract, load it, repair its dates, and store the table; runs when called."""
    spark = df.sparkSession
    path = scratch_path(spark, "csv")
    write_retail_csv(_raw(df), path)
    remove_at_exit(spark, path)
    loaded = read_retail_csv(spark, path, empty_is_null=False)
    return _stored(ops.with_invoice_timestamp(loaded), "retail")


def _extract_with_faults(df: DataFrame, path: str) -> None:
    """An extract some of whose lines do not fit: by their product, a price that is a word, a
    quantity with a fraction, a date of a thirteenth month, or a field too many."""
    code = F.col("stockcode").cast("bigint")

    def spoilt(name: str, rest: int, text: Column) -> Column:
        return F.when(code % 40 == rest, text).otherwise(F.col(name).cast("string")).alias(name)

    raw = _raw(df).select(
        "invoiceno", "stockcode", "description",
        spoilt("quantity", 1, F.concat("quantity", F.lit(".5"))),
        spoilt("invoicedate", 2, F.lit("13/1/2011 8:26")),
        spoilt("unitprice", 3, F.lit("n/a")),
        "customerid", "country",
    )
    write_retail_csv(raw.filter(code % 40 != 4), path)
    more = raw.filter(code % 40 == 4).withColumn("more", F.lit("x"))
    line = F.to_csv(F.struct(*more.columns), {"escape": '"'})
    # The first line a task writes goes below a header, so each file has its own.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    headed = F.when(first, F.concat(F.lit(",".join(COLUMNS) + "\n"), line)).otherwise(line)
    more.select(headed.alias("value")).write.mode("append").option("maxRecordsPerFile", 0).text(path)


def load_csv_with_quarantine(df: DataFrame) -> DataFrame:
    """Load an extract with faulty lines; what was stored and kept aside; runs when called.

    One row per reason with its lines, and one, ``stored``, with the good lines and their
    quantities.
    """
    spark = df.sparkSession
    extract, target = scratch_path(spark, "faulty-csv"), scratch_path(spark, "loaded")
    _extract_with_faults(df, extract)
    remove_at_exit(spark, extract)
    load_retail_csv(spark, extract, target, empty_is_null=False)
    remove_at_exit(spark, target)
    stored = read_retail(spark, target).agg(
        F.lit("stored").alias("reason"), F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("units"),
    )
    aside = read_quarantine(spark, target).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
    return stored.unionByName(aside.withColumn("units", F.lit(None).cast("bigint")))


def versioned_reload(df: DataFrame) -> DataFrame:
    """Store the lines, then the clean ones in their place; both versions; runs when called."""
    spark = df.sparkSession
    target = scratch_path(spark, "versioned")
    save_retail(df, target)
    remove_at_exit(spark, target)
    before = read_retail(spark, target)
    publish_version(ops.clean_sales(before), target)
    now = read_retail(spark, target)
    return reduce(
        DataFrame.unionByName,
        [
            ops.revenue_by_country(rows, "raw").select(F.lit(n).alias("version"), "*")
            for n, rows in ((1, before), (2, now))
        ],
    )


# The month read from the store by month, and the one sent again with other quantities.
_READ_MONTH, _SENT_AGAIN = date(1996, 5, 1), date(1996, 6, 1)


def stored_months(df: DataFrame) -> DataFrame:
    """Store by month, send one month again without its small lines, read two; runs when called."""
    spark = df.sparkSession
    target = scratch_path(spark, "months")
    save_months(df, target)
    remove_at_exit(spark, target)
    sent = read_months(spark, target, _SENT_AGAIN, _SENT_AGAIN)
    replace_months(sent.filter(F.col("quantity") >= 10), target)
    return ops.monthly_revenue(read_months(spark, target, _READ_MONTH, _SENT_AGAIN))


def _summed_up(df: DataFrame) -> SalesSummary:
    """A summary that has taken in the lines as two extracts, the first of them sent twice."""
    spark = df.sparkSession
    target = scratch_path(spark, "summary")
    summary = SalesSummary(spark, target)
    part = F.pmod(F.xxhash64("invoiceno", "stockcode"), F.lit(2))
    for k in (0, 1, 0):
        summary = summary.add(df.filter(part == k), f"part-{k}")
    remove_at_exit(spark, target)
    return summary


def merged_revenue(df: DataFrame) -> DataFrame:
    """Revenue by month and country from the partial sums of three parts of the lines."""
    part = F.pmod(F.xxhash64("invoiceno", "stockcode"), F.lit(3))
    sums = [ops.revenue_partials(df.filter(part == k)) for k in range(3)]
    return ops.revenue_from_partials(ops.merge_partials(*sums), "month", "country")


def merged_invoices(df: DataFrame) -> DataFrame:
    """Distinct invoices by country and month from the bitmaps of two parts of the lines."""
    none = df.sparkSession.createDataFrame([], "invoiceno string, number bigint")
    numbers = ops.new_invoice_numbers(df, none, 1)
    part = F.pmod(F.xxhash64("invoiceno", "stockcode"), F.lit(2))
    maps = [ops.invoice_bitmaps(df.filter(part == k), numbers) for k in range(2)]
    return ops.invoices_from_bitmaps(ops.merge_bitmaps(*maps), "country", "month")


def retype_invoice_date(df: DataFrame) -> DataFrame:
    """Store the table with text dates, then retype it in place; runs when called."""
    spark = df.sparkSession
    path = scratch_path(spark, "retyped")
    save_retail(_raw(df), path)
    remove_at_exit(spark, path)
    retype_table(spark, path)
    return read_retail(spark, path)


def parse_invoice_dates(df: DataFrame) -> DataFrame:
    parsed = ops.with_invoice_timestamp(_raw(df))
    return parsed.select("invoiceno", "stockcode", "invoicedate")


def invoice_months(df: DataFrame) -> DataFrame:
    parsed = ops.with_month(ops.with_invoice_timestamp(_raw(df)))
    return parsed.select("invoiceno", "stockcode", "month")


def dashboard_extracts(df: DataFrame) -> dict[str, DataFrame]:
    """The four result sets meant for a dashboard.

    Each has a row per month, country, bucket or quartile, so each fits a file.
    """
    return {
        "monthly_revenue": ops.month_over_month(ops.monthly_revenue(df)),
        "country_revenue": ops.revenue_by_country(df),
        "invoice_buckets": ops.invoice_bucket_share(df),
        "customer_quartiles": ops.quartile_share(ops.customer_quartiles(df)),
    }


# Row order inside the extracts; by first column where not listed.
EXTRACT_ORDER = {"country_revenue": _REVENUE_ORDER}


def export_extract(df: DataFrame) -> DataFrame:
    """Write the dashboard extracts as CSV and list what the files hold; runs when called.

    One row per extract, key and measure; the key is the first column.
    """
    spark = df.sparkSession
    results = dashboard_extracts(df)
    out_dir = scratch_path(spark, "extracts")
    folders = write_extracts(results, out_dir, single_file=True, order=EXTRACT_ORDER)
    remove_at_exit(spark, out_dir)
    listed = []
    for name, result in results.items():
        written = read_extract(spark, folders[name], result.schema)
        key, *measures = written.columns
        is_month = isinstance(written.schema[key].dataType, T.TimestampNTZType)
        key_text = (F.col(key).cast("date") if is_month else F.col(key)).cast("string")
        values = [F.col(m).cast("double").alias(m) for m in measures]
        listed.append(
            written.select(F.lit(name).alias("extract"), key_text.alias("key"), *values)
            .unpivot(["extract", "key"], measures, "measure", "value")
        )
    return reduce(DataFrame.unionByName, listed)


REPORTS: dict[str, Report] = {
    # load and retype
    "load_csv": load_csv,
    "parse_invoice_dates": parse_invoice_dates,
    "invoice_months": invoice_months,
    "retype_invoice_date": retype_invoice_date,
    "load_csv_with_quarantine": load_csv_with_quarantine,
    "versioned_reload": versioned_reload,
    "stored_months": stored_months,
    # exploration
    "preview_rows": lambda df: ops.preview(df, 10, COLUMNS),
    "row_count": ops.row_count,
    "distinct_invoices": ops.distinct_invoices,
    "date_range": ops.date_range,
    "top_lines_by_quantity": ops.top_lines_by_quantity,
    "top_products": ops.top_products,
    # data quality
    "null_customer_rows": lambda df: ops.quality_rows(df, "customer"),
    "cancelled_rows": lambda df: ops.quality_rows(df, "cancelled"),
    "nonpositive_quantity_rows": lambda df: ops.quality_rows(df, "quantity"),
    "cancelled_count": lambda df: ops.quality_count(df, "cancelled"),
    "nonpositive_quantity_count": lambda df: ops.quality_count(df, "quantity"),
    "nonpositive_price_count": lambda df: ops.quality_count(df, "price"),
    "null_customer_count": lambda df: ops.quality_count(df, "customer"),
    "quality_profile": ops.quality_profile,
    "clean_rows": ops.clean_sales,
    "clean_cancelled_check": ops.clean_cancelled_check,
    # revenue
    "revenue_by_country_raw": lambda df: _sorted(ops.revenue_by_country(df, "raw"), _REVENUE_ORDER),
    "revenue_by_country_positive": lambda df: _sorted(
        ops.revenue_by_country(df, "positive"), _REVENUE_ORDER
    ),
    "revenue_by_country_clean": lambda df: _sorted(ops.revenue_by_country(df, "clean"), _REVENUE_ORDER),
    "monthly_revenue": lambda df: _sorted(ops.monthly_revenue(df), ("month",)),
    "best_worst_month": lambda df: ops.best_worst_month(ops.monthly_revenue(df)),
    "running_total": lambda df: ops.running_total(ops.monthly_revenue(df)),
    "month_over_month": lambda df: ops.month_over_month(ops.monthly_revenue(df)),
    "running_days": lambda df: ops.running_days(ops.daily_revenue(df)),
    "running_invoices": ops.running_invoices,
    "incremental_revenue": merged_revenue,
    "incremental_invoices": merged_invoices,
    "incremental_order_value": lambda df: _summed_up(df).avg_order_value(),
    # orders
    "avg_order_value": lambda df: _sorted(ops.avg_order_value(df), _AVERAGE_ORDER),
    "avg_order_value_with_counts": lambda df: _sorted(
        ops.avg_order_value(df, with_counts=True), _AVERAGE_ORDER
    ),
    "invoice_bucket_counts": ops.invoice_bucket_counts,
    "invoice_bucket_share": ops.invoice_bucket_share,
    "invoice_quartiles": ops.invoice_quartiles,
    # products per country
    "top_lines_by_country": ops.top_lines_by_country,
    "top_products_by_country_rank": ops.top_products_by_country,
    "top_products_by_country_dense_rank": lambda df: ops.top_products_by_country(
        df, method="dense_rank"
    ),
    # customers
    "top_customers": ops.top_customers,
    "customer_quartiles": lambda df: _sorted(ops.customer_quartiles(df), _SPEND_ORDER),
    "quartile_revenue": lambda df: ops.quartile_summary(ops.customer_quartiles(df)).orderBy(
        "rev_quartiles"
    ),
    "quartile_share": lambda df: ops.quartile_share(ops.customer_quartiles(df)),
    # extracts
    "export_extract": export_extract,
}


def publish(df: DataFrame) -> DataFrame:
    """Give a result the types it is reported in: BIGINT, DOUBLE, text, time."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# Reports that read what they need more than once: what is stored for them, and the
# report on that. A view repeats its joins each time it is read. (The largest
# lines are read twice too, but the second time cut down in the line scan, before
# any join.)
SEVERAL_READS: dict[str, tuple[Report, Report]] = {
    "top_lines_by_country": (
        ops.distinct_country_lines,
        lambda lines: ops.top_lines_by_country(lines, distinct=True),
    ),
    "export_extract": (ops.invoice_grain, export_extract),
}


def run_report(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """One report over the star tables in ``folder``."""
    sales = star_sales(spark, folder)
    if name in SEVERAL_READS:
        prepare, report = SEVERAL_READS[name]
        return publish(report(freeze(prepare(sales), name)))
    return publish(REPORTS[name](sales))
