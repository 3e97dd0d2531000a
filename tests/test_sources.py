"""Loading, storing and exporting."""

from __future__ import annotations

import uuid
from datetime import datetime

import pytest
from conftest import MINI_ROWS, csv_bytes, rows
from pyspark.sql.functions import lit
from pyspark.sql.types import DecimalType

from tillroll.functions import as_invoice_text
from tillroll.operators import clean_sales, with_invoice_timestamp
from tillroll.plans.reports import dashboard_extracts, export_extract
from tillroll.schema import RAW_SCHEMA, TYPED_SCHEMA
from tillroll.sources import (
    drop_retail,
    open_or_create,
    read_extract,
    read_retail,
    read_retail_csv,
    retype_table,
    save_retail,
    write_extracts,
    write_retail_csv,
)


def test_csv_is_read_as_declared(spark, mini_csv):
    df = read_retail_csv(spark, mini_csv)
    assert df.schema == RAW_SCHEMA
    by_invoice = {r.invoiceno: r for r in df.collect()}
    assert len(by_invoice) == 11
    assert by_invoice["536365"].description == 'WHITE "HEART", X'
    assert by_invoice["536366"].description == "CAFÉ TIN"
    assert by_invoice["536372"].customerid is None
    assert by_invoice["536365"].invoicedate == "12/1/2010 8:26"
    assert with_invoice_timestamp(df).schema == TYPED_SCHEMA


def bad_csv(tmp_path, rows_, **kwargs):
    file = tmp_path / "bad.csv"
    file.write_bytes(csv_bytes(rows_, **kwargs))
    return str(file)


def test_csv_with_a_word_for_a_number_is_refused(spark, tmp_path):
    broken = [(*MINI_ROWS[0][:3], "ten", *MINI_ROWS[0][4:])]
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST"):
        read_retail_csv(spark, bad_csv(tmp_path, broken)).collect()


def test_csv_with_other_columns_is_refused(spark, tmp_path):
    header = "StockCode,InvoiceNo,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"
    with pytest.raises(Exception, match="header"):
        read_retail_csv(spark, bad_csv(tmp_path, MINI_ROWS, header=header)).collect()


def test_save_keeps_or_rebuilds(spark, mini, tmp_path):
    path = str(tmp_path / "retail")
    save_retail(mini, path)
    save_retail(mini.limit(1), path)
    assert read_retail(spark, path).count() == 13
    save_retail(mini.limit(1), path, mode="overwrite")
    assert read_retail(spark, path).count() == 1


def test_catalog_table_by_short_and_full_name(spark, mini):
    name = f"retail_{uuid.uuid4().hex}"
    mixed = mini.toDF(*[c.upper() for c in mini.columns])
    save_retail(mixed, name)
    try:
        for source in (name, f"default.{name}", f"spark_catalog.default.{name}"):
            df = read_retail(spark, source)
            assert df.columns == mini.columns
            assert clean_sales(df).count() == 9
    finally:
        drop_retail(spark, f"default.{name}")
    assert not spark.catalog.tableExists(name)
    drop_retail(spark, name)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_extracts_come_back_as_written(spark, mini, tmp_path, fmt):
    results = dashboard_extracts(mini)
    folders = write_extracts(results, str(tmp_path), fmt, single_file=True)
    assert set(folders) == {
        "monthly_revenue", "country_revenue", "invoice_buckets", "customer_quartiles"
    }
    for name, df in results.items():
        files = list((tmp_path / name).glob(f"*.{fmt}"))
        assert len(files) == 1
        assert rows(read_extract(spark, folders[name], df.schema, fmt)) == rows(df)


def test_csv_extract_has_header_and_sorted_rows(mini, tmp_path):
    results = {"months": dashboard_extracts(mini)["monthly_revenue"]}
    write_extracts(results, str(tmp_path), single_file=True)
    (file,) = (tmp_path / "months").glob("*.csv")
    lines = file.read_text().splitlines()
    assert lines[0] == "month,total_revenue,previous_month,revenue_change"
    assert [line[:19] for line in lines[1:]] == [
        "2010-12-01 00:00:00", "2011-01-01 00:00:00", "2011-03-01 00:00:00"
    ]


def test_csv_extract_can_be_sorted_otherwise(mini, tmp_path):
    results = {"countries": dashboard_extracts(mini)["country_revenue"]}
    order = {"countries": ["-total_revenue"]}
    write_extracts(results, str(tmp_path), single_file=True, order=order)
    (file,) = (tmp_path / "countries").glob("*.csv")
    countries = [line.split(",")[0] for line in file.read_text().splitlines()[1:]]
    assert countries == ["United Kingdom", "France", "EIRE"]


def test_large_extract_keeps_its_partitions(mini, tmp_path):
    results = {"lines": mini.repartition(3)}
    write_extracts(results, str(tmp_path), "parquet")
    assert len(list((tmp_path / "lines").glob("*.parquet"))) == 3


def test_unknown_extract_format(mini, tmp_path):
    with pytest.raises(ValueError):
        write_extracts({"x": mini}, str(tmp_path), "xlsx")


def with_price(price: str):
    return [(*MINI_ROWS[0][:5], price, *MINI_ROWS[0][6:])]


@pytest.mark.parametrize("price", ["0.00004", "0.00006", "ten", "1" * 13, "1e-30", "0." + "0" * 20 + "1"])
def test_a_price_that_does_not_fit_is_refused(spark, tmp_path, price):
    with pytest.raises(Exception, match="not a price of type"):
        read_retail_csv(spark, bad_csv(tmp_path, with_price(price))).collect()


def test_the_price_type_is_a_parameter(spark, tmp_path):
    file = bad_csv(tmp_path, with_price("0.00006"))
    df = read_retail_csv(spark, file, price_type=DecimalType(14, 6))
    assert str(df.first().unitprice) == "0.000060"
    exact = read_retail_csv(spark, bad_csv(tmp_path, with_price("1.50000")))
    assert str(exact.first().unitprice) == "1.5000"


ODD_TEXTS = [
    " MUG", "MUG ", "", None, 'A "B" C', '"', "a,b", "back\\slash", "two\nlines", "cr\rhere",
    "crlf\r\nhere", "caf\xe9", "\xff", "  ", "NULL", "#x", "\\",
]


def odd_sales(spark, texts):
    made = [
        (str(i), f"s{i}", t, 1, None if i % 3 == 0 else datetime(2011, 1, 1, 8, i), 1, 7, t)
        for i, t in enumerate(texts)
    ]
    schema = "i string, s string, d string, q long, t timestamp_ntz, p int, c long, n string"
    df = spark.createDataFrame(made, schema)
    return df.select(
        df.i.alias("invoiceno"), df.s.alias("stockcode"), df.d.alias("description"),
        df.q.alias("quantity"), df.t.alias("invoicedate"),
        df.p.cast("decimal(12,4)").alias("unitprice"), df.c.alias("customerid"),
        df.n.alias("country"),
    )


def test_csv_gives_back_odd_texts(spark, tmp_path):
    df = odd_sales(spark, ODD_TEXTS)
    text = df.withColumn("invoicedate", as_invoice_text(df.invoicedate))
    write_retail_csv(text, str(tmp_path / "x"))
    again = read_retail_csv(spark, str(tmp_path / "x"), multi_line=True, empty_is_null=False)
    assert rows(with_invoice_timestamp(again)) == rows(df)


def test_text_outside_the_encoding_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="not in ISO-8859-1"):
        write_retail_csv(odd_sales(spark, ["\u20ac 5"]), str(tmp_path / "x"))


def test_extract_keeps_countries_apart(spark, tmp_path):
    countries = [" EIRE ", "EIRE", "", None, "a\nb"]
    df = odd_sales(spark, countries)
    listed = export_extract(df).filter("extract = 'country_revenue'")
    assert sorted(map(str, (r.key for r in listed.collect()))) == sorted(map(str, countries))


def test_overwriting_what_is_read_keeps_the_rows(spark, mini, tmp_path):
    path = str(tmp_path / "self")
    save_retail(mini, path)
    save_retail(read_retail(spark, path).filter("quantity > 0"), path, mode="overwrite")
    assert read_retail(spark, path).count() == mini.filter("quantity > 0").count()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["self"]


@pytest.mark.parametrize("place", ["path", "catalog"])
def test_retype_in_place(spark, mini, mini_csv, tmp_path, place):
    target = str(tmp_path / "t") if place == "path" else f"retail_{uuid.uuid4().hex}"
    save_retail(read_retail_csv(spark, mini_csv), target)
    try:
        for _ in range(2):
            retype_table(spark, target)
            assert read_retail(spark, target).schema["invoicedate"].dataType.typeName() == "timestamp_ntz"
            assert rows(read_retail(spark, target)) == rows(mini)
    finally:
        if place == "catalog":
            drop_retail(spark, target)


@pytest.mark.parametrize("place", ["path", "catalog"])
def test_a_bad_date_leaves_the_table_whole(spark, mini_csv, tmp_path, place):
    target = str(tmp_path / "t") if place == "path" else f"retail_{uuid.uuid4().hex}"
    raw = read_retail_csv(spark, mini_csv)
    bad = raw.limit(1).withColumn("invoicedate", lit("13/45/2011 8:26"))
    save_retail(raw.unionByName(bad), target)
    try:
        before = rows(read_retail(spark, target))
        with pytest.raises(Exception, match="cannot parse as"):
            retype_table(spark, target)
        assert rows(read_retail(spark, target)) == before
        if place == "path":
            assert [p.name for p in tmp_path.iterdir()] == ["t"]
    finally:
        if place == "catalog":
            drop_retail(spark, target)


def test_open_or_create_builds_once(spark, mini, tmp_path):
    built = []

    def build():
        built.append(1)
        return mini

    for _ in range(2):
        assert open_or_create(spark, str(tmp_path / "t"), build).count() == 13
    assert built == [1]
