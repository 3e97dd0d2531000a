"""Versioned tables, months and quarantine: one whole version at every step."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from importlib import import_module
from pathlib import Path

import pytest
from conftest import HEADER, MINI_ROWS, csv_bytes, rows
from pyspark.sql import functions as F

from tillroll.operators import monthly_revenue, with_invoice_timestamp
from tillroll.plans.reports import _extract_with_faults
from tillroll.schema import COLUMNS, TYPED_SCHEMA
from tillroll.sources import (
    VersionConflict,
    current_version,
    load_retail_csv,
    publish_version,
    read_months,
    read_quarantine,
    read_retail,
    read_retail_csv,
    release_versions,
    replace_months,
    retype_table,
    save_months,
    save_retail,
    versions,
)

# The package exports a function of the same name.
store = import_module("tillroll.sources.versions")


def test_readers_keep_their_version(spark, mini, tmp_path):
    target = str(tmp_path / "t")
    save_retail(mini, target)
    before = read_retail(spark, target)
    assert publish_version(before.limit(4), target) == 2
    assert (before.count(), read_retail(spark, target).count()) == (13, 4)
    assert read_retail(spark, target, 1).count() == 13
    assert versions(spark, target) == [1, 2]
    assert release_versions(spark, target) == [1] and versions(spark, target) == [2]
    assert read_retail(spark, target).count() == 4
    with pytest.raises(FileNotFoundError):
        read_retail(spark, target, 1)
    with pytest.raises(ValueError):
        release_versions(spark, target, keep=0)


def test_plain_files_are_the_first_version(spark, mini, tmp_path):
    target = str(tmp_path / "t")
    assert current_version(spark, target) is None
    mini.write.parquet(target)
    assert current_version(spark, target) == 0
    save_retail(mini.limit(2), target)
    assert read_retail(spark, target).count() == 13
    save_retail(mini.limit(2), target, mode="overwrite")
    assert read_retail(spark, target).count() == 2 and versions(spark, target) == [0, 1]
    assert release_versions(spark, target) == [0]
    assert not list(Path(target).glob("*.parquet")) and read_retail(spark, target).count() == 2


class Killed(Exception):
    pass


def stop(*_, **__):
    raise Killed


@pytest.mark.parametrize("step", ["data", "before pointer", "half a pointer", "empty pointer"])
def test_a_kill_at_any_step_leaves_one_whole_version(spark, mini, mini_csv, tmp_path, monkeypatch, step):
    target = str(tmp_path / "t")
    raw = read_retail_csv(spark, mini_csv)
    save_retail(raw, target)
    reader = read_retail(spark, target)
    if step == "data":
        bad = raw.withColumn("quantity", F.raise_error(F.lit("lost")).cast("bigint"))
        with pytest.raises(Exception, match="lost"):
            publish_version(bad, target)
    elif step == "before pointer":
        with monkeypatch.context() as patch:
            patch.setattr(store, "point_to", stop)
            with pytest.raises(Killed):
                retype_table(spark, target)
    else:
        # As a writer leaves it that is killed while it writes the pointer.
        folder = Path(store.new_folder(target))
        mini.write.parquet(str(folder))
        half = f"{folder.name}\n" if step == "half a pointer" else ""
        (Path(target) / "_versions" / f"{2:012d}").write_text(half)
    assert current_version(spark, target) == 1
    assert rows(read_retail(spark, target)) == rows(reader) == rows(raw)
    retype_table(spark, target)
    assert rows(read_retail(spark, target)) == rows(mini) and rows(reader) == rows(raw)
    # Nothing that a killed writer left is in the way of the next.
    assert release_versions(spark, target) == [1] and rows(read_retail(spark, target)) == rows(mini)


def test_two_writers(spark, mini, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    save_retail(mini, target)
    publish_version(mini.limit(3), target)
    with pytest.raises(VersionConflict):
        publish_version(mini.limit(1), target, based_on=1)
    # Both saw version 2 and reach for number 3.
    folder = store.new_folder(target)
    mini.limit(5).write.parquet(folder)
    numbers = store._numbers(spark, target)
    store.point_to(spark, target, [folder])
    monkeypatch.setattr(store, "_numbers", lambda *_: numbers)
    with pytest.raises(VersionConflict):
        publish_version(mini.limit(1), target)
    monkeypatch.undo()
    assert read_retail(spark, target).count() == 5
    with pytest.raises(FileExistsError):
        save_retail(mini, target, mode="errorifexists")
    with pytest.raises(ValueError):
        save_retail(mini, target, mode="append")


# Months


def test_months_are_kept_apart_and_replaced(spark, mini, tmp_path):
    target = str(tmp_path / "m")
    save_months(mini, target)
    assert rows(read_months(spark, target)) == rows(mini)
    january = read_months(spark, target, date(2011, 1, 31), date(2011, 1, 1))
    assert rows(january) == rows(mini.filter("month(invoicedate) = 1"))
    # A month sent again replaces itself, as often as it is sent; the others stay.
    sent = january.withColumn("quantity", F.col("quantity") + 1)
    for _ in range(2):
        replace_months(read_months(spark, target, date(2011, 1, 1), date(2011, 1, 1), 1)
                       .withColumn("quantity", F.col("quantity") + 1), target)
        want = mini.filter("month(invoicedate) <> 1").unionByName(sent)
        assert rows(read_months(spark, target)) == rows(want)
    assert rows(read_months(spark, target, version=1)) == rows(mini)
    assert release_versions(spark, target) == [1, 2]
    assert read_months(spark, target).count() == 13


def test_a_report_on_a_month_opens_its_files_only(spark, mini, tmp_path):
    target = str(tmp_path / "m")
    save_months(mini, target)
    replace_months(mini.filter("month(invoicedate) = 3"), target)
    report = monthly_revenue(read_months(spark, target, date(2011, 1, 1), date(2011, 1, 1)))
    plan = report._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("PushedFilters", 1)[0]
    assert "invoice_month" in filters and ">= 2011-01-01" in filters
    read = read_months(spark, target, date(2011, 1, 1), date(2011, 1, 1))
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert files and all("invoice_month=2011-01-01" in f for f in files)


def test_months_without_dates_and_without_rows(spark, mini, tmp_path):
    undated = mini.withColumn("invoicedate", F.lit(None).cast("timestamp_ntz"))
    target = str(tmp_path / "m")
    save_months(mini.limit(0), target)
    assert read_months(spark, target).collect() == []
    assert read_months(spark, target).schema == TYPED_SCHEMA
    replace_months(mini.unionByName(undated), target)
    assert read_months(spark, target).count() == 26
    assert read_months(spark, target, date(1, 1, 1)).count() == 13
    replace_months(mini.limit(0), target)
    assert read_months(spark, target).count() == 26


# Quarantine

BAD = [
    ("quantity", ("536380", "A1", "MUG", "ten", "12/1/2010 8:26", "1.00", "17850", "EIRE")),
    ("quantity", ("536380", "A1", "MUG", " 7", "12/1/2010 8:26", "1.00", "17850", "EIRE")),
    ("quantity", ("536380", "A1", "MUG", "9" * 20, "12/1/2010 8:26", "1.00", "17850", "EIRE")),
    ("invoicedate", ("536381", "A1", "MUG", "1", "2/30/2011 8:26", "1.00", "17850", "EIRE")),
    ("invoicedate", ("536381", "A1", "MUG", "1", "2011-02-03", "1.00", "17850", "EIRE")),
    ("unitprice", ("536382", "A1", "MUG", "1", "2/3/2011 8:26", "0.00004", "17850", "EIRE")),
    ("unitprice", ("536382", "A1", "MUG", "1", "2/3/2011 8:26", "1e-30", "17850", "EIRE")),
    ("customerid", ("536383", "A1", "MUG", "1", "2/3/2011 8:26", "1.00", "x", "EIRE")),
    ("fields", ("536384", "A1", "MUG", "1", "2/3/2011 8:26", "1.00", "17850")),
    ("fields", ("536384", "A1", "MUG", "1", "2/3/2011 8:26", "1.00", "17850", "EIRE", "more")),
    ("fields", ("just a line",)),
]


def test_good_and_quarantined_are_all_lines(spark, mini, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_bytes(csv_bytes(MINI_ROWS[:6] + [r for _, r in BAD[:5]]))
    (folder / "b.csv").write_bytes(csv_bytes([r for _, r in BAD[5:]] + MINI_ROWS[6:]))
    target = str(tmp_path / "t")
    report = load_retail_csv(spark, str(folder), target)
    want: dict = {}
    for reason, _ in BAD:
        want[reason] = want.get(reason, 0) + 1
    assert report.quarantined == want and report.good == 13 and report.lines == 13 + len(BAD)
    assert rows(read_retail(spark, target)) == rows(mini)
    assert read_retail(spark, target).schema == TYPED_SCHEMA
    aside = read_quarantine(spark, target).collect()
    assert sorted((r.reason, r.line) for r in aside) == sorted((w, ",".join(r)) for w, r in BAD)
    assert {(r.reason, Path(r.file).name) for r in aside} >= {("quantity", "a.csv"), ("fields", "b.csv")}


def test_no_fault_no_row_and_only_faults(spark, mini, mini_csv, tmp_path):
    target = str(tmp_path / "t")
    assert load_retail_csv(spark, mini_csv, target).quarantined == {}
    assert rows(read_retail(spark, target)) == rows(mini)
    assert read_quarantine(spark, target).collect() == []
    for name, lines, good in (("none", [], 0), ("bad", [BAD[0][1]], 0)):
        (tmp_path / name).write_bytes(csv_bytes(lines))
        report = load_retail_csv(spark, str(tmp_path / name), target)
        assert report.good == good and read_retail(spark, target).count() == good
    publish_version(mini, target)
    assert read_quarantine(spark, target).collect() == []


def test_a_load_that_is_refused_changes_nothing(spark, mini, mini_csv, tmp_path):
    target = str(tmp_path / "t")
    load_retail_csv(spark, mini_csv, target)
    (tmp_path / "bad").write_bytes(csv_bytes(MINI_ROWS[:3] + [BAD[0][1]]))
    with pytest.raises(ValueError, match="do not fit"):
        load_retail_csv(spark, str(tmp_path / "bad"), target, most_bad=0.2)
    other = "StockCode,InvoiceNo," + HEADER.split(",", 2)[2]
    (tmp_path / "other").write_bytes(csv_bytes(MINI_ROWS, header=other))
    with pytest.raises(ValueError, match="header"):
        load_retail_csv(spark, str(tmp_path / "other"), target)
    assert versions(spark, target) == [1] and rows(read_retail(spark, target)) == rows(mini)
    assert load_retail_csv(spark, str(tmp_path / "bad"), target, most_bad=0.25).good == 3


def test_quarantine_and_strict_load_agree(spark, mini_csv, tmp_path):
    target = str(tmp_path / "t")
    load_retail_csv(spark, mini_csv, target)
    strict = with_invoice_timestamp(read_retail_csv(spark, mini_csv))
    assert rows(read_retail(spark, target)) == rows(strict)
    assert read_retail(spark, target).filter("invoiceno = '536366'").first().description == "CAFÉ TIN"
    assert read_retail(spark, target).agg(F.max("invoicedate")).first()[0] == datetime(2011, 3, 3, 9)


def _numbered_lines(spark, n):
    return spark.range(n).repartition(4).select(
        F.col("id").cast("string").alias("invoiceno"), F.col("id").cast("string").alias("stockcode"),
        F.lit('a "b", c').alias("description"), F.lit(2).cast("bigint").alias("quantity"),
        F.lit(datetime(2011, 1, 1)).cast("timestamp_ntz").alias("invoicedate"),
        F.lit(Decimal("1.0000")).cast("decimal(12,4)").alias("unitprice"),
        F.lit(7).cast("bigint").alias("customerid"), F.lit("EIRE").alias("country"),
    )


@pytest.mark.parametrize("n", [0, 4, 4000])
def test_lines_with_a_field_too_many_are_written_by_all_tasks(spark, tmp_path, n):
    path = str(tmp_path / "extract")
    _extract_with_faults(_numbered_lines(spark, n), path)
    texts = [file.read_text("utf-8").splitlines() for file in Path(path).glob("part-*")]
    texts = [lines for lines in texts if lines]
    assert all(lines[0] == ",".join(COLUMNS) for lines in texts)
    assert sum(len(lines) - 1 for lines in texts) == n
    long = [lines for lines in texts if any(line.endswith(",x") for line in lines)]
    assert sum(line.endswith(",x") for lines in long for line in lines) == n // 40
    assert len(long) == (4 if n == 4000 else 0)
    report = load_retail_csv(spark, path, str(tmp_path / "loaded"), empty_is_null=False)
    # Of each 40 lines, one has each of the four faults; four lines have three of them.
    faults = {kind: -(-n // 40) for kind in ("quantity", "invoicedate", "unitprice") if n}
    if n >= 40:
        faults["fields"] = n // 40
    assert (report.good, report.quarantined) == (n - sum(faults.values()), faults)
