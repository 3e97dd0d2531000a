"""Retail lines stored by month, so that a report on some months reads their files only."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tillroll.functions import month_start
from tillroll.schema import TYPED_SCHEMA
from tillroll.session import file_system
from tillroll.sources.versions import current_version, publish_tables, version_folders

MONTH = "invoice_month"
LOAD = "load="
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def _write(df: DataFrame, folder: str) -> list[str]:
    """Write month folders and return them.

    Rows are dealt by ranges of month and invoice. A month's files are then few, and a
    month with most of the rows is still written by many tasks.
    """
    spark = df.sparkSession
    dated = df.withColumn(MONTH, month_start(F.col("invoicedate")))
    dated.repartitionByRange(MONTH, "invoiceno").write.partitionBy(MONTH).parquet(folder)
    files, path = file_system(spark, folder)
    names = sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory())
    if not names:
        names = [f"{MONTH}={_NO_MONTH}"]
        df.limit(0).write.parquet(f"{folder}/{names[0]}")
    return [f"{folder}/{name}" for name in names]


def _month_of(folder: str) -> str:
    return folder.rstrip("/").rsplit("/", 1)[-1]


def save_months(df: DataFrame, target: str) -> int:
    """Store the table anew, by month; returns its version. Rows without a date are a month."""
    spark = df.sparkSession
    return publish_tables(spark, target, lambda folder: _write(df, folder), start=LOAD)


def replace_months(df: DataFrame, target: str) -> int:
    """Put the months that ``df`` has in place of the stored ones; the others stay.

    Only the new rows are written; all months change in one step. A month sent again
    so replaces itself. Where another writer has published meanwhile, nothing
    changes and ``VersionConflict`` is raised.
    """
    spark = df.sparkSession
    based_on = current_version(spark, target)
    if based_on is None:
        return save_months(df, target)
    stored = version_folders(spark, target, based_on)

    def write(folder: str) -> Sequence[str]:
        if df.isEmpty():
            return stored
        sent = _write(df, folder)
        months = {_month_of(f) for f in sent}
        return [f for f in stored if _month_of(f) not in months] + sent

    return publish_tables(spark, target, write, based_on, start=LOAD)


def read_months(
    spark: SparkSession,
    target: str,
    first: date | None = None,
    last: date | None = None,
    version: int | None = None,
    schema: T.StructType = TYPED_SCHEMA,
) -> DataFrame:
    """The stored lines, or those of the months from ``first`` to ``last``.

    Any day of a month names it. The bounds are a filter on the folders' month, so files of
    other months are never opened; nor are rows without a date when a bound is given.
    """
    folders = version_folders(spark, target, version)
    whole = T.StructType(
        [
            *schema.fields,
            T.StructField(LOAD.rstrip("="), T.StringType()),
            T.StructField(MONTH, T.DateType()),
        ]
    )
    lines = spark.read.schema(whole).option("basePath", target.rstrip("/")).parquet(*folders)
    if first is not None:
        lines = lines.filter(F.col(MONTH) >= F.lit(first.replace(day=1).isoformat()).cast("date"))
    if last is not None:
        lines = lines.filter(F.col(MONTH) <= F.lit(last.replace(day=1).isoformat()).cast("date"))
    return lines.select(*schema.fieldNames())
