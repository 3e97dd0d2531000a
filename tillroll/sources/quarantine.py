"""Loading extracts past lines that do not fit, which are kept aside with the reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tillroll.functions import parse_invoice_date
from tillroll.schema import CSV_ENCODING, PRICE_TYPE, TYPED_SCHEMA
from tillroll.session import file_system
from tillroll.sources.retail import BLANKS_KEPT, NO_TEXT, exact_price
from tillroll.sources.versions import publish_tables, version_folders

_HEADER = "header"
_KEPT, _ASIDE = "_aside=0", "_aside=1"
_NOTES = "line string, file string, reason string"


@dataclass(frozen=True)
class LoadReport:
    """What a load did: its version of the table, lines stored, and lines kept aside by reason."""

    version: int
    good: int
    quarantined: dict[str, int]

    @property
    def lines(self) -> int:
        return self.good + sum(self.quarantined.values())


def _whole_number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def checked_lines(
    spark: SparkSession,
    path: str,
    encoding: str = CSV_ENCODING,
    price_type: T.DecimalType = PRICE_TYPE,
    empty_is_null: bool = True,
) -> DataFrame:
    """Every line of an extract: the typed columns, and ``_line``, ``_file`` and ``_reason``.

    ``_reason`` is null for a line that fits, ``header`` for one that names the columns in
    order, ``fields`` for one with another number of fields, else the first column whose
    text is none of its type; ``_line`` and ``_file`` are set where it is. A record is a line:
    one that has a line break inside quotes does not fit.
    """
    names = TYPED_SCHEMA.fieldNames()
    lines = spark.read.text(path).select(
        F.decode(F.col("value").cast("binary"), encoding).alias("_line"),
        F.col("_metadata.file_path").alias("_file"),
    )
    as_text = ", ".join([*(f"`{name}` string" for name in names), "_bad string"])
    options = {
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_bad",
        "nullValue": "" if empty_is_null else NO_TEXT,
        **{name: str(value).lower() for name, value in BLANKS_KEPT.items()},
    }
    fields = lines.filter(F.col("_line") != "").withColumn(
        "_fields", F.from_csv("_line", as_text, options)
    )
    text = {name: F.col(f"_fields.{name}") for name in names}
    typed = text | {
        "quantity": _whole_number(text["quantity"]),
        "invoicedate": parse_invoice_date(text["invoicedate"], strict=False),
        "unitprice": exact_price(text["unitprice"], price_type),
        "customerid": _whole_number(text["customerid"]),
    }
    is_header = F.lower(F.concat_ws(",", *text.values())) == ",".join(names)
    reason = F.when(is_header, _HEADER).when(F.col("_fields._bad").isNotNull(), "fields")
    # An open quote takes the marks after it into one field.
    for name in names:
        if typed[name] is not text[name]:
            reason = reason.when(text[name].isNotNull() & typed[name].isNull(), name)
    found = fields.withColumn("_reason", reason)
    bad = F.col("_reason").isNotNull()
    return found.select(
        *[F.when(~bad, typed[name]).alias(name) for name in names],
        F.when(bad, F.col("_line")).alias("_line"),
        F.when(bad, F.col("_file")).alias("_file"),
        "_reason",
    )


def load_retail_csv(
    spark: SparkSession,
    path: str,
    target: str,
    most_bad: float = 1.0,
    encoding: str = CSV_ENCODING,
    price_type: T.DecimalType = PRICE_TYPE,
    empty_is_null: bool = True,
) -> LoadReport:
    """Load an extract as the next version of a stored table, past lines that do not fit.

    The extract is read and written once; good lines and those kept aside, with their raw text,
    file and reason, land in two folders of the same version, and good plus quarantined
    lines are all lines but the headers. Nothing is published if a file lacks its
    header or if more than the share ``most_bad`` of the lines would be kept aside.
    Empty lines are no lines. ``read_quarantine`` opens what was kept aside.
    """
    checked = checked_lines(spark, path, encoding, price_type, empty_is_null)
    told: dict[str | None, int] = {}

    def write(folder: str) -> Sequence[str]:
        aside = F.when(F.col("_reason").isNull(), 0).otherwise(1)
        checked.withColumn("_aside", aside).write.partitionBy("_aside").parquet(folder)
        files, _ = file_system(spark, folder)
        for part in (_KEPT, _ASIDE):
            if not files.exists(file_system(spark, f"{folder}/{part}")[1]):
                checked.limit(0).write.parquet(f"{folder}/{part}")
        counts = spark.read.schema(checked.schema).parquet(f"{folder}/{_KEPT}", f"{folder}/{_ASIDE}")
        for row in counts.groupBy("_reason").agg(F.count(F.lit(1)).alias("n")).collect():
            told[row._reason] = row.n
        notes = spark.read.schema(checked.schema).parquet(f"{folder}/{_ASIDE}")
        headed = notes.filter(F.col("_reason") == _HEADER).select("_file").distinct().count()
        held = spark.read.text(path).filter("value != ''").select("_metadata.file_path").distinct()
        if headed != (files_read := held.count()):
            raise ValueError(f"{files_read - headed} of {files_read} files lack the header")
        bad = sum(n for why, n in told.items() if why not in (None, _HEADER))
        if bad > most_bad * (bad + told.get(None, 0)):
            raise ValueError(f"{bad} lines do not fit, more than the share {most_bad}: {told}")
        return [f"{folder}/{_KEPT}"]

    version = publish_tables(spark, target, write)
    bad = {why: n for why, n in told.items() if why not in (None, _HEADER)}
    return LoadReport(version, told.get(None, 0), bad)


def read_quarantine(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """``line``, ``file`` and ``reason`` of the lines a load kept aside."""
    (kept,) = version_folders(spark, target, version)
    if not kept.endswith(_KEPT):
        return spark.createDataFrame([], _NOTES)
    rows = spark.read.parquet(kept.removesuffix(_KEPT) + _ASIDE)
    return rows.filter(F.col("_reason") != _HEADER).select(
        F.col("_line").alias("line"), F.col("_file").alias("file"), F.col("_reason").alias("reason")
    )
