"""Writing result sets for reporting tools."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tillroll.functions import order_columns

# A space between date and time is what spreadsheet and dashboard tools expect.
_CSV_FORMAT = {
    "header": True,
    "escape": '"',
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# An empty field is NULL and one in quotes is empty text; a mark that no field holds
# keeps the reader from taking both for NULL. Extracts are of bounded size, so
# line breaks inside quotes may be allowed.
_CSV_READ = {"nullValue": "\u0001", "multiLine": True}


def write_extracts(
    results: Mapping[str, DataFrame],
    out_dir: str,
    fmt: str = "csv",
    single_file: bool = False,
    order: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """Write each result to ``out_dir/<name>`` and return the folders.

    A result is written from the partitions it has, in parallel. For finished
    summaries of a few rows, which reporting tools want in one piece,
    ``single_file`` moves them to one file, sorted by the columns ``order``
    names for the result or else by its first column. The move is a shuffle of
    its own, so the work before it keeps its parallelism.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown extract format {fmt!r}")
    folders = {}
    for name, df in results.items():
        folder = f"{out_dir.rstrip('/')}/{name}"
        if single_file:
            by = (order or {}).get(name, df.columns[:1])
            df = df.repartition(1).sortWithinPartitions(*order_columns(by))
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.options(**_CSV_FORMAT).csv(folder)
        else:
            writer.parquet(folder)
        folders[name] = folder
    return folders


def read_extract(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "csv"
) -> DataFrame:
    """Open an extract again, with the schema it was written from."""
    if fmt == "csv":
        reader = spark.read.schema(schema).options(**_CSV_FORMAT, **_CSV_READ, mode="FAILFAST")
        return reader.csv(folder)
    return spark.read.schema(schema).parquet(folder)
