"""Loading, saving and opening the retail line-item table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tillroll.operators.shape import with_invoice_timestamp
from tillroll.schema import CSV_ENCODING, PRICE_TYPE, RAW_SCHEMA
from tillroll.sources.versions import current_version, publish_version, version_folders

# More decimals than any price list; what a text has beyond shows in its digits.
_WIDE_PRICE = T.DecimalType(38, 18)
_FAR_DECIMALS = r"\.\d{18}\d*[1-9]|[eE]-"
# Never found in a field: with it, an empty field in quotes is empty text, not NULL.
NO_TEXT = "\u0001"
BLANKS_KEPT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _price(text: Column, kind: T.DecimalType) -> Column:
    """A price from its text, or an error where the type cannot hold it exactly."""
    return F.coalesce(
        exact_price(text, kind),
        F.when(
            text.isNotNull(),
            F.raise_error(F.concat(F.lit(f"not a price of type {kind.simpleString()}: "), text)),
        ),
    )


def exact_price(text: Column, kind: T.DecimalType) -> Column:
    """A price from its text, or NULL where the type cannot hold it exactly.

    A short text without an exponent has no decimals beyond the wide type's, so the pattern
    that looks for them is spared.
    """
    text = F.trim(text)
    wide = text.try_cast(_WIDE_PRICE)
    price = wide.try_cast(kind)
    plain = (F.length(text) <= _WIDE_PRICE.scale) & ~text.contains("e") & ~text.contains("E")
    exact = (wide == price) & (plain | ~text.rlike(_FAR_DECIMALS))
    return F.when(exact, price)


def read_retail_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_SCHEMA,
    encoding: str = CSV_ENCODING,
    price_type: T.DecimalType = PRICE_TYPE,
    multi_line: bool = False,
    empty_is_null: bool = True,
) -> DataFrame:
    """Scan a CSV extract with a declared schema.

    No inference pass is made. Quotes inside a field are doubled, the header
    must name the schema's columns in order (in any case), and a field that
    does not fit its type is an error rather than a NULL. So is a price with more
    decimals than ``price_type``, which is never rounded. Blanks around a text are kept.

    ``multi_line`` takes line breaks inside quotes; a file is then read by one task, so
    files should be of bounded size. Without ``empty_is_null``, an empty field in
    quotes is empty text and only one without quotes is NULL.
    """
    as_text = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == "unitprice" else f.dataType)
            for f in schema
        ]
    )
    rows = spark.read.csv(
        path,
        schema=as_text,
        header=True,
        enforceSchema=False,
        encoding=encoding,
        escape='"',
        multiLine=multi_line,
        nullValue="" if empty_is_null else NO_TEXT,
        mode="FAILFAST",
        **BLANKS_KEPT,
    )
    return rows.withColumn("unitprice", _price(F.col("unitprice"), price_type))


def write_retail_csv(df: DataFrame, path: str, encoding: str = CSV_ENCODING) -> None:
    """Write an extract that ``read_retail_csv`` gives back as it was.

    NULL is an empty field and empty text one in quotes. Text that Latin-1 cannot
    hold is an error where that is the encoding. A table with line breaks
    in its texts must be read with ``multi_line``.
    """
    if encoding.upper() == CSV_ENCODING:
        outside = r"[^\x{00}-\x{FF}]"
        for field in df.schema:
            if isinstance(field.dataType, T.StringType):
                text = F.col(field.name)
                error = F.raise_error(F.concat(F.lit(f"not in {encoding}: "), text))
                df = df.withColumn(field.name, F.when(text.rlike(outside), error).otherwise(text))
    df.write.csv(path, header=True, encoding=encoding, escape='"', **BLANKS_KEPT)


def _is_path(target: str) -> bool:
    return "/" in target


def read_retail(spark: SparkSession, source: str, version: int | None = None) -> DataFrame:
    """Open a stored table by path (Parquet) or by one- to three-part name.

    Column names come back in lower case. Renames alone do not stop filters
    and column pruning from reaching the files. Of a path the current version is read, or
    the one named. Columns whose names start with an underscore are a loader's own
    and are left out.
    """
    if _is_path(source):
        df = spark.read.parquet(*version_folders(spark, source, version))
    else:
        df = spark.table(source)
    kept = [name for name in df.columns if not name.startswith("_")]
    return df.select(*[F.col(f"`{name}`").alias(name.lower()) for name in kept])


def save_retail(df: DataFrame, target: str, mode: str = "ignore") -> None:
    """Store a table as Parquet under a path or a catalog name.

    ``ignore`` keeps a table that exists, ``errorifexists`` refuses, ``overwrite`` rebuilds it.
    Under a path the rows become the next version of the table, in one step: readers see
    the old one or the new one whole, whenever the job ends, and the rows may come
    from the table itself. Old versions stay until ``release_versions``. A catalog table
    refuses to be overwritten by its own rows.
    """
    if not _is_path(target):
        df.write.mode(mode).format("parquet").saveAsTable(target)
        return
    if mode not in ("ignore", "errorifexists", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode != "overwrite" and current_version(df.sparkSession, target) is not None:
        if mode == "errorifexists":
            raise FileExistsError(target)
        return
    publish_version(df, target)


def _quoted(table: str) -> str:
    return ".".join(f"`{part}`" for part in table.split("."))


def retype_table(spark: SparkSession, target: str) -> None:
    """Turn the text invoice dates of a stored table into timestamps, in place.

    A date that is none is an error and leaves the table as it was. A table
    that is typed already is left alone, so the step can be repeated. Under a path the typed
    rows become the next version, unless another was published meanwhile, which is an
    error. A catalog table is built under another name and takes the old one's place
    when complete.
    """
    based_on = current_version(spark, target) if _is_path(target) else None
    stored = read_retail(spark, target, based_on)
    if not isinstance(stored.schema["invoicedate"].dataType, T.StringType):
        return
    typed = with_invoice_timestamp(stored)
    if _is_path(target):
        publish_version(typed, target, based_on)
        return
    mark = uuid.uuid4().hex
    made, before = f"{target}_new_{mark}", f"{target}_old_{mark}"
    try:
        save_retail(typed, made, mode="errorifexists")
    except Exception:
        drop_retail(spark, made)
        raise
    spark.sql(f"ALTER TABLE {_quoted(target)} RENAME TO {_renamed(before)}")
    spark.sql(f"ALTER TABLE {_quoted(made)} RENAME TO {_renamed(target)}")
    drop_retail(spark, before)


def _renamed(table: str) -> str:
    """The new name of a table as RENAME takes it: without the session catalog."""
    return _quoted(table.removeprefix("spark_catalog."))


def open_or_create(spark: SparkSession, target: str, build) -> DataFrame:
    """Open a stored table; where there is none yet, store what ``build()`` gives first.

    Reports then read one stored table instead of repeating the work behind it.
    """
    if _is_path(target):
        stored = current_version(spark, target) is not None
    else:
        stored = spark.catalog.tableExists(target)
    if not stored:
        save_retail(build(), target)
    return read_retail(spark, target)


def drop_retail(spark: SparkSession, table: str) -> None:
    """Drop a catalog table if it exists."""
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(table)}")
