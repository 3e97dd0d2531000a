"""Column names and types of the retail line-item table.

One row is one product line of one invoice; an order is one ``invoiceno``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Four decimals, because real price lists hold sub-penny prices (0.001) that a
# two-decimal type would round to zero, and so out of the cleaned set. Twelve
# digits keep price * 10000 within 18 digits, which Spark stores as one long.
PRICE_TYPE = T.DecimalType(12, 4)


def _retail_schema(date_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("invoiceno", T.StringType()),
            T.StructField("stockcode", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("quantity", T.LongType()),
            T.StructField("invoicedate", date_type),
            T.StructField("unitprice", PRICE_TYPE),
            T.StructField("customerid", T.LongType()),
            T.StructField("country", T.StringType()),
        ]
    )


# As found in a CSV extract: the invoice date is still text.
RAW_SCHEMA = _retail_schema(T.StringType())
# As analysed: the invoice date is a zone-free timestamp.
TYPED_SCHEMA = _retail_schema(T.TimestampNTZType())

COLUMNS = TYPED_SCHEMA.fieldNames()

# They decide results, so they must not drift.
CANCELLED_PREFIX = "C"
DATE_PATTERN = "M/d/yyyy H:m"
CSV_ENCODING = "ISO-8859-1"
# (name, lower edge inclusive, upper edge exclusive); None is open.
INVOICE_BUCKETS = (
    ("Small", None, 200),
    ("Medium", 200, 1000),
    ("Large", 1000, None),
)
