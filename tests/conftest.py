from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tillroll.operators import with_invoice_timestamp  # noqa: E402
from tillroll.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata")

# Thirteen lines that hold one edge case each, as CSV fields in column order.
MINI_ROWS = [
    ("536365", "A1", 'WHITE "HEART", X', "10", "12/1/2010 8:26", "19.99", "17850", "United Kingdom"),
    ("536366", "A2", "CAFÉ TIN", "10", "12/1/2010 9:00", "20.00", "17850", "United Kingdom"),
    ("536367", "A3", "MUG", "100", "1/4/2011 10:00", "10.00", "13047", "United Kingdom"),
    ("536368", "A1", 'WHITE "HEART", X', "10", "1/5/2011 10:00", "5.00", "17850", "EIRE"),
    ("536369", "A2", "CAFÉ TIN", "10", "1/5/2011 11:00", "1.00", "12583", "EIRE"),
    ("536369", "A3", "MUG", "7", "1/5/2011 11:00", "2.00", "12583", "EIRE"),
    ("536369", "A4", None, "5", "1/5/2011 11:00", "1.00", "12583", "EIRE"),
    ("536370", "A5", "PEN", "1", "3/2/2011 0:00", "999.99", "12584", "France"),
    ("C536371", "A3", "MUG", "-7", "1/6/2011 10:00", "2.00", "12583", "EIRE"),
    ("536372", "A6", "damaged", "-3", "1/6/2011 11:00", "0.00", None, "United Kingdom"),
    ("536373", "A7", "FREE GIFT", "5", "1/7/2011 12:00", "0.00", "12584", "France"),
    ("536374", "A1", 'WHITE "HEART", X', "4", "1/8/2011 12:00", "2.50", None, "United Kingdom"),
    ("c536375", "A5", "PEN", "2", "3/3/2011 9:00", "10.00", "12584", "France"),
]
HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"


def csv_bytes(rows, header: str = HEADER) -> bytes:
    def field(value) -> str:
        if value is None:
            return ""
        if '"' in value or "," in value:
            return '"' + value.replace('"', '""') + '"'
        return value

    lines = [header] + [",".join(field(v) for v in row) for row in rows]
    return ("\n".join(lines) + "\n").encode("iso-8859-1")


@pytest.fixture(scope="session")
def spark():
    return local_session("tillroll-tests", cpus=4, memory="6g")


@pytest.fixture(scope="session")
def mini_csv(tmp_path_factory):
    file = tmp_path_factory.mktemp("mini") / "retail.csv"
    file.write_bytes(csv_bytes(MINI_ROWS))
    return str(file)


@pytest.fixture(scope="session")
def mini(spark, mini_csv):
    from tillroll.sources import read_retail_csv

    return with_invoice_timestamp(read_retail_csv(spark, mini_csv)).cache()


def rows(df, *columns):
    """Rows as sorted tuples, decimals as floats."""
    from decimal import Decimal

    picked = df.select(*columns) if columns else df
    found = [
        tuple(float(v) if isinstance(v, Decimal) else v for v in row) for row in picked.collect()
    ]
    return sorted(found, key=lambda row: [(v is None, str(v)) for v in row])
