"""Reading and writing retail tables."""

from tillroll.sources.retail import (
    drop_retail,
    open_or_create,
    read_retail,
    read_retail_csv,
    retype_table,
    save_retail,
    write_retail_csv,
)
from tillroll.sources.extracts import read_extract, write_extracts
from tillroll.sources.months import read_months, replace_months, save_months
from tillroll.sources.quarantine import LoadReport, load_retail_csv, read_quarantine
from tillroll.sources.star import star_sales
from tillroll.sources.summary import SalesSummary
from tillroll.sources.versions import (
    VersionConflict,
    current_version,
    publish_version,
    release_versions,
    versions,
)

__all__ = [
    "LoadReport",
    "SalesSummary",
    "VersionConflict",
    "current_version",
    "drop_retail",
    "load_retail_csv",
    "open_or_create",
    "publish_version",
    "read_extract",
    "read_months",
    "read_quarantine",
    "read_retail",
    "read_retail_csv",
    "release_versions",
    "replace_months",
    "retype_table",
    "save_months",
    "save_retail",
    "star_sales",
    "versions",
    "write_extracts",
    "write_retail_csv",
]
