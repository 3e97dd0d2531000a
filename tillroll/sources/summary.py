"""Stored summaries of all extracts so far, brought up to date by a new extract alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.operators import partials
from tillroll.session import freeze, release
from tillroll.sources.versions import current_version, publish_together, version_folders

_TABLES = ("revenue", "invoices", "bitmaps", "extracts")


class SalesSummary:
    """Partial sums, invoice numbers and invoice bitmaps in one versioned folder.

    All are of the same version, so a reader never sees sums of one extract with the invoices of
    another. Opening it reads the version that is current then.
    """

    def __init__(self, spark: SparkSession, target: str):
        self._spark, self._target = spark, target.rstrip("/")
        self.version = current_version(spark, self._target)

    def _table(self, name: str) -> DataFrame:
        (folder,) = version_folders(self._spark, self._target, self.version)
        return self._spark.read.parquet(f"{folder}/{name}")

    @property
    def extracts(self) -> list[str]:
        """Names of the extracts taken in so far."""
        if self.version is None:
            return []
        return sorted(r.extract for r in self._table("extracts").collect())

    def add(self, extract: DataFrame, name: str) -> SalesSummary:
        """The summary with one more extract, stored as the next version.

        Only the extract and the stored summaries are read. An extract with a name that
        was taken in before is left out, so a job may be repeated after a failure. If
        another writer was faster nothing is stored and ``VersionConflict`` is raised.
        """
        known = self.extracts
        if name in known:
            return self
        sums = partials.revenue_partials(extract)
        spark = self._spark
        if self.version is None:
            numbers = spark.createDataFrame([], "invoiceno string, number bigint")
            first = 1
        else:
            numbers = self._table("invoices")
            first = numbers.agg(F.coalesce(F.max("number") + 1, F.lit(1)).alias("n")).first().n
        fresh = freeze(partials.new_invoice_numbers(extract, numbers, first), "new-invoices")
        numbers = numbers.unionByName(fresh)
        bitmaps = partials.invoice_bitmaps(extract, numbers)
        if self.version is not None:
            sums = partials.merge_partials(self._table("revenue"), sums)
            bitmaps = partials.merge_bitmaps(self._table("bitmaps"), bitmaps)
        taken = spark.createDataFrame([(n,) for n in [*known, name]], "extract string")
        made = dict(zip(_TABLES, (sums, numbers, bitmaps, taken.coalesce(1))))
        publish_together(made, self._target, self.version)
        release(fresh)
        return SalesSummary(spark, self._target)

    def revenue(self, *by: str) -> DataFrame:
        """Clean revenue by some of month, country and customer."""
        return partials.revenue_from_partials(self._table("revenue"), *by)

    def invoices(self, *by: str) -> DataFrame:
        """Distinct clean invoices by country, month, both or neither."""
        return partials.invoices_from_bitmaps(self._table("bitmaps"), *by)

    def avg_order_value(self) -> DataFrame:
        """Clean revenue per distinct invoice in each country."""
        return partials.avg_order_value_from(self._table("revenue"), self._table("bitmaps"))
