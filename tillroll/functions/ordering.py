"""Sort orders written as column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def order_columns(names: Sequence[str]) -> list[Column]:
    """Sort columns for names, descending where a name starts with ``-``.

    NULLs come last either way; Spark alone would put them first in an
    ascending sort.
    """
    return [
        F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_last()
        for n in names
    ]
