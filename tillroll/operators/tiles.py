"""Tiles of equal size whose bounds are found by counting, without a sort of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from tillroll.functions import order_columns, rounded_revenue_sum
from tillroll.operators.quality import clean_sales
from tillroll.session import freeze

#: Edges a round puts into each stretch that still holds a bound.
EDGES = 24
#: A stretch of so many rows or fewer is brought to the driver in order and looked up.
LAST_ROWS = 2000
_HASH_RANGE = 1 << 30


def _precedes(order: Sequence[str], edge: Row) -> Column:
    """Rows that come before ``edge``, NULLs last; rows equal to it do not."""
    found: Column = F.lit(False)
    for name, value in reversed(list(zip(order, edge))):
        column = F.col(name.removeprefix("-"))
        if value is None:
            ahead, equal = column.isNotNull(), column.isNull()
        else:
            ahead = column > F.lit(value) if name.startswith("-") else column < F.lit(value)
            ahead = F.coalesce(ahead, F.lit(False))
            equal = column.eqNullSafe(F.lit(value))
        found = ahead | (equal & found)
    return found


def _edges_passed(order: Sequence[str], edges: Sequence[Row]) -> Column:
    """How many of ``edges`` a row is at or behind."""
    passed = [F.when(_precedes(order, e), 0).otherwise(1) for e in edges]
    return reduce(Column.__add__, passed, F.lit(0))


def rows_at(df: DataFrame, order: Sequence[str], places: Sequence[int]) -> list[Row]:
    """The values of ``order`` in the rows at ``places``, counted from 0 in that order.

    ``order`` lists columns, ``-`` for descending, ends in a unique key, and NULLs come
    last. Rows are never sorted as a whole. Each round takes edges out of every
    stretch between two known edges that holds a place, counts the rows between all edges
    in one pass with partial counts, and keeps the stretches the places lie in. A
    stretch shrinks by about ``EDGES`` each round; once it has at most ``LAST_ROWS``
    rows these are looked through in order. So rounds grow with the logarithm of the
    rows, and the driver sees edges, counts and a few short stretches only. ``df`` is read
    several times and must give the same rows each time. Places without a row are an error.
    """
    names = [n.removeprefix("-") for n in order]
    keys, by = df.select(*names), order_columns(order)
    place_of_hash = F.pmod(F.xxhash64(*names, F.lit(0)), F.lit(_HASH_RANGE))
    edges: list[Row] = []
    found: dict[int, Row] = {}
    wider = 1
    while True:
        counted = keys.groupBy(_edges_passed(order, edges).alias("stretch")).count().collect()
        count = dict(counted)
        starts = [sum(count.get(i, 0) for i in range(s)) for s in range(len(edges) + 2)]
        if places and not 0 <= min(places) <= max(places) < starts[-1]:
            raise IndexError("there is no row at that place")
        kept: list[Row] = []
        smallest = True
        for s in range(len(edges) + 1):
            due = [p for p in places if starts[s] <= p < starts[s + 1] and p not in found]
            if not due:
                continue
            low, high = edges[s - 1 : s], edges[s : s + 1]
            inside = reduce(Column.__and__, [~_precedes(order, e) for e in low], F.lit(True))
            inside = reduce(Column.__and__, [_precedes(order, e) for e in high], inside)
            stretch = keys.filter(inside)
            rows = count[s]
            if rows <= LAST_ROWS:
                last = stretch.orderBy(*by).collect()
                found.update({p: last[p - starts[s]] for p in due})
                continue
            for e in low:
                same = [F.col(n).eqNullSafe(F.lit(v)) for n, v in zip(names, e)]
                stretch = stretch.filter(~reduce(Column.__and__, same))
            share = min(_HASH_RANGE, 4 * EDGES * wider * _HASH_RANGE // rows + 1)
            smallest = smallest and share == _HASH_RANGE
            few = stretch.filter(place_of_hash < F.lit(share)).limit(16 * EDGES)
            picked = few.distinct().orderBy(*by).collect()
            step = max(1, len(picked) // EDGES)
            kept += [*low, *picked[step // 2 :: step], *high]
        if all(p in found for p in places):
            return [found[p] for p in places]
        fresh = list(dict.fromkeys(kept))
        if set(fresh) <= set(edges):
            if smallest:
                raise ValueError("the order must end in a unique key")
            wider *= 16
        else:
            wider = 1
        edges = fresh


def ntile_by_counting(df: DataFrame, k: int, order: Sequence[str], name: str) -> DataFrame:
    """``ntile(k)`` over the whole table by the rows its tiles begin with.

    The first rows of tiles 2 to ``k`` are found by ``rows_at``; a row's tile then
    follows from comparing it with these, in the scan itself: no sort, no shuffle and no
    window over the rows. With ``size, extra = divmod(rows, k)`` the first ``extra``
    tiles hold ``size + 1`` rows and the others ``size``. ``df`` must give the same rows
    each time, as a stored table does. Runs jobs when called.
    """
    size, extra = divmod(df.count(), k)
    begins = [t * size + min(t, extra) for t in range(1, k)]
    begins = [p for p in begins if p < size * k + extra]
    bounds = rows_at(df, order, begins) if begins else []
    tile = (_edges_passed(order, bounds) + 1).cast("bigint")
    return df.withColumn(name, tile)


def invoice_quartiles(df: DataFrame, k: int = 4) -> DataFrame:
    """Clean invoices in ``k`` groups of equal size, highest value in group 1.

    The lower invoice number goes first where values tie. Invoices grow with the
    lines, so they are summed and stored once, and labelled where they lie.
    """
    invoices = clean_sales(df).groupBy("invoiceno").agg(
        rounded_revenue_sum(df).alias("total_invoice_value")
    )
    order = ["-total_invoice_value", "invoiceno"]
    return ntile_by_counting(freeze(invoices, "invoices"), k, order, "value_quartile")
