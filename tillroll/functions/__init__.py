"""Column expressions shared by the operators."""

from tillroll.functions.dates import as_invoice_text, month_start, parse_invoice_date
from tillroll.functions.money import (
    DOUBLE_PRICE_TYPE,
    divide_rounded,
    exact_as,
    exact_revenue_sum,
    exact_sum,
    revenue,
    round_half_away,
    rounded_revenue_sum,
)
from tillroll.functions.ordering import order_columns

__all__ = [
    "DOUBLE_PRICE_TYPE",
    "as_invoice_text",
    "divide_rounded",
    "exact_as",
    "exact_revenue_sum",
    "exact_sum",
    "month_start",
    "order_columns",
    "parse_invoice_date",
    "revenue",
    "round_half_away",
    "rounded_revenue_sum",
]
