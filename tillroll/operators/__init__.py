"""DataFrame-to-DataFrame operators on the retail table."""

from tillroll.operators.customers import (
    customer_quartiles,
    customer_revenue,
    quartile_share,
    quartile_summary,
    top_customers,
)
from tillroll.operators.explore import (
    date_range,
    distinct_invoices,
    distinct_lines,
    preview,
    row_count,
    top_k,
)
from tillroll.operators.orders import (
    avg_order_value,
    invoice_bucket_counts,
    invoice_bucket_share,
    invoice_buckets,
    invoice_grain,
)
from tillroll.operators.partials import (
    avg_order_value_from,
    invoice_bitmaps,
    invoices_from_bitmaps,
    merge_bitmaps,
    merge_partials,
    new_invoice_numbers,
    revenue_from_partials,
    revenue_partials,
)
from tillroll.operators.products import (
    distinct_country_lines,
    top_lines_by_country,
    top_lines_by_quantity,
    top_products,
    top_products_by_country,
)
from tillroll.operators.quality import (
    clean_cancelled_check,
    clean_sales,
    quality_count,
    quality_profile,
    quality_rows,
)
from tillroll.operators.revenue import (
    best_worst_month,
    daily_revenue,
    month_over_month,
    monthly_revenue,
    revenue_by_country,
    running_days,
    running_invoices,
    running_total,
)
from tillroll.operators.shape import with_invoice_timestamp, with_month, with_revenue
from tillroll.operators.tiles import invoice_quartiles, ntile_by_counting, rows_at
from tillroll.operators.windows import (
    exact_ntile,
    numbered,
    pct_of_total,
    top_ranked,
    with_running_values,
)

__all__ = [
    "avg_order_value",
    "avg_order_value_from",
    "best_worst_month",
    "clean_cancelled_check",
    "clean_sales",
    "customer_quartiles",
    "customer_revenue",
    "daily_revenue",
    "date_range",
    "distinct_country_lines",
    "distinct_invoices",
    "distinct_lines",
    "exact_ntile",
    "invoice_bitmaps",
    "invoice_bucket_counts",
    "invoice_bucket_share",
    "invoice_buckets",
    "invoice_grain",
    "invoice_quartiles",
    "invoices_from_bitmaps",
    "merge_bitmaps",
    "merge_partials",
    "month_over_month",
    "monthly_revenue",
    "new_invoice_numbers",
    "ntile_by_counting",
    "numbered",
    "pct_of_total",
    "preview",
    "quality_count",
    "quality_profile",
    "quality_rows",
    "quartile_share",
    "quartile_summary",
    "revenue_by_country",
    "revenue_from_partials",
    "revenue_partials",
    "row_count",
    "rows_at",
    "running_days",
    "running_invoices",
    "running_total",
    "top_customers",
    "top_k",
    "top_lines_by_country",
    "top_lines_by_quantity",
    "top_products",
    "top_products_by_country",
    "top_ranked",
    "with_invoice_timestamp",
    "with_month",
    "with_revenue",
    "with_running_values",
]
