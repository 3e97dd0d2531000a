"""Plain SQL for each report, to be run by another engine on the same tables.

Written from the meaning of the reports, not from the DataFrame code: ranks,
tiles and shares are the textbook window functions.
"""

from __future__ import annotations

# The retail table over the star tables.
SALES_SQL = """
        SELECT CASE WHEN l_returnflag = 'R' AND o_orderkey % 10 = 3
                    THEN concat('C', CAST(o_orderkey AS VARCHAR))
                    ELSE CAST(o_orderkey AS VARCHAR) END AS invoiceno,
               CAST(l_partkey AS VARCHAR) AS stockcode,
               CASE WHEN l_partkey % 50 = 3 THEN concat(' ', p_name, ' ')
                    WHEN l_partkey % 50 = 4 THEN concat('"', p_name, '", X')
                    WHEN l_partkey % 50 = 5 THEN NULL ELSE p_name END AS description,
               CASE WHEN (l_returnflag = 'R' AND o_orderkey % 10 = 3) OR o_orderkey % 97 = 5
                    THEN -CAST(l_quantity AS BIGINT)
                    ELSE CAST(l_quantity AS BIGINT) END AS quantity,
               CASE WHEN o_orderkey % 211 = 7 THEN NULL
                    ELSE o_orderdate + to_minutes(o_orderkey % 1440) END AS invoicedate,
               CASE WHEN l_partkey % 400 = 9 THEN CAST(0.0015 AS DECIMAL(12,4))
                    ELSE CAST(CAST(CASE WHEN l_partkey % 200 = 1 THEN 0
                                        ELSE l_partkey % 997 + 50 END AS DECIMAL(10,0))
                              * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,4)) END AS unitprice,
               CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS customerid,
               n_name AS country
        FROM lineitem
        JOIN orders   ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN nation   ON c_nationkey = n_nationkey
        JOIN part     ON l_partkey = p_partkey"""

_CTES = {
    "sales": SALES_SQL,
    "clean": """
        SELECT *, quantity * unitprice AS value FROM sales
        WHERE invoiceno NOT LIKE 'C%' AND quantity > 0 AND unitprice > 0
          AND customerid IS NOT NULL""",
    "months": """
        SELECT date_trunc('month', invoicedate) AS m, round(sum(value), 2) AS total
        FROM clean GROUP BY 1""",
    "changes": """
        SELECT m, total, lag(total, 1, 0) OVER (ORDER BY m) AS previous FROM months""",
    "countries": """
        SELECT country, count(DISTINCT invoiceno) AS invoices, round(sum(value), 2) AS total
        FROM clean GROUP BY country""",
    "buckets": """
        SELECT bucket, count(*) AS n FROM (
            SELECT CASE WHEN total < 200 THEN 'Small'
                        WHEN total >= 200 AND total < 1000 THEN 'Medium'
                        WHEN total >= 1000 THEN 'Large' END AS bucket
            FROM (SELECT round(sum(value), 2) AS total FROM clean GROUP BY invoiceno))
        GROUP BY bucket""",
    "products": """
        SELECT stockcode, description, country, sum(quantity) AS units
        FROM clean GROUP BY ALL""",
    "tiles": """
        SELECT customerid, total,
               ntile(4) OVER (ORDER BY total DESC, customerid) AS tile
        FROM (SELECT customerid, round(sum(value), 2) AS total FROM clean GROUP BY customerid)""",
    "quartiles": """
        SELECT tile, count(*) AS n, round(sum(total), 2) AS total FROM tiles GROUP BY tile""",
}

_USES = {
    "sales": (),
    "clean": ("sales",),
    "months": ("clean",),
    "changes": ("months",),
    "countries": ("clean",),
    "buckets": ("clean",),
    "products": ("clean",),
    "tiles": ("clean",),
    "quartiles": ("tiles",),
}


def _with(names: tuple[str, ...], select: str) -> str:
    needed: set[str] = set()
    pending = list(names)
    while pending:
        name = pending.pop()
        needed.add(name)
        pending += _USES[name]
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in _CTES.items() if name in needed)
    return f"WITH {ctes}\n{select}"


_ROW = """invoiceno, stockcode, description, quantity, invoicedate,
       CAST(unitprice AS DOUBLE) AS unitprice, customerid, country"""
_COUNT = "CAST(count(*) AS BIGINT) AS row_count"


def _country_revenue(table: str, total: str, where: str = "true") -> str:
    return _with(
        (table,),
        f"""SELECT country, CAST({total} AS DOUBLE) AS total_revenue
FROM {table} WHERE {where} GROUP BY country""",
    )


def _ranked(function: str) -> str:
    return _with(
        ("products",),
        f"""SELECT stockcode, description, CAST(units AS BIGINT) AS total_quantity, country,
       CAST(place AS BIGINT) AS ranking
FROM (SELECT *, {function}() OVER (PARTITION BY country ORDER BY units DESC) AS place
      FROM products)
WHERE place <= 3""",
    )


_CLEAN_COUNT = "CAST(count(invoiceno) AS BIGINT) AS cancelled_rows"
_SHARE_OF_BUCKETS = "round(CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * 100, 2)"
_SHARE_OF_QUARTILES = (
    "round(CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) * 100, 2)"
)

ORACLE_SQL: dict[str, str] = {
    "load_csv": _with(("sales",), f"SELECT {_ROW} FROM sales"),
    "parse_invoice_dates": _with(
        ("sales",), "SELECT invoiceno, stockcode, invoicedate FROM sales"
    ),
    "invoice_months": _with(
        ("sales",),
        """SELECT invoiceno, stockcode,
       CAST(date_trunc('month', invoicedate) AS TIMESTAMP) AS month FROM sales""",
    ),
    "retype_invoice_date": _with(("sales",), f"SELECT {_ROW} FROM sales"),
    "load_csv_with_quarantine": _with(
        ("sales",),
        """SELECT reason, CAST(count(*) AS BIGINT) AS lines,
       CASE WHEN reason = 'stored' THEN CAST(sum(quantity) AS BIGINT) END AS units
FROM (SELECT *, CASE CAST(stockcode AS BIGINT) % 40
                WHEN 4 THEN 'fields' WHEN 1 THEN 'quantity'
                WHEN 2 THEN 'invoicedate' WHEN 3 THEN 'unitprice' ELSE 'stored' END AS reason
      FROM sales)
GROUP BY reason""",
    ),
    "versioned_reload": _with(
        ("sales", "clean"),
        """SELECT CAST(1 AS BIGINT) AS version, country,
       CAST(round(sum(quantity * unitprice), 2) AS DOUBLE) AS total_revenue
FROM sales GROUP BY country
UNION ALL
SELECT CAST(2 AS BIGINT), country, CAST(round(sum(value), 2) AS DOUBLE)
FROM clean GROUP BY country""",
    ),
    "stored_months": _with(
        ("clean",),
        """SELECT CAST(date_trunc('month', invoicedate) AS TIMESTAMP) AS month,
       CAST(round(sum(value), 2) AS DOUBLE) AS total_revenue
FROM clean
WHERE (invoicedate >= TIMESTAMP '1996-05-01' AND invoicedate < TIMESTAMP '1996-06-01')
   OR (invoicedate >= TIMESTAMP '1996-06-01' AND invoicedate < TIMESTAMP '1996-07-01'
       AND quantity >= 10)
GROUP BY 1""",
    ),
    "running_days": _with(
        ("clean",),
        """SELECT CAST(day AS TIMESTAMP) AS day, CAST(total AS DOUBLE) AS total_revenue,
       CAST(sum(total) OVER (ORDER BY day) AS DOUBLE) AS running_total,
       CAST(lag(total, 1, 0) OVER (ORDER BY day) AS DOUBLE) AS previous_day,
       CAST(round(total - lag(total, 1, 0) OVER (ORDER BY day), 2) AS DOUBLE) AS revenue_change
FROM (SELECT CAST(invoicedate AS DATE) AS day, round(sum(value), 2) AS total
      FROM clean GROUP BY 1)""",
    ),
    "running_invoices": _with(
        ("clean",),
        """SELECT invoiceno, invoicedate, CAST(total AS DOUBLE) AS total_invoice_value,
       CAST(sum(total) OVER (ORDER BY invoicedate, invoiceno) AS DOUBLE) AS running_total,
       CAST(lag(total, 1, 0) OVER (ORDER BY invoicedate, invoiceno) AS DOUBLE)
           AS previous_value
FROM (SELECT invoiceno, min(invoicedate) AS invoicedate, round(sum(value), 2) AS total
      FROM clean GROUP BY invoiceno)""",
    ),
    "invoice_quartiles": _with(
        ("clean",),
        """SELECT invoiceno, CAST(total AS DOUBLE) AS total_invoice_value,
       CAST(ntile(4) OVER (ORDER BY total DESC, invoiceno) AS BIGINT) AS value_quartile
FROM (SELECT invoiceno, round(sum(value), 2) AS total FROM clean GROUP BY invoiceno)""",
    ),
    "incremental_revenue": _with(
        ("clean",),
        """SELECT CAST(date_trunc('month', invoicedate) AS TIMESTAMP) AS month, country,
       CAST(round(sum(value), 2) AS DOUBLE) AS total_revenue
FROM clean GROUP BY 1, 2""",
    ),
    "incremental_invoices": _with(
        ("clean",),
        """SELECT country, CAST(date_trunc('month', invoicedate) AS DATE) AS month,
       CAST(count(DISTINCT invoiceno) AS BIGINT) AS unique_invoices
FROM clean GROUP BY 1, 2""",
    ),
    "incremental_order_value": _with(
        ("countries",),
        """SELECT country, round(CAST(total AS DOUBLE) / invoices, 2) AS avg_order_value,
       CAST(invoices AS BIGINT) AS unique_invoice_total
FROM countries""",
    ),
    "preview_rows": _with(
        ("sales",),
        f"""SELECT {_ROW} FROM sales
ORDER BY ALL ASC NULLS LAST LIMIT 10""",
    ),
    "row_count": _with(("sales",), f"SELECT {_COUNT} FROM sales"),
    "distinct_invoices": _with(
        ("sales",),
        "SELECT CAST(count(DISTINCT invoiceno) AS BIGINT) AS unique_invoices FROM sales",
    ),
    "date_range": _with(
        ("sales",),
        "SELECT min(invoicedate) AS first_date, max(invoicedate) AS last_date FROM sales",
    ),
    "top_lines_by_quantity": _with(
        ("sales",),
        """SELECT DISTINCT stockcode, description, quantity,
       CAST(unitprice AS DOUBLE) AS unitprice,
       CAST(quantity * unitprice AS DOUBLE) AS revenue
FROM sales WHERE unitprice <> 0
ORDER BY quantity DESC, stockcode, description, unitprice LIMIT 10""",
    ),
    "top_products": _with(
        ("sales",),
        """SELECT stockcode, description, CAST(sum(quantity) AS BIGINT) AS total_quantity_sold,
       CAST(round(sum(quantity * unitprice), 2) AS DOUBLE) AS total_revenue
FROM sales WHERE unitprice <> 0 AND quantity > 0
GROUP BY stockcode, description
ORDER BY total_quantity_sold DESC, stockcode, description LIMIT 10""",
    ),
    "null_customer_rows": _with(
        ("sales",), f"SELECT {_ROW} FROM sales WHERE customerid IS NULL"
    ),
    "cancelled_rows": _with(
        ("sales",), f"SELECT {_ROW} FROM sales WHERE invoiceno LIKE 'C%'"
    ),
    "nonpositive_quantity_rows": _with(
        ("sales",), f"SELECT {_ROW} FROM sales WHERE quantity <= 0"
    ),
    "cancelled_count": _with(
        ("sales",), f"SELECT {_COUNT} FROM sales WHERE invoiceno LIKE 'C%'"
    ),
    "nonpositive_quantity_count": _with(
        ("sales",), f"SELECT {_COUNT} FROM sales WHERE quantity <= 0"
    ),
    "nonpositive_price_count": _with(
        ("sales",), f"SELECT {_COUNT} FROM sales WHERE unitprice <= 0"
    ),
    "null_customer_count": _with(
        ("sales",), f"SELECT {_COUNT} FROM sales WHERE customerid IS NULL"
    ),
    "quality_profile": _with(
        ("sales",),
        """SELECT CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) FILTER (WHERE invoiceno LIKE 'C%') AS BIGINT) AS cancelled_rows,
       CAST(count(*) FILTER (WHERE quantity <= 0) AS BIGINT) AS quantity_rows,
       CAST(count(*) FILTER (WHERE unitprice <= 0) AS BIGINT) AS price_rows,
       CAST(count(*) FILTER (WHERE customerid IS NULL) AS BIGINT) AS customer_rows
FROM sales""",
    ),
    "clean_rows": _with(("clean",), f"SELECT {_ROW} FROM clean"),
    "clean_cancelled_check": _with(
        ("clean",), f"SELECT {_CLEAN_COUNT} FROM clean WHERE invoiceno LIKE 'C%'"
    ),
    "revenue_by_country_raw": _country_revenue(
        "sales", "round(sum(quantity * unitprice), 2)"
    ),
    "revenue_by_country_positive": _country_revenue(
        "sales", "sum(quantity * unitprice)", "quantity > 0"
    ),
    "revenue_by_country_clean": _country_revenue("clean", "round(sum(value), 2)"),
    "monthly_revenue": _with(
        ("months",),
        """SELECT CAST(m AS TIMESTAMP) AS month, CAST(total AS DOUBLE) AS total_revenue
FROM months""",
    ),
    "best_worst_month": _with(
        ("months",),
        """SELECT CAST(m AS TIMESTAMP) AS month, CAST(total AS DOUBLE) AS total_revenue
FROM ((SELECT * FROM months ORDER BY total DESC, m LIMIT 1)
      UNION ALL
      (SELECT * FROM months ORDER BY total ASC, m LIMIT 1))""",
    ),
    "running_total": _with(
        ("months",),
        """SELECT CAST(m AS TIMESTAMP) AS month, CAST(total AS DOUBLE) AS total_revenue,
       CAST(round(sum(total) OVER (ORDER BY m), 2) AS DOUBLE) AS running_total
FROM months""",
    ),
    "month_over_month": _with(
        ("changes",),
        """SELECT CAST(m AS TIMESTAMP) AS month, CAST(total AS DOUBLE) AS total_revenue,
       CAST(previous AS DOUBLE) AS previous_month,
       CAST(round(total - previous, 2) AS DOUBLE) AS revenue_change
FROM changes""",
    ),
    "avg_order_value": _with(
        ("countries",),
        """SELECT country, round(CAST(total AS DOUBLE) / invoices, 2) AS avg_order_value
FROM countries""",
    ),
    "avg_order_value_with_counts": _with(
        ("countries",),
        """SELECT country, round(CAST(total AS DOUBLE) / invoices, 2) AS avg_order_value,
       CAST(invoices AS BIGINT) AS unique_invoice_total
FROM countries""",
    ),
    "invoice_bucket_counts": _with(
        ("buckets",),
        "SELECT bucket AS revenue_buckets, CAST(n AS BIGINT) AS bucket_count FROM buckets",
    ),
    "invoice_bucket_share": _with(
        ("buckets",),
        f"""SELECT bucket AS revenue_buckets, CAST(n AS BIGINT) AS bucket_count,
       {_SHARE_OF_BUCKETS} AS pct_of_total
FROM buckets""",
    ),
    "top_lines_by_country": _with(
        ("clean",),
        """SELECT stockcode, description, quantity, country, CAST(place AS BIGINT) AS ranking
FROM (SELECT *, rank() OVER (PARTITION BY country ORDER BY quantity DESC) AS place
      FROM (SELECT DISTINCT stockcode, description, quantity, country FROM clean))
WHERE place <= 3""",
    ),
    "top_products_by_country_rank": _ranked("rank"),
    "top_products_by_country_dense_rank": _ranked("dense_rank"),
    "top_customers": _with(
        ("clean",),
        """SELECT customerid, country, CAST(round(sum(value), 2) AS DOUBLE) AS total_revenue
FROM clean GROUP BY customerid, country
ORDER BY round(sum(value), 2) DESC, customerid, country LIMIT 20""",
    ),
    "customer_quartiles": _with(
        ("tiles",),
        """SELECT customerid, CAST(total AS DOUBLE) AS total_revenue,
       CAST(tile AS BIGINT) AS rev_quartiles
FROM tiles""",
    ),
    "quartile_revenue": _with(
        ("quartiles",),
        """SELECT CAST(tile AS BIGINT) AS rev_quartiles, CAST(n AS BIGINT) AS customer_count,
       CAST(total AS DOUBLE) AS quartile_revenue
FROM quartiles""",
    ),
    "quartile_share": _with(
        ("quartiles",),
        f"""SELECT CAST(tile AS BIGINT) AS rev_quartiles,
       CAST(total AS DOUBLE) AS quartile_revenue,
       {_SHARE_OF_QUARTILES} AS pct_of_total
FROM quartiles""",
    ),
    "export_extract": _with(
        ("changes", "countries", "buckets", "quartiles"),
        f"""SELECT 'monthly_revenue' AS extract, CAST(CAST(m AS DATE) AS VARCHAR) AS key,
       measure, value
FROM (SELECT m, CAST(total AS DOUBLE) AS total_revenue,
             CAST(previous AS DOUBLE) AS previous_month,
             CAST(round(total - previous, 2) AS DOUBLE) AS revenue_change
      FROM changes)
UNPIVOT (value FOR measure IN (total_revenue, previous_month, revenue_change))
UNION ALL
SELECT 'country_revenue', country, 'total_revenue', CAST(total AS DOUBLE) FROM countries
UNION ALL
SELECT 'invoice_buckets', bucket, measure, value
FROM (SELECT bucket, CAST(n AS DOUBLE) AS bucket_count, {_SHARE_OF_BUCKETS} AS pct_of_total
      FROM buckets)
UNPIVOT (value FOR measure IN (bucket_count, pct_of_total))
UNION ALL
SELECT 'customer_quartiles', CAST(tile AS VARCHAR), measure, value
FROM (SELECT tile, CAST(total AS DOUBLE) AS quartile_revenue,
             {_SHARE_OF_QUARTILES} AS pct_of_total
      FROM quartiles)
UNPIVOT (value FOR measure IN (quartile_revenue, pct_of_total))""",
    ),
}
