"""The retail table as a view over order, line, customer, nation and part tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The columns in use. Declared, so that opening a table runs no job to look
# into its files.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string",
}


def star_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Shape the star tables in ``folder`` into retail line items.

    The line table is the large side and is shuffled at most twice, by part
    and by order; orders meet customers first, at their own smaller size. The
    line's copy of the order key builds every line-level column, so filters on
    invoice number, quantity and price are applied in the line scan, and the
    filter on customer in the order scan, before any shuffle. No side is hinted:
    Spark broadcasts what it measures as small, and AQE splits skewed keys.
    """

    def table(name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}.parquet"
        return spark.read.schema(TABLES[name]).parquet(path)

    order_key, part_key = F.col("l_orderkey"), F.col("l_partkey")
    cancelled = (F.col("l_returnflag") == "R") & (order_key % 10 == 3)
    returned = cancelled | (order_key % 97 == 5)
    units = F.col("l_quantity").cast("bigint")
    pennies = F.when(part_key % 200 == 1, F.lit(0)).otherwise(part_key % 997 + 50)
    price = (pennies.cast("decimal(10,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,4)")
    name = F.col("p_name")
    description = (
        F.when(part_key % 50 == 3, F.concat(F.lit(" "), name, F.lit(" ")))
        .when(part_key % 50 == 4, F.concat(F.lit('"'), name, F.lit('", X')))
        .when(part_key % 50 != 5, name)
    )
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))

    lines = table("lineitem").join(table("part"), part_key == F.col("p_partkey"))
    customers = (
        table("customer")
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "n_name")
    )
    orders = (
        table("orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "n_name")
    )
    return lines.join(orders, order_key == F.col("o_orderkey")).select(
        F.when(cancelled, F.concat(F.lit("C"), order_key.cast("string")))
        .otherwise(order_key.cast("string"))
        .alias("invoiceno"),
        part_key.cast("string").alias("stockcode"),
        description.alias("description"),
        F.when(returned, -units).otherwise(units).alias("quantity"),
        F.when(F.col("o_orderkey") % 211 != 7, F.col("o_orderdate") + minutes).alias("invoicedate"),
        F.when(part_key % 400 == 9, F.lit("0.0015").cast("decimal(12,4)"))
        .otherwise(price)
        .alias("unitprice"),
        F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("customerid"),
        F.col("n_name").alias("country"),
    )
