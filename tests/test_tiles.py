"""Tiles found by counting, against Spark's own window function."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from tillroll import operators as ops
from tillroll.operators import tiles


def windowed(df, k):
    by = Window.orderBy(F.col("total").desc_nulls_last(), F.col("id").asc_nulls_last())
    return rows(df.withColumn("tile", F.ntile(k).over(by).cast("bigint")))


def counted(df, k):
    return rows(tiles.ntile_by_counting(df, k, ["-total", "id"], "tile"))


@pytest.mark.parametrize(
    "size, distinct, k",
    [(0, 1, 4), (1, 1, 4), (3, 2, 4), (5, 2, 4), (1000, 1, 7), (20000, 1, 4), (30000, 30000, 5)],
)
def test_tiles_equal_the_window(spark, size, distinct, k):
    df = spark.range(size).select("id", (F.col("id") * 7919 % distinct).alias("total"))
    assert counted(df, k) == windowed(df, k)


def test_bounds_among_ties_and_nulls_take_several_rounds(spark, monkeypatch):
    # Two thirds share a value or have none, and few edges and rows are allowed a round.
    monkeypatch.setattr(tiles, "EDGES", 3)
    monkeypatch.setattr(tiles, "LAST_ROWS", 20)
    total = F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 3 == 1, F.col("id") % 50)
    df = spark.range(3000).select(F.col("id").cast("string"), total.cast("decimal(20,2)").alias("total"))
    assert counted(df, 4) == windowed(df, 4)


def test_rows_at_places(spark):
    df = spark.range(10_000).select("id")
    assert [r.id for r in tiles.rows_at(df, ["-id"], [0, 4_321, 9_999])] == [9_999, 5_678, 0]
    with pytest.raises(IndexError):
        tiles.rows_at(df, ["id"], [10_000])


def test_an_order_without_a_unique_key_is_refused(spark):
    df = spark.range(5000).select(F.lit(1).alias("id"))
    with pytest.raises(ValueError):
        tiles.rows_at(df, ["id"], [2500])


def test_rows_are_labelled_where_they_lie(mini):
    made = ops.invoice_quartiles(mini)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    assert {r.invoiceno: r.value_quartile for r in made.collect()}["536367"] == 1
