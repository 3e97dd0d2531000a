"""The distributed ranking and tiling against Spark's own window functions."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window, functions as F

from tillroll.operators import exact_ntile, pct_of_total, top_ranked


def tiles_of(df, k):
    by = Window.orderBy(F.col("total").desc(), F.col("id").asc())
    expected = df.withColumn("tile", F.ntile(k).over(by).cast("bigint"))
    return rows(exact_ntile(df, k, ["-total", "id"], "tile")), rows(expected)


@pytest.mark.parametrize(
    "size, distinct, k",
    [(0, 1, 4), (1, 1, 4), (3, 2, 4), (4, 2, 4), (5, 2, 4), (10, 2, 4), (1000, 2, 4),
     (1000, 1, 7), (4338, 900, 4), (60000, 50, 4), (60000, 60000, 10)],
)
def test_ntile_equals_window(spark, size, distinct, k):
    df = spark.range(size).select("id", (F.col("id") * 7919 % distinct).alias("total"))
    found, expected = tiles_of(df, k)
    assert found == expected


def test_ntile_sizes(spark):
    df = spark.range(4338).select("id", (F.col("id") % 100).alias("total"))
    sizes = rows(exact_ntile(df, 4, ["-total", "id"], "tile").groupBy("tile").count())
    assert sizes == [(1, 1085), (2, 1085), (3, 1084), (4, 1084)]


def test_ntile_result_is_stable_when_read_twice(spark):
    df = spark.range(5000).select("id", F.lit(1).alias("total"))
    tiled = exact_ntile(df, 4, ["-total", "id"], "tile")
    assert rows(tiled) == rows(tiled)


def ranked_by_window(df, n, method):
    best_first = Window.partitionBy("g").orderBy(F.col("v").desc())
    function = {"rank": F.rank, "dense_rank": F.dense_rank}[method]
    ranked = df.withColumn("ranking", function().over(best_first).cast("bigint"))
    return rows(ranked.filter(F.col("ranking") <= n))


@pytest.mark.parametrize("method", ["rank", "dense_rank"])
@pytest.mark.parametrize("n", [1, 3, 5])
def test_top_ranked_with_a_hot_group_full_of_ties(spark, method, n):
    # A third of the rows are in one group and a third of those tie for first.
    draw = random.Random(7)
    data = [
        (i, "hot" if i % 3 == 0 else f"g{draw.randrange(40)}" if i % 3 == 1 else None,
         9 if i % 9 == 0 else draw.randrange(9))
        for i in range(6000)
    ]
    df = spark.createDataFrame(data, "id long, g string, v long").cache()
    assert rows(top_ranked(df, "g", "v", n, method)) == ranked_by_window(df, n, method)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 4) | st.none()),
        min_size=0, max_size=25,
    ),
    n=st.integers(1, 4),
    method=st.sampled_from(["rank", "dense_rank"]),
)
def test_top_ranked_equals_window(spark, data, n, method):
    numbered = [(i, g, v) for i, (g, v) in enumerate(data)]
    df = spark.createDataFrame(numbered, "id long, g string, v long")
    assert rows(top_ranked(df, "g", "v", n, method)) == ranked_by_window(df, n, method)


def test_top_ranked_rejects_unknown_method(spark):
    with pytest.raises(ValueError):
        top_ranked(spark.range(1), "id", "id", method="row_number")


def test_pct_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    assert rows(pct_of_total(df, "n")) == [("a", 1, 33.33), ("b", 2, 66.67)]
    zero = spark.createDataFrame([("a", 0)], "k string, n long")
    assert rows(pct_of_total(zero, "n")) == [("a", 0, None)]
