"""Pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillroll.session import freeze

#: What counts as white space between words, inside a character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_ROWS_OUT = 256


def open_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_rows(
    df: DataFrame, columns: Sequence[str], start: Callable[[], Callable], schema: str | T.StructType
) -> DataFrame:
    """Apply a function to each row in Python workers, Arrow batch by batch.

    ``start`` runs once per task and returns ``row(*values) -> tuple | list of
    tuples`` in the order of ``schema``. Values are taken out of the batch one row
    at a time and results leave in small batches, so memory stays near the size of one
    batch of input.
    """
    picked = df.select(*columns)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = start()

        def packed(rows):
            columns = zip(*rows) if rows else [()] * len(arrow)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            out = []
            for values in zip(*batch.columns):
                made = row(*[v.as_py() for v in values])
                out.extend(made) if isinstance(made, list) else out.append(made)
                if len(out) >= _ROWS_OUT:
                    yield packed(out)
                    out = []
            yield packed(out)

    return picked.mapInArrow(run, kind)


def ordered_blocks(df: DataFrame, group: str, order: Sequence, label: str) -> DataFrame:
    """Cut every group into consecutive blocks of rows, whatever its size.

    The rows are range-partitioned by ``group`` and then ``order``, so a hot group
    spreads over many partitions and the blocks of a group follow each other in
    that order. Rows equal in both are told apart by their place in the input, so
    even repeats of one row are split. The result has ``_block`` and is written
    once to the shared folder, which fixes the cuts.
    """
    place = df.withColumn("_place", F.monotonically_increasing_id())
    by = [F.col(group).asc_nulls_last(), *order, F.col("_place").asc()]
    cut = place.repartitionByRange(*by).withColumn("_block", F.spark_partition_id())
    return freeze(cut, label)


def running_totals(
    blocks: DataFrame, group: str, order: Sequence, values: dict[str, str]
) -> DataFrame:
    """Totals of ``values`` over the rows of the group ahead of each row.

    ``values`` maps a new column to the SQL it sums. Rows are sorted within their
    block only; the totals of earlier blocks are added from a table of one row per
    block and group.
    """
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = blocks.groupBy(group, "_block").agg(
        *[F.sum(F.expr(sql)).alias(f"_sum_{name}") for name, sql in values.items()]
    )
    starts = starts.select(
        F.col(group).alias("_start_group"),
        F.col("_block").alias("_start_block"),
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_start_{name}")
            for name in values
        ],
    )
    inside = (
        Window.partitionBy(group, "_block")
        .orderBy(*order, F.col("_place").asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    same = F.col(group).eqNullSafe(F.col("_start_group")) & (
        F.col("_block") == F.col("_start_block")
    )
    return (
        blocks.join(starts, same)
        .withColumns(
            {
                name: F.col(f"_start_{name}")
                + F.coalesce(F.sum(F.expr(sql)).over(inside), F.lit(0))
                for name, sql in values.items()
            }
        )
        .drop("_start_group", "_start_block", *[f"_start_{name}" for name in values])
    )


#: A side of a join is broadcast up to so many rows and bytes of text, and shuffled beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8_000_000


def bounded_side(stored: DataFrame, text_col: str) -> DataFrame:
    """A written table as a side of a join: broadcast if it has been measured to be small."""
    size = stored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("bytes"),
    ).first()
    small = size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    return F.broadcast(stored) if small else stored


_HASH_RANGE = 1 << 30


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those whose key has the smallest hash.

    The same rows whatever the layout. A share of the hash range that holds about twice
    as many rows is cut out first, so only about so many are sorted together.
    """
    place = F.pmod(F.xxhash64(key), F.lit(_HASH_RANGE))
    rows = df.count()
    if rows > 2 * limit:
        df = df.filter(place < F.lit(max(1, 2 * limit * _HASH_RANGE // rows)))
    return df.orderBy(place, F.col(key)).limit(limit)


def set_aside(df: DataFrame, roles: dict[str, str]) -> tuple[DataFrame, Callable]:
    """Give columns names that clash with none of an operator's own.

    ``roles`` maps the name an operator uses to the caller's. All other columns are
    numbered. The second result puts the columns of ``df`` back in order and name.
    """
    own = {theirs: ours for ours, theirs in roles.items()}
    names = [own.get(name, f"aside_{i}") for i, name in enumerate(df.columns)]
    before = df.columns

    def restored(made: DataFrame) -> DataFrame:
        return made.select(*names).toDF(*before)

    return df.toDF(*names), restored
