"""Dealing records to shards by rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import ordered_blocks, running_totals
from tillroll.session import freeze

SHARDS = 16
# 52 bits of the digest: a whole number a double holds exactly.
_DIGITS = 13


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) fixed by the key and the shard."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}"))
    high = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double")
    return (high + F.lit(0.5)) / F.lit(float(16**_DIGITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score ``-ln(draw) / weight`` is least; ties go to the lower.

    A shard's score depends on the key and that shard alone. So one more shard
    changes a key's place only if the new shard wins it, and a shard of twice the
    weight gets twice the keys. Nulls are one key, the same as empty text.
    """
    scores = [
        F.struct(
            (-F.ln(_draw(key, shard)) / F.lit(float(weight))).alias("score"),
            F.lit(shard).alias("shard"),
        )
        for shard, weight in enumerate(weights)
    ]
    if len(scores) == 1:
        return F.lit(0)
    return F.least(*scores)["shard"]


def shard_records(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * SHARDS,
    new_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Shard and slot of every record, and its shard if there were one more.

    ``weights`` has one positive weight per shard; ``new_weight`` is that of the
    shard added for ``grown_shard``. Slots number a shard's records from 0 without
    gaps, in the order of the key's digest, the key, and the text's checksum and
    size. They are counted over blocks, so neither a shard nor one key that many
    records hold is gathered in a task. Records that agree in all of these are
    alike in the result, and any order among them gives the same rows.

    Columns: ``id_col``, ``size`` (UTF-8 bytes plus 1; a null text has 1),
    ``text_crc32`` (a null text has that of empty text, 0), ``law``, ``shard``,
    ``slot``, ``grown_shard``. Other columns are not read. The job reads the table
    once, when called, and keeps what is listed here in the shared folder.
    """
    if not weights or min(*weights, new_weight, new_weight) <= 0:
        raise ValueError("every shard needs a positive weight")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    placed = docs.select(
        key,
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, new_weight]).alias("grown_shard"),
    )
    order = [
        F.md5(F.coalesce(key.cast("string"), F.lit(""))).asc(),
        key.asc_nulls_first(),
        F.col("text_crc32").asc(),
        F.col("size").asc(),
    ]
    blocks = ordered_blocks(freeze(placed, "shards"), "shard", order, "shard-blocks")
    return running_totals(blocks, "shard", order, {"slot": "1L"}).select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
