"""Hashed text features and bounded training samples for the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import map_rows

MEMO_ENTRIES = 300_000
# Everything in ASCII that is not a letter or digit becomes a blank.
_BLANKS = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


class BucketMemo(dict):
    """Term to bucket; forgets everything when full, which changes no result."""

    def __init__(self, buckets: int, seed: int = 0, entries: int = MEMO_ENTRIES):
        super().__init__()
        import xxhash

        self._hash, self._buckets, self._seed, self._entries = (
            xxhash.xxh64_intdigest, buckets, seed, entries
        )

    def __missing__(self, term: bytes) -> int:
        if len(self) >= self._entries:
            self.clear()
        bucket = self._hash(term, self._seed) % self._buckets
        if len(term) <= 64:
            self[term] = bucket
        return bucket


def plain_terms(text: str) -> list[str]:
    """Words in lower case, split at ASCII marks and blanks."""
    return text.lower().encode().translate(_BLANKS).decode().split()


def held_out(key: Column) -> Column:
    """Rows kept from training: the CRC-32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def encoded_rows(
    docs: DataFrame,
    sample: DataFrame,
    target: str,
    start: Callable[[], Callable],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encoded features of the sampled documents: ``id``, ``target`` and ``features``.

    ``sample`` has at most as many rows as the documented bound and one for each id, so it
    may be broadcast. Of several documents with one id the one with the smallest features
    counts, so there are no more rows than ``sample`` has. ``start`` gives ``text -> bytes``.
    """
    wanted = F.broadcast(sample.select(F.col(id_col).alias("_id"), F.col(target).alias("_target")))
    texts = docs.select(id_col, text_col)
    rows = texts.join(wanted, F.col(id_col) == F.col("_id")).select("_id", "_target", text_col)

    def encoder():
        encode = start()
        return lambda key, target, text: (key, target, encode(text or ""))

    kind = docs.schema[id_col].dataType.simpleString()
    made = map_rows(
        rows, ["_id", "_target", text_col], encoder, f"id {kind}, target double, features binary"
    )
    return made.groupBy("id", "target").agg(F.min("features").alias("features"))


def training_rows(
    docs: DataFrame,
    sample: DataFrame,
    target: str,
    start: Callable[[], Callable],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> pd.DataFrame:
    """The rows of ``encoded_rows`` in the order of their ids, on the driver."""
    made = encoded_rows(docs, sample, target, start, id_col, text_col).toPandas()
    return made.sort_values("id", kind="stable", ignore_index=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
