"""Document fingerprints: quartile digests of hashed byte triplets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUCKETS = 512
#: Share of the score that lengths decide, reached at a ratio of 2 to the power of 4.
LENGTH_SHARE = 0.3
LENGTH_RANGE = 4.0
_LENGTH_STEPS = 8
_LOWEST = -(1 << 63)


def digest(data: bytes) -> bytes:
    """Length code and then two bits for each bucket of triplets.

    Triplets of neighbouring bytes are hashed into buckets and counted. Buckets in
    order of their count (ties by number) are cut into quarters, coded 0 to 3;
    buckets without a triplet have 0. The length code is eight times its
    logarithm, so texts of any size have digests of one size.
    """
    codes = np.zeros(BUCKETS, np.uint8)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        x = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        x *= np.uint32(2654435761)
        x ^= x >> np.uint32(15)
        x *= np.uint32(2246822519)
        x ^= x >> np.uint32(13)
        counts = np.bincount(x & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        rank = np.empty(BUCKETS, np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS)
        codes = np.where(counts > 0, 4 * rank // BUCKETS, 0).astype(np.uint8)
    quads = codes.reshape(-1, 4)
    packed = (quads[:, 0] << 6) | (quads[:, 1] << 4) | (quads[:, 2] << 2) | quads[:, 3]
    length = min(255, round(_LENGTH_STEPS * np.log2(1 + len(data))))
    return bytes([length]) + packed.astype(np.uint8).tobytes()


_UNPACKED = np.array(
    [[byte >> 6 & 3, byte >> 4 & 3, byte >> 2 & 3, byte & 3] for byte in range(256)], np.uint8
)


def likeness(a: bytes, b: bytes) -> float:
    """1 less a difference score that is bounded by 1; equal digests have 1.

    The quarters' part is the disagreement of the codes over the larger of them; the
    length's part is the logarithm of the ratio, up to ``LENGTH_RANGE``.
    """
    x = _UNPACKED[np.frombuffer(a, np.uint8, offset=1)].ravel()
    y = _UNPACKED[np.frombuffer(b, np.uint8, offset=1)].ravel()
    most = int(np.maximum(x, y).sum())
    apart = 1.0 - int(np.minimum(x, y).sum()) / most if most else 0.0
    ratio = min(1.0, abs(a[0] - b[0]) / _LENGTH_STEPS / LENGTH_RANGE)
    return 1.0 - ((1.0 - LENGTH_SHARE) * apart + LENGTH_SHARE * ratio)


#: Rows looked at for each range to cut, and the most ranges.
SAMPLED_PER_RANGE = 50
MOST_RANGES = 20_000


def _ordered(*parts: np.ndarray) -> np.ndarray:
    """Whole numbers side by side as bytes that sort like the tuples of them."""
    raised = np.stack([p.astype(np.int64) for p in parts], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return raised.astype(">u8").view(f"S{8 * len(parts)}").ravel()


def _cuts(rows: DataFrame, order: Sequence[str], ranges: int) -> np.ndarray:
    """Bounds of about equal ranges, from a sample of bounded size.

    They only decide where a row is worked on, so the sample bears on no result.
    """
    wanted = SAMPLED_PER_RANGE * ranges
    share = min(1.0, wanted / max(1, rows.count()))
    seen = rows.select(*order)
    if share < 1.0:
        seen = seen.sample(share, seed=5)
    picked = seen.limit(2 * wanted).toArrow()
    keys = np.sort(_ordered(*[c.to_numpy() for c in picked.columns]))
    return np.unique(keys[np.arange(1, ranges) * len(keys) // ranges]) if len(keys) else keys


def _with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in descending order of the key, so placed that each meets the next one.

    Rows are in order of their key, the hash of their text and their place in the input,
    and are cut into ranges of that order, so that neither a key nor a row that is
    repeated very often fills one range. The cuts and the largest key and hash of each range
    are all that comes to the driver. Each range is one sorted partition and ends with a
    copy of the row that begins the next range, marked ``_tail``. So the texts are shuffled
    once. A null key comes last.
    """
    spark = df.sparkSession
    rows = df.select(
        F.coalesce(F.col(id_col), F.lit(_LOWEST)).cast("bigint").alias("_key"),
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.monotonically_increasing_id().alias("_place"),
    ).withColumn("_hash", F.xxhash64("_text"))
    order = ["_key", "_hash", "_place"]
    ranges = min(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts(rows, order, ranges)

    @F.pandas_udf("int")
    def place(key: pd.Series, text_hash: pd.Series, at: pd.Series) -> pd.Series:
        own = _ordered(key.to_numpy(), text_hash.to_numpy(), at.to_numpy())
        return pd.Series(len(cuts) - np.searchsorted(cuts, own, side="left"))

    placed = rows.withColumn("_range", place(*order))
    first = F.max(F.struct("_key", "_hash")).alias("first")
    firsts = sorted(placed.groupBy("_range").agg(first).collect())
    before = [
        (*r["first"], firsts[i - 1]["_range"]) for i, r in enumerate(firsts)
    ]
    schema = "_first bigint, _first_hash bigint, _to int"
    heads = F.broadcast(spark.createDataFrame(before, schema))
    # Rows of equal key and hash hold one text, so any of them may stand for the first.
    tails = (
        rows.join(heads, (F.col("_key") == F.col("_first")) & (F.col("_hash") == F.col("_first_hash")))
        .groupBy("_to")
        .agg(F.first(F.struct("_key", "_text")).alias("row"))
        .select(
            "row._key", F.lit(None).cast("bigint").alias("_id"), "row._text",
            F.lit(0).cast("bigint").alias("_place"), F.lit(0).cast("bigint").alias("_hash"),
            F.col("_to").alias("_range"), F.lit(True).alias("_tail"),
        )
    )
    every = placed.withColumn("_tail", F.lit(False)).unionByName(tails)
    return every.repartitionById(max(1, ranges), "_range").sortWithinPartitions(
        "_range", "_tail", *[F.col(c).desc() for c in order]
    )


_RESULT = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Digest of every whole text and of its edited text, with their likeness.

    The edited text has its last ``floor(n_chars / 2)`` characters replaced by the
    first as many of the next document, by descending key; after the last comes
    the first. A null text is empty. A lone document is its own next. Rows that repeat
    follow each other and each has its result. Other columns are not read. Keys
    must be whole numbers; rows of one key are in descending order of the hash of their text,
    and may be spread over many tasks, each of which works on a stream. The ranges are
    measured when called. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # range, key, text, digest

        def finished(here, text_next, digest_next):
            _, key, text, own = here
            m = len(text) // 2
            edited = (text[: len(text) - m] + text_next[:m]).encode()
            new = digest(edited)
            return (
                key, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), new.hex(),
                likeness(own, new), likeness(own, digest_next),
            )

        for batch in batches:
            out = []
            for values in zip(*batch.columns):
                piece, key, text, tail = (v.as_py() for v in values)
                own = digest(text.encode())
                if last is not None and last[0] == piece:
                    out.append(finished(last, text, own))
                last = None if tail else (piece, key, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 7, arrow)],
                schema=arrow,
            )

    arrow = pa.schema(
        [
            (id_col, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ]
    )
    ordered = _with_next(docs, id_col, text_col).select("_range", "_id", "_text", "_tail")
    return ordered.mapInArrow(run, f"`{id_col}` bigint, {_RESULT}")
