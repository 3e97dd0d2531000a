"""Product codes of vectors: exact integer k-means over Hilbert-sorted flat blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.session import freeze, release

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a flat block. Blocks of any size give the same codes.
BLOCK_ROWS = 256
#: Integers up to this keep every squared distance of a part within 64 bits.
MOST = 1 << 27


def hilbert_keys(points: np.ndarray, low: int, high: int, bits: int = 7) -> list[bytes]:
    """Place of each point along a Hilbert curve through the box ``[low, high]`` of all axes.

    Coordinates are cut to ``bits`` bits. The transform of Gray-coded axes into the curve's
    index is the usual one, bit plane by bit plane, on all points at once.
    """
    rows, axes = points.shape
    span = max(1, high - low + 1)
    x = ((points.astype(np.float64) - low) * ((1 << bits) / span)).astype(np.int64)
    x = x.clip(0, (1 << bits) - 1)
    plane = 1 << (bits - 1)
    q = plane
    while q > 1:
        for i in range(axes):
            swap = (x[:, 0] ^ x[:, i]) & (q - 1)
            set_ = (x[:, i] & q) != 0
            x[:, 0] ^= np.where(set_, q - 1, swap)
            if i:
                x[:, i] ^= np.where(set_, 0, swap)
        q >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(rows, np.int64)
    q = plane
    while q > 1:
        turn ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def kept_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None
) -> DataFrame:
    """``row``, ``id``, ``label`` and ``ints`` of the vectors that can be coded, written once."""
    x = F.col("vector")
    finite = F.forall(
        x,
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))),
    )
    ints = F.transform(x, lambda v: F.floor(v * F.lit(float(SCALE))).cast("bigint"))
    too_large = F.exists(x, lambda v: F.abs(v) >= F.lit(MOST / SCALE))
    error = F.raise_error(
        F.concat(F.lit(f"a component is beyond {MOST // SCALE}: vector "), F.col("id").cast("string"))
    )
    label = F.lit(None) if label_col is None else F.col(label_col)
    picked = vectors.select(
        F.col(id_col).alias("id"),
        label.alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    usable = F.coalesce(finite & (F.size(x) > 0), F.lit(False))
    made = picked.filter(usable).select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "label",
        F.when(too_large, error.cast("array<bigint>")).otherwise(ints).alias("ints"),
    )
    return freeze(made, "kept-vectors")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(-1, width)


def flat_blocks(kept: DataFrame, dim: int, low: int, high: int, parts: int = PARTS) -> DataFrame:
    """The parts of all vectors, sorted along a Hilbert curve and cut into blocks.

    A row is one block of one part position: the box around its points, their sums,
    the points and the rows they belong to. Ranges of (position, place on the curve, row)
    are dealt to tasks, so vectors that repeat are spread as well.
    """
    width = dim // parts
    bits = max(1, min(7, 56 // width))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, rows = _matrix(batch.column(1), dim), batch.column(0)
            for part in range(parts):
                points = np.ascontiguousarray(whole[:, part * width : (part + 1) * width])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(points), part, np.int32)),
                        pa.array(hilbert_keys(points, low, high, bits), pa.binary()),
                        rows,
                        pa.array([p.tobytes() for p in points.astype("<i4")], pa.binary()),
                    ],
                    names=["part", "curve", "row", "point"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows = -1, [], []

        def block() -> pa.RecordBatch:
            points = np.frombuffer(b"".join(held), "<i4").reshape(-1, width).astype(np.int64)
            values = [
                [part],
                [len(points)],
                [points.min(axis=0).tolist()],
                [points.max(axis=0).tolist()],
                [points.sum(axis=0).tolist()],
                [b"".join(held)],
                [np.array(rows, "<i8").tobytes()],
            ]
            arrays = [pa.array(v, f.type) for v, f in zip(values, _BLOCK)]
            return pa.RecordBatch.from_arrays(arrays, schema=_BLOCK)

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(3))
            for p, row, point in zip(*columns):
                if held and (p != part or len(held) >= BLOCK_ROWS):
                    yield block()
                    held, rows = [], []
                part = p
                held.append(point)
                rows.append(row)
        if held:
            yield block()

    schema = "part int, curve binary, row bigint, point binary"
    points = kept.select("row", "ints").mapInArrow(split, schema)
    dealt = freeze(points, "parts").repartitionByRange("part", "curve", "row")
    sorted_ = dealt.sortWithinPartitions("part", "curve", "row").select("part", "row", "point")
    return freeze(
        sorted_.mapInArrow(
            cut,
            "part int, n int, low array<bigint>, high array<bigint>, sums array<bigint>, "
            "points binary, rows binary",
        ),
        "flat-blocks",
    )


_BLOCK = pa.schema(
    [
        ("part", pa.int32()), ("n", pa.int32()), ("low", pa.list_(pa.int64())),
        ("high", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())),
        ("points", pa.binary()), ("rows", pa.binary()),
    ]
)


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes of the entries that can be nearest to some point of the box, ascending.

    An entry is left out only if its least distance to the box is above the greatest of
    another, so no point of the box is nearer to it, nor as near.
    """
    outside = np.maximum(0, np.maximum(low - entries, entries - high))
    least = (outside**2).sum(axis=1)
    most = (np.maximum(np.abs(entries - low), np.abs(entries - high)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def assign(points: np.ndarray, entries: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest listed entry of each point, ties to the lower index, and its squared distance."""
    apart = points[:, None, :] - entries[listed][None, :, :]
    squared = np.einsum("nld,nld->nl", apart, apart)
    best = squared.argmin(axis=1)
    return listed[best], squared[np.arange(len(points)), best]


def _each_block(entries: list[np.ndarray]) -> Callable:
    """``(part, entries, listed, points, rows, sums)`` of every block of a batch."""

    def read(batch: pa.RecordBatch):
        for part, n, low, high, sums, points, rows in zip(*(c.to_pylist() for c in batch.columns)):
            own = entries[part]
            listed = shortlist(np.array(low, np.int64), np.array(high, np.int64), own)
            yield part, own, listed, sums, n, points, rows

    return read


def _points(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, width).astype(np.int64)


def one_round(blocks: DataFrame, entries: list[np.ndarray]) -> list[np.ndarray]:
    """The entries after one round: each the floor of the mean of its points, if it has any.

    Every task passes on one row per entry with the sums of its blocks. A block whose
    shortlist has one entry adds its stored sums without its points being read.
    """
    width = entries[0].shape[1]
    read = _each_block(entries)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}

        def add(part, entry, n, total):
            met = totals.setdefault((part, entry), np.zeros(width + 1, np.int64))
            met[0] += n
            met[1:] += total

        for batch in batches:
            for part, own, listed, total, n, raw, _ in read(batch):
                if len(listed) == 1:
                    add(part, int(listed[0]), n, np.array(total, np.int64))
                    continue
                points = _points(raw, width)
                nearest, _ = assign(points, own, listed)
                for entry in np.unique(nearest):
                    mine = points[nearest == entry]
                    add(part, int(entry), len(mine), mine.sum(axis=0))
        rows = [(p, e, v.tolist()) for (p, e), v in totals.items()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            ],
            names=["part", "entry", "total"],
        )

    made = blocks.mapInArrow(sums, "part int, entry int, total array<bigint>")
    added = made.groupBy("part", "entry").agg(
        *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width + 1)]
    )
    after = [own.copy() for own in entries]
    for row in added.collect():
        count, *total = row[2:]
        after[row.part][row.entry] = [t // count for t in total]
    return after


def assigned(blocks: DataFrame, entries: list[np.ndarray]) -> DataFrame:
    """``row``, ``code`` and ``error``: the code of a whole vector, a byte per part in order."""
    width, parts = entries[0].shape[1], len(entries)
    read = _each_block(entries)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own, listed, _, _, raw, rows in read(batch):
                nearest, apart = assign(_points(raw, width), own, listed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(rows, "<i8")),
                        pa.array(np.full(len(nearest), part, np.int32)),
                        pa.array(nearest.astype(np.int32)),
                        pa.array(apart),
                    ],
                    names=["row", "part", "entry", "apart"],
                )

    found = blocks.mapInArrow(codes, "row bigint, part int, entry int, apart bigint")
    digits = [
        F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), 2, "0")
        for p in range(parts)
    ]
    return found.groupBy("row").agg(
        F.concat(*digits).alias("code"), F.sum("apart").alias("error")
    )


def first_entries(kept: DataFrame, dim: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids; equal ids by their components."""
    rows = (
        kept.select("id", "ints")
        .orderBy(F.col("id").asc_nulls_last(), "ints")
        .limit(entries)
        .collect()
    )
    whole = np.array([r.ints for r in rows], np.int64).reshape(len(rows), parts, dim // parts)
    return [np.ascontiguousarray(whole[:, p]) for p in range(parts)]


def codebook_digest(entries: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position, joined by commas."""
    numbers = (str(v) for own in entries for v in own.reshape(-1).tolist())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def product_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors and the codebooks, one array of integer entries per part.

    Components become the integer ``floor(4096 * x)`` and all sums and distances are of whole
    numbers, so the result depends on no order or layout. The codebook of a part starts as
    that part of the vectors with the smallest ids and is refined ``rounds`` times.
    Points lie in flat blocks along a Hilbert curve with their box and sums; a block
    compares its box with the entries first and its points only with those that can be nearest.
    On the driver are the codebooks alone.

    The rows have ``id``, ``label`` (the column of that name, else null), ``code`` (two hex
    digits per part) and ``error``, the squared distances to the entries, summed over parts.
    Vectors that are null, empty, or hold null or non-finite components take no part, nor do
    those whose length differs from that of the vector with the smallest id. A length that
    ``parts`` does not divide and components of 32,768 or more are errors. Rows that repeat
    are coded each. Null ids come last among the first entries; with fewer vectors than
    ``entries`` the codebooks are smaller. An empty table gives no rows and no codebooks.
    Other columns are not read. The jobs run when called.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    label = "label" if "label" in vectors.columns else None
    kept = kept_vectors(vectors, id_col, vector_col, label)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "ints").select(F.size("ints")).first()
    if first is None:
        empty = kept.select(
            "id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")
        )
        return empty, []
    dim = first[0]
    if dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")
    kept = kept.filter(F.size("ints") == dim)
    bounds = kept.agg(
        F.min(F.array_min("ints")).alias("low"), F.max(F.array_max("ints")).alias("high")
    ).first()
    books = first_entries(kept, dim, parts, entries)
    blocks = flat_blocks(kept, dim, bounds["low"], bounds["high"], parts)
    for _ in range(rounds):
        books = one_round(blocks, books)
    codes = freeze(assigned(blocks, books), "codes")
    release(blocks)
    return kept.select("row", "id", "label").join(codes, "row").drop("row"), books


def code_report(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Codes with the error of all vectors of the same label and the codebooks' digest."""
    codes, books = product_codes(vectors, id_col)
    codes = freeze(codes, "coded-vectors")
    by_label = freeze(
        codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")),
        "label-errors",
    )
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(id_col),
        "code",
        "error",
        "label_error",
        F.lit(codebook_digest(books)).alias("codebooks_sha256"),
    )
