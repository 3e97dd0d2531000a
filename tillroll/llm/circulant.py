"""Near duplicates by MinHash signatures from two permutations, one circularly shifted."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import map_rows
from tillroll.llm.links import Verifier, label_of, linked_components, sketch
from tillroll.llm.shingles import WordShingles, mixed
from tillroll.session import freeze, release

WORDS = 2
#: A link is missed if all bands differ: at a similarity of 0.8 one time in
#: 600 million, as (1 - 0.8 ** 5) ** 51 is 1.6e-9, and less often above it.
ROWS, BANDS = 5, 51
COORDINATES = ROWS * BANDS
_SLAB = 512


def first_permutation(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit numbers, which breaks up any order in the elements."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def second_permutation(x: np.ndarray, spare: np.ndarray) -> None:
    """Another bijection of 32-bit numbers, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def signature(own: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Least image of the set under the second permutation, once for each circular shift.

    The first permutation places every element on a circle of 2**32 places. Coordinate k
    is the minimum of the second one over the places, all moved on by k; so two fixed
    permutations serve for all coordinates.
    """
    place = first_permutation((own.astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), _SLAB):
        moved = place[None, at : at + _SLAB] + shift
        second_permutation(moved, np.empty_like(moved))
        np.minimum(least, moved.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, which also tells the bands apart."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i] + np.uint64(1))
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: size and digest of its set, its bands and its sketch.

    Documents with equal sets have the same ``key``. Bands and the set's sketch come with
    the first of them in a task and are null for the others.
    """

    def start() -> Callable:
        shingles, told = WordShingles(WORDS), set()

        def row(doc, text_hash, text):
            own = shingles(text or "")
            if not len(own):
                return doc, text_hash, 0, None, None, None
            key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            if key in told:
                return doc, text_hash, len(own), key, None, None
            told.add(key)
            return doc, text_hash, len(own), key, band_keys(signature(own)), sketch(own)

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    return map_rows(
        rows,
        ["id", "text_hash", "text"],
        start,
        f"id {kind}, text_hash bigint, n bigint, key binary, bands array<bigint>, "
        "sketch binary",
    )


def near_duplicate_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``signatures`` and the components of their keys (None without links).

    Documents with equal sets form a class and are never paired. Classes that agree in
    a band form a list, and the links within the lists are verified on the whole sets.
    """
    rows = freeze(signatures(docs, id_col, text_col), "signatures")
    told = rows.filter(F.col("bands").isNotNull())
    entries = told.select("key", F.explode("bands").alias("h"))
    shared = (
        entries.groupBy("h")
        .agg(F.min("key").alias("k0"), F.max("key").alias("k1"))
        .filter(F.col("k0") < F.col("k1"))
        .select("h")
    )
    lists = freeze(entries.join(shared, "h").distinct(), "lists")
    classes = freeze(
        told.join(lists.select("key").distinct(), "key", "left_semi")
        .select("key", "n", "sketch", F.col("id").alias("rep"), "text_hash")
        .dropDuplicates(["key"]),
        "classes",
    )
    verify = Verifier(docs, classes, lambda: WordShingles(WORDS), id_col, text_col)
    comps = linked_components(lists, None, classes, verify)
    for done in (lists, classes):
        release(done)
    return rows, comps


def circulant_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Size of each document's shingle set, its component, and whether it is the one kept.

    Two documents are linked when 100 times the intersection of their sets of two-word
    shingles is at least 80 times the union; candidates come from bands of a circulant
    MinHash signature, links from the whole sets. Returns ``id_col``, ``n_shingles``,
    ``component_id``, the smallest id that links reach, and ``kept``, true for the
    document with that id.

    A text without words, empty or null, has no shingles and is linked with nothing,
    not even its like. Rows that repeat belong together and share ``kept``. A component
    whose rows all lack an id has a null one, and they are kept. An empty table gives no rows. Other columns are not read. The jobs run when
    called; what they pass on is in the shared folder.
    """
    rows, comps = near_duplicate_classes(docs, id_col, text_col)
    filled = rows.filter(F.col("n") > 0)
    least = label_of(
        filled.groupBy("key").agg(F.min("id").alias("least")), "key", comps, "comp"
    )
    if comps is not None:
        smallest = least.groupBy("comp").agg(F.min("least").alias("component_id"))
        least = least.select("key", "comp").join(smallest, "comp")
    else:
        least = least.withColumnRenamed("least", "component_id")
    found = filled.join(least.select("key", "component_id"), "key")
    empty = rows.filter(F.col("n") == 0)
    columns = ["id", "n", "component_id"]
    whole = found.select(*columns).union(
        empty.select("id", "n", F.col("id").alias("component_id"))
    )
    return whole.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
