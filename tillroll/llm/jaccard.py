"""Near duplicates by Jaccard similarity of word shingles: a grouped prefix join."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import map_rows, set_aside
from tillroll.llm.links import (
    PARTS,
    WHOLE,
    Verifier,
    label_of,
    linked_components,
    sketch,
)
from tillroll.llm.shingles import WordShingles
from tillroll.session import freeze, release

WORDS = 5
#: Shingles met this often go last in the order. At most ``LAST_KEPT`` of them do,
#: the most frequent. Any such set gives the same links; it only shortens lists.
FREQUENT = 24
LAST_KEPT = 1_000_000
_LOCAL_LEAST = 2
_CHUNK = 2_000_000
#: Lists of at most so many sets give all their pairs; longer ones keep their lists.
SHORT_LIST = 32


def prefix_length(n: int) -> int:
    """Any set linked with one of ``n`` shares one of its first so many elements."""
    return n - -(-PARTS * n // WHOLE) + 1


def _digest(*parts: bytes) -> tuple[int, int]:
    made = hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    return tuple(np.frombuffer(made, np.int64).tolist())


def frequent_shingles(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of frequent shingles, at most ``LAST_KEPT``.

    Each task counts what it reads, each different set once, and passes on what it
    met a few times; so the counts are low estimates. They decide an order and
    nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, held, size = WordShingles(WORDS), set(), [], 0

        def counted() -> pa.RecordBatch:
            values = np.concatenate(held) if held else np.empty(0, np.int64)
            found, count = np.unique(values, return_counts=True)
            often = count >= _LOCAL_LEAST
            return pa.RecordBatch.from_arrays(
                [pa.array(found[often]), pa.array(count[often])], names=["shingle", "met"]
            )

        for batch in batches:
            for value in batch.column(0):
                own = shingles(value.as_py() or "")
                mark = hash(own.tobytes())
                if mark in seen:
                    continue
                seen.add(mark)
                held.append(own)
                size += len(own)
                if size >= _CHUNK:
                    yield counted()
                    held, size = [], 0
                    seen.clear()
        yield counted()

    counts = docs.select(text_col).mapInArrow(run, "shingle bigint, met bigint")
    often = (
        counts.groupBy("shingle")
        .agg(F.sum("met").alias("met"))
        .filter(F.col("met") >= FREQUENT)
        .orderBy(F.col("met").desc(), "shingle")
        .limit(LAST_KEPT)
    )
    return np.sort(often.toPandas()["shingle"].to_numpy(np.int64))


def shingle_sets(
    docs: DataFrame, frequent: np.ndarray, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: size and digest of its set, its group, prefix and sketch.

    Sets are ordered by hash with frequent shingles last. Documents with the same
    prefix and size are one group. The prefix comes with one document of each group in
    a task, the sketch with one of each set, and they are null for the others.
    """
    spark = docs.sparkSession
    last = spark.sparkContext.broadcast(frequent)

    def start() -> Callable:
        shingles, often, told = WordShingles(WORDS), last.value, set()

        def row(key, text_hash, text):
            own = shingles(text or "")
            n = len(own)
            if not n:
                return key, text_hash, 0, 0, 0, 0, 0, None, None
            ordered = own
            if len(often):
                at = np.searchsorted(often, own).clip(max=len(often) - 1)
                is_last = often[at] == own
                ordered = np.concatenate([own[~is_last], own[is_last]])
            prefix = ordered[: prefix_length(n)]
            group = _digest(n.to_bytes(8, "little"), prefix.tobytes())
            whole = _digest(own.tobytes())
            new_group, new_set = group not in told, whole not in told
            told.update((group, whole))
            return key, text_hash, n, *whole, *group, (
                prefix if new_group else None
            ), (sketch(own) if new_set else None)

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col)
    return map_rows(
        rows,
        [id_col, "text_hash", text_col],
        start,
        f"`{id_col}` {kind}, text_hash bigint, n bigint, d1 bigint, d2 bigint, "
        "g1 bigint, g2 bigint, prefix array<bigint>, sketch binary",
    )


def _needed(a: Column, b: Column) -> Column:
    """``least_common`` of the sum, in whole numbers."""
    whole = F.lit(WHOLE + PARTS)
    return F.floor((F.lit(PARTS) * (a + b) + whole - 1) / whole)


def _close_sizes(a: Column, b: Column) -> Column:
    return F.least(a, b) >= _needed(a, b)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size of each document's shingle set and the component its links put it in.

    Exact over all documents: two are linked when 100 times the intersection of
    their sets is at least 80 times the union. Documents with equal sets form a class,
    so copies are never paired with each other. Classes with the same prefix and
    size form a group; groups that share a prefix element form a list. Short lists
    give their pairs, and those with too few common elements for their places are
    dropped; long lists stay as they are. Their members are the candidates, which are
    verified on the whole sets until no two components can be linked.

    Returns ``id_col``, ``n_shingles`` and ``component_id``, the smallest id in the
    component. A text without words, or null, has no shingles and is linked with nothing, not
    even its like. Rows that repeat belong together. The jobs run when called; what
    they pass on is in the shared folder.
    """
    return _components(docs, id_col, text_col).drop("_comp")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``near_duplicates``, with ``_comp`` to tell components apart whose
    smallest id is the same; null where a text has no shingles."""
    frequent = frequent_shingles(docs, text_col)
    rows = freeze(shingle_sets(docs, frequent, id_col, text_col), "shingle-sets")
    filled = rows.filter(F.col("n") > 0)
    classes = freeze(
        filled.withColumn("cid", F.monotonically_increasing_id())
        .groupBy("d1", "d2")
        .agg(
            F.min(F.struct("cid", id_col, "text_hash")).alias("first"),
            F.min(id_col).alias("least"),
            *[F.first(c).alias(c) for c in ("n", "g1", "g2")],
        )
        .select(
            "d1", "d2", "first.cid", F.col(f"first.{id_col}").alias("rep"), "first.text_hash",
            "least", "n", "g1", "g2",
        ),
        "classes",
    )
    counted = classes.groupBy("g1", "g2").agg(
        F.min("cid").alias("gid"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n")
    )
    groups = freeze(counted, "groups")
    prefixes = filled.groupBy("g1", "g2").agg(F.max("prefix").alias("prefix"))
    entries = prefixes.join(groups.select("g1", "g2", "gid"), ["g1", "g2"]).select(
        "gid", F.posexplode("prefix").alias("pos", "h")
    )
    shared = entries.groupBy("h").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    met = freeze(entries.join(shared.select("h"), "h"), "met")
    # The sets of one group make a list as well, under the name of the group.
    alone = groups.filter(F.col("k") > 1).select(
        "gid", F.lit(0).alias("pos"), F.col("gid").alias("h")
    )
    named = (
        met.select("gid", "pos", "h", F.lit(False).alias("own"))
        .union(alone.withColumn("own", F.lit(True)))
        .join(groups.select("gid", "k", "n"), "gid")
    )
    sizes = named.groupBy("h", "own").agg(F.sum("k").alias("sets"))
    lists = freeze(named.join(sizes, ["h", "own"]), "lists")
    release(met)
    members = classes.select(
        F.col("g1").alias("_g1"), F.col("g2").alias("_g2"), F.col("cid")
    ).join(
        groups.select(F.col("g1").alias("_g1"), F.col("g2").alias("_g2"), "gid"), ["_g1", "_g2"]
    ).select("gid", "cid")

    short = lists.filter(F.col("sets") <= SHORT_LIST)
    entries = F.array_sort(F.collect_list(F.struct("n", "gid", "pos")))
    inside = F.flatten(
        F.transform(
            "entries",
            lambda x, i: F.transform(
                F.filter(
                    F.slice(F.col("entries"), i + 2, SHORT_LIST),
                    lambda y: _close_sizes(x["n"], y["n"]),
                ),
                lambda y: F.struct(
                    x["gid"].alias("ga"), x["n"].alias("na"), x["pos"].alias("ia"),
                    y["gid"].alias("gb"), y["n"].alias("nb"), y["pos"].alias("ib"),
                ),
            ),
        )
    )
    # Common elements of two prefixes: those in short lists are counted, and of those in
    # long lists there are no more than either has. What comes after the last of them
    # is bounded by what is left of either set.
    in_long = (
        lists.filter((F.col("sets") > SHORT_LIST) & ~F.col("own"))
        .groupBy("gid")
        .agg(F.count(F.lit(1)).alias("long"))
    )
    counted_pairs = (
        short.filter(~F.col("own"))
        .groupBy("h")
        .agg(entries.alias("entries"))
        .select(F.explode(inside).alias("pair"))
        .groupBy("pair.ga", "pair.gb", "pair.na", "pair.nb")
        .agg(
            F.count(F.lit(1)).alias("common"),
            F.max("pair.ia").alias("ia"),
            F.max("pair.ib").alias("ib"),
        )
        .join(in_long.toDF("ga", "la"), "ga", "left")
        .join(in_long.toDF("gb", "lb"), "gb", "left")
    )
    longest = F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    after = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1
    enough = F.col("common") + longest + after >= _needed(F.col("na"), F.col("nb"))
    own_pairs = short.filter("own").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    group_pairs = counted_pairs.filter(enough).select("ga", "gb").union(own_pairs)
    short_pairs = freeze(
        group_pairs.join(members.select(F.col("gid").alias("ga"), F.col("cid").alias("ca")), "ga")
        .join(members.select(F.col("gid").alias("gb"), F.col("cid").alias("cb")), "gb")
        .filter(F.col("ca") != F.col("cb"))
        .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        .distinct(),
        "short-pairs",
    )
    long = freeze(
        lists.filter(F.col("sets") > SHORT_LIST)
        .join(members, "gid")
        .select(F.xxhash64("h", "own").alias("h"), F.col("cid").alias("key"))
        .distinct(),
        "long-lists",
    )
    release(lists)
    asked = (
        short_pairs.select(F.col("a").alias("cid"))
        .union(short_pairs.select("b"))
        .union(long.select("key"))
        .distinct()
    )
    sketches = rows.filter(F.col("sketch").isNotNull()).select("d1", "d2", "sketch")
    described = freeze(
        asked.join(classes, "cid")
        .join(sketches, ["d1", "d2"])
        .select(F.col("cid").alias("key"), "n", "sketch", "rep", "text_hash")
        .dropDuplicates(["key"]),
        "described",
    )
    verify = Verifier(docs, described, lambda: WordShingles(WORDS), id_col, text_col)
    comps = linked_components(long, short_pairs, described, verify)
    for done in (long, short_pairs, described, groups):
        release(done)

    labelled_classes = label_of(classes, "cid", comps, "comp")
    smallest = labelled_classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = labelled_classes.join(smallest, "comp").select(
        "d1", "d2", "component_id", F.col("comp").alias("_comp")
    )
    whole = rows.select(id_col, F.col("n").alias("n_shingles"), "text_hash", "d1", "d2")
    return (
        whole.filter(F.col("n_shingles") > 0)
        .join(of_class, ["d1", "d2"])
        .select(id_col, "n_shingles", "component_id", "text_hash", "_comp")
        .union(
            whole.filter(F.col("n_shingles") == 0).select(
                id_col, "n_shingles", F.col(id_col).alias("component_id"), "text_hash",
                F.lit(None).cast("bigint").alias("_comp"),
            )
        )
    )


def distinct_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the smallest id.

    Of a component's rows with that id, the smallest text hash stays, once. An id on
    several rows with unrelated texts stands for several components, and each keeps its
    own. Texts without words all stay, each linked with nothing, as do components
    without any id. All columns are kept.
    """
    docs, restored = set_aside(docs, {"doc_id": id_col, "text": text_col})
    made = _components(docs, "doc_id", "text")
    found = freeze(made, "components")
    release(made)
    linked = (F.col("n_shingles") > 0) & F.col("component_id").isNotNull()
    chosen = (
        found.filter(linked & (F.col("doc_id") == F.col("component_id")))
        .groupBy("_comp", "component_id")
        .agg(F.min("text_hash").alias("text_hash"))
        .select(F.col("component_id").alias("_id"), "text_hash")
    )
    alone = found.filter(~linked).select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("text_hash"))
    kept = docs.join(chosen, same, "left_semi")
    repeats = (
        found.filter(linked & (F.col("doc_id") == F.col("component_id")))
        .groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    )
    if not repeats.isEmpty():
        kept = (
            kept.withColumn("_text_hash", F.xxhash64("text"))
            .dropDuplicates(["doc_id", "_text_hash"])
            .drop("_text_hash")
        )
    if not alone.isEmpty():
        kept = kept.unionByName(docs.join(alone, same, "left_semi"))
    return restored(kept)
