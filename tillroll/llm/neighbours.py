"""Approximate nearest neighbours: a k-means tree searched best bin first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from tillroll.llm.common import bounded_sample
from tillroll.session import freeze

#: The most vectors the tree is fitted on, and the most queries it is calibrated with.
SAMPLE_ROWS = 20_000
CALIBRATION_QUERIES = 256
BRANCHES = 8
#: Rows worth a leaf. Leaves grow with the root of the table, and so do the visits of a query;
#: a leaf holds at least ``LEAST_SAMPLE`` vectors of the sample, or its centre means nothing.
LEAF_ROWS = 128
LEAVES_TO_ROOT = 4
LEAST_SAMPLE = 4
RECALL = 0.95
#: Rows of one task when a leaf is searched; larger leaves are split.
BLOCK_ROWS = 4096
QUERY_BATCH = 512


def usable(vector: Column) -> Column:
    """Vectors that have a direction: not null, no null or non-finite part, not zero."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(
        parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(parts, lambda x: x != 0.0), F.lit(False))


@dataclass
class Node:
    """A cell of the tree: its centre, and either cells below or a leaf number."""

    centres: np.ndarray | None = None
    below: list["Node"] = field(default_factory=list)
    leaf: int = -1


def _kmeans(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8):
    """Centres and assignment; empty clusters take no part."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[random.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        used = np.unique(near)
        centres = np.array([x[near == c].mean(axis=0) for c in used])
    return centres, _nearest(x, centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre at the smallest distance, the first of equals."""
    return np.argmin((centres**2).sum(axis=1) - 2.0 * (x @ centres.T), axis=1)


@dataclass
class KMeansTree:
    """Built from the top down: cells are split by k-means until small enough."""

    root: Node
    leaves: int

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 5):
        random = np.random.default_rng(seed)
        root, count = Node(), 0
        least = max(2, len(x) // max(1, leaves))
        stack = [(root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if len(rows) > least:
                k = min(branches, max(2, round(len(rows) / least)))
                centres, near = _kmeans(x[rows], k, random)
                if len(centres) > 1:
                    node.centres = centres
                    node.below = [Node() for _ in centres]
                    stack += [(n, rows[near == c]) for c, n in enumerate(node.below)]
                    continue
            node.leaf = count
            count += 1
        return cls(root, count)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf each vector falls into, going to the nearest centre at each level."""
        out = np.zeros(len(x), np.int32)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node.centres is None:
                out[rows] = node.leaf
                continue
            near = _nearest(x[rows], node.centres)
            stack += [(n, rows[near == c]) for c, n in enumerate(node.below) if (near == c).any()]
        return out

    def visit(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order, at most so many.

        The queue holds cells by how little they promise: the negative inner product
        of the query with their centre. Opening a cell queues those below it.
        """
        queue, tie, found = [(0.0, 0, self.root)], 1, []
        while queue and len(found) < most:
            _, _, node = heapq.heappop(queue)
            if node.centres is None:
                found.append(node.leaf)
                continue
            for promise, child in zip(-(node.centres @ query), node.below):
                heapq.heappush(queue, (float(promise), tie, child))
                tie += 1
        return found


def _exact(queries: np.ndarray, x: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, summed part by part in order.

    A matrix product may round the same pair differently from block to block; this
    gives equal vectors equal scores wherever they lie.
    """
    total = np.zeros(len(at))
    for d in range(x.shape[1]):
        total += queries[at, d] * x[place, d]
    return total


def _best(query_ids, queries, ids, x, k, bars):
    """The top ``k`` of a block for each query, none below its bar; ties to the smaller id.

    Three arrays side by side: places of queries, places in the block, scores.
    """
    rough = queries @ x.T
    slack = 1e-9 * (1.0 + np.abs(rough).max(axis=1, initial=0.0))
    keep = (rough >= (bars - slack)[:, None]) & (ids[None, :] != query_ids[:, None])
    many = np.flatnonzero(keep.sum(axis=1) > k)
    if len(many):
        among = np.where(keep[many], rough[many], -np.inf)
        least = np.partition(among, len(ids) - k, axis=1)[:, len(ids) - k]
        keep[many] = among >= (least - slack[many])[:, None]
    at, place = np.nonzero(keep)
    exact = _exact(queries, x, at, place)
    order = np.lexsort((ids[place], -exact, at))
    at, place, exact = at[order], place[order], exact[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], place[first], exact[first]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


_FOUND = "query_id bigint, form bigint, vec_id bigint, score double"
# What tells queries apart: rows of one id with different vectors are queries of their own.
_QUERY = ("query_id", "form")


def leaves_for(rows: int, sampled: int) -> int:
    """Leaves to ask of a tree over so many rows, of which so many are at hand."""
    wanted = min(rows // LEAF_ROWS, math.isqrt(rows) // LEAVES_TO_ROOT)
    return max(1, min(wanted, sampled // LEAST_SAMPLE))


def _top(found: DataFrame, k: int, query: tuple[str, ...] = _QUERY) -> DataFrame:
    best_first = Window.partitionBy(*query).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def _true_leaves(placed: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Leaves of the exact top ``k`` of a bounded set of queries, over all rows in one pass.

    One row for each of those neighbours, ``k`` at most for each place in ``queries``.
    """
    width, no_bar = queries.shape[1], np.full(len(ids), -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                own = part.column(0).to_numpy()
                x = _matrix(part.column(1), width)
                at, place, score = _best(ids, queries, own, x, k, no_bar)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at),
                        pa.array(own[place]),
                        part.column(2).take(pa.array(place)),
                        pa.array(score),
                    ],
                    names=["query", "vec_id", "leaf", "score"],
                )

    found = placed.select("vec_id", "vector", "leaf").mapInArrow(
        run, "query bigint, vec_id bigint, leaf int, score double"
    )
    return _top(found, k, ("query",)).select("query", "leaf")


def _sample(vectors: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    picked = bounded_sample(vectors, "vec_id", limit).toArrow()
    if not picked.num_rows:
        return np.empty(0, np.int64), np.empty((0, 1))
    width = len(picked["vector"][0])
    return picked["vec_id"].to_numpy(), _matrix(picked["vector"], width)


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Nearest ``k`` rows, by inner product, of each row whose id ``every`` divides.

    A tree is fitted on at most ``SAMPLE_ROWS`` vectors, with leaves in proportion to the
    root of the table's rows. All rows fall into its leaves. For at most
    ``CALIBRATION_QUERIES`` of the queries the true neighbours are found over all
    rows; where those lie among the leaves, in the order in which the search visits
    them, gives the number of visits that reaches ``recall``. Each query then
    searches so many leaves: the first few, about the root of that number, give it
    ``k`` neighbours, and the others only what is no worse than the last of
    those. A leaf with many rows, such as one of equal vectors, is split into blocks of
    bounded size, and each gives its best ``k``.

    Returns ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (double precision on the
    vectors as given), and fewer rows where there are fewer candidates. A query is
    not its own candidate; other rows with its id are not either. Rows of one id with different
    vectors are queries of their own, whose results stand side by side under that id; equal rows
    ask once. Equal scores go to the smaller id, and rows that repeat a candidate are
    candidates each. Null, zero or
    non-finite vectors and null ids take no part, nor do vectors of another length
    than the commonest.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    good = vectors.filter(F.col(id_col).isNotNull() & usable(vector)).select(
        F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector")
    )
    widths = good.groupBy(F.size("vector").alias("width")).count().orderBy(
        F.col("count").desc(), "width"
    ).limit(1).collect()
    schema = T._parse_datatype_string("query_id bigint, rank int, vec_id bigint, score double")
    if not widths:
        return spark.createDataFrame([], schema)
    width, rows = widths[0]
    good = good.filter(F.size("vector") == width)
    _, sample = _sample(good, SAMPLE_ROWS)
    tree = KMeansTree.fit(sample, leaves_for(rows, len(sample)))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(leaf)],
                names=["vec_id", "vector", "leaf"],
            )

    element = vectors.schema[vector_col].dataType.simpleString()
    placed = freeze(
        good.mapInArrow(place, f"vec_id bigint, vector {element}, leaf int"), "leaves"
    )
    queries = placed.filter(F.col("vec_id") % every == 0).withColumn(
        "form", F.xxhash64("vector")
    ).dropDuplicates(["vec_id", "form"])
    query_ids, query_vectors = _sample(queries, CALIBRATION_QUERIES)
    if not len(query_ids):
        return spark.createDataFrame([], schema)

    truth = _true_leaves(placed, query_ids, query_vectors, k).collect()
    order = [
        {leaf: n for n, leaf in enumerate(tree.visit(q, tree.leaves), 1)} for q in query_vectors
    ]
    needed = np.sort([order[r["query"]][r["leaf"]] for r in truth])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.visit(q, visits) for q in _matrix(batch.column(1), width)]
            times = [len(f) for f in found]
            at = pa.array(np.repeat(np.arange(batch.num_rows), times))
            turn = np.concatenate([np.arange(n) for n in times] or [[]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(2).take(at),
                    batch.column(1).take(at),
                    pa.array(np.concatenate(found or [[]]).astype(np.int32)),
                    pa.array(turn),
                ],
                names=["query_id", "form", "query", "leaf", "turn"],
            )

    asked = queries.select("vec_id", "vector", "form").mapInArrow(
        ask, f"query_id bigint, form bigint, query {element}, leaf int, turn int"
    )
    sizes = placed.groupBy("leaf").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")
    )
    members = placed.join(F.broadcast(sizes), "leaf").select(
        "leaf",
        F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int").alias("block"),
        "vec_id",
        "vector",
    )
    spread = (
        asked.join(F.broadcast(sizes), "leaf")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", "block", *_QUERY, "query", "turn")
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        ids, x = right["vec_id"].to_numpy(), _matrix(right["vector"], width)
        asking, q = left["query_id"].to_numpy(), _matrix(left["query"], width)
        bars = left["bar"].to_numpy()
        hits = []
        for start in range(0, len(q), QUERY_BATCH):
            some = slice(start, start + QUERY_BATCH)
            at, place, score = _best(asking[some], q[some], ids, x, k, bars[some])
            hits.append((at + start, place, score))
        at, place, score = (np.concatenate(h) for h in zip(*hits))
        return pa.table(
            {
                "query_id": asking[at],
                "form": left["form"].to_numpy()[at],
                "vec_id": ids[place],
                "score": score,
            },
            schema=arrow,
        )

    arrow = pa.schema(
        [("query_id", pa.int64()), ("form", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
    )

    def searched(asking: DataFrame) -> DataFrame:
        return (
            asking.drop("turn")
            .groupBy("leaf", "block")
            .cogroup(members.groupBy("leaf", "block"))
            .applyInArrow(search, _FOUND)
        )

    first = math.isqrt(max(0, visits - 1)) + 1
    lowest = F.lit(float("-inf"))
    near = freeze(
        _top(searched(spread.filter(F.col("turn") < first).withColumn("bar", lowest)), k), "near"
    ).select(*_QUERY, "vec_id", "score")
    bars = near.groupBy(*_QUERY).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(lowest).alias("bar")
    )
    rest = spread.filter(F.col("turn") >= first).join(bars, list(_QUERY), "left")
    rest = rest.withColumn("bar", F.coalesce("bar", lowest))
    found = near.union(searched(rest.select(*spread.columns, "bar")))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
