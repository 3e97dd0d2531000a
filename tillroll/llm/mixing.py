"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.llm.common import SPACE, WORD, ordered_blocks, running_totals, set_aside
from tillroll.session import freeze

#: Base weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
#: How a source's weight moves over training, by the same rule for each third:
#: weight at the start and at the end, as multiples of its base weight.
TILTS = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))


def source_targets(
    sized: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    ceiling: float = CEILING,
) -> DataFrame:
    """Words each source is to give: ``source``, ``source_size``, ``weight``, ``target``.

    The sources share ``share`` times all words by weight. A source stops at
    ``ceiling`` times its own, and what it cannot take goes to the others by weight
    until none is above. Ordered by size over weight, those that stop come first.
    Stopping the first k gives the others a level, in words per unit of weight: no
    k gives more than the true level, and the right k gives just that, so it is the
    largest. The windows without a key work on the summary of one row per source,
    never on documents.
    """
    if not 0 < share < ceiling:
        raise ValueError("the sources cannot give that share")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (position % F.lit(len(weights)) + F.lit(1)).cast("int"),
    )
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("_position"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.lit(ceiling) * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    most = F.lit(ceiling) * F.col("source_size")
    levels = (
        sources.withColumns({"_position": position, "weight": weight})
        .withColumn("_level", left / F.sum("weight").over(after))
        .withColumn("_level", F.max("_level").over(everything))
    )
    return levels.select(
        "source",
        "source_size",
        "weight",
        "_position",
        F.least(most, F.col("weight") * F.col("_level")).alias("target"),
    )


def schedule_position(fraction: Column, start: Column, end: Column) -> Column:
    """The time in [0, 1] by which ``fraction`` of a source's demand has been met.

    The source's weight runs from ``start`` to ``end`` in a straight line, so its
    demand up to time t is ``start * t + (end - start) * t * t / 2``, with the whole
    at 1. The root is taken in the form that holds for equal weights too.
    """
    due = fraction * (start + end) / 2
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * (end - start) * due))
    return F.when(due <= 0, F.lit(0.0)).otherwise(2 * due / (start + root))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    ceiling: float = CEILING,
    tilts: Sequence[tuple[float, float]] = TILTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes, and when.

    A source's documents follow each other in the order of the digest of their id,
    and again from the start until its target is met; the document at the
    target gives only the words still due. So a source gives its target to the
    word, and no document more than ``ceiling`` (at most 2) times its size. Each reading
    has its training position: the source's weight schedule is integrated and
    the demand it adds up to inverted at the words read before.

    Columns: ``id_col``, ``text_hash``, ``size`` (words), ``source``, ``source_size``,
    ``target``, ``taken``, ``position`` and ``second_position`` (when the first and
    second reading begin; null for a reading that takes no words). A null text has no words, a null source
    is a source of its own, the last. Rows that repeat are separate documents.
    The text is read once, when called; what is listed here is kept in the shared folder,
    and a hot source is cut into blocks.
    """
    if not 0 < ceiling <= 2:
        raise ValueError("a document is read at most twice")
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    key = F.col(id_col)
    text_hash = F.xxhash64(text_col).alias("text_hash")
    sized = freeze(
        docs.select(key, F.col(source_col).alias("source"), size.alias("size"), text_hash), "mix"
    )
    targets = source_targets(sized, weights, share, ceiling)
    order = [
        F.md5(F.coalesce(key.cast("string"), F.lit(""))).asc(),
        key.asc_nulls_first(),
        F.col("size").asc(),
    ]
    blocks = ordered_blocks(sized, "source", order, "mix-blocks")
    placed = running_totals(blocks, "source", order, {"_ahead": "size"})
    targets = targets.withColumnRenamed("source", "_source")
    rows = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    due = F.round("target").cast("bigint")
    again = F.col("_ahead") + F.col("source_size")

    def read(ahead: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), due - ahead))

    def tilt(end: int) -> Column:
        return F.element_at(
            F.array(*[F.lit(float(t[end])) for t in tilts]),
            (F.col("_position") % F.lit(len(tilts)) + F.lit(1)).cast("int"),
        )

    def position(ahead: Column) -> Column:
        met = F.least(F.lit(1.0), ahead / F.greatest(due, F.lit(1)))
        return F.when(read(ahead) > 0, schedule_position(met, tilt(0), tilt(1)))

    return rows.select(
        id_col,
        "text_hash",
        "size",
        "source",
        "source_size",
        "target",
        (read(F.col("_ahead")) + read(again)).alias("taken"),
        position(F.col("_ahead")).alias("position"),
        position(again).alias("second_position"),
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **options,
) -> DataFrame:
    """The readings of the mix as rows of ``docs``, sorted by position.

    A document read twice is two rows; one not read is none. A reading of fewer words
    than the document has is cut after them. Other columns are as they were. Rows
    that repeat are told apart by number, where there are any.
    """
    roles = {"doc_id": id_col, "text": text_col, "source": source_col}
    docs, restored = set_aside(docs, roles)
    plan = mix(docs, **options)
    read = plan.filter(F.col("taken") > 0)
    first = F.least("taken", "size")
    readings = F.filter(
        F.array(
            F.struct(F.col("position").alias("position"), first.alias("words")),
            F.struct(
                F.col("second_position").alias("position"),
                (F.col("taken") - F.col("size")).alias("words"),
            ),
        ),
        lambda r: r["position"].isNotNull() & (r["words"] > 0),
    )
    rows = docs.withColumns({"_hash": F.xxhash64("text"), "_number": F.lit(0)})
    read = read.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash"),
        F.lit(0).alias("_which"), "size", readings.alias("_readings"),
    )
    alike = plan.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    if not alike.filter("rows > 1").isEmpty():
        # Those that are read come first among their like.
        most_read = F.size("_readings").desc()
        which = Window.partitionBy("_id", "_text_hash").orderBy(most_read)
        rows = rows.withColumn(
            "_number", F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy(F.lit(0)))
        )
        read = read.withColumn("_which", F.row_number().over(which))
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & (F.col("_hash") == F.col("_text_hash"))
        & (F.col("_number") == F.col("_which"))
    )
    made = rows.join(read, same).withColumn("_reading", F.explode("_readings"))
    words = F.regexp_extract_all("text", F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, 1, F.col("_reading.words").cast("int")), "")
    shorter = F.col("_reading.words") < F.col("size")
    made = made.withColumn("text", F.when(shorter, cut).otherwise(F.col("text")))
    by = [F.col("_reading.position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return restored(made.repartitionByRange(*by).sortWithinPartitions(*by))


def by_position(readings: DataFrame, *keys: str) -> DataFrame:
    """Range-sort over the cluster by ``position``, then ``keys``."""
    by = [F.col("position").asc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]]
    return readings.repartitionByRange(*by).sortWithinPartitions(*by)
