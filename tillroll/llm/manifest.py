"""A Merkle manifest of a dataset: digests, inclusion proofs and their folding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import ordered_blocks, running_totals
from tillroll.session import freeze, release

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def record_digest(fields: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields: ``-`` for null, else size, ``:`` and value."""

    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")
        )

    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings on a path, level by level, left to right, as hex text."""
    texts = F.transform(path, lambda s: F.concat(_hex(s["before"]), _hex(s["after"])))
    return F.sha2(F.array_join(texts, ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf, as hex text, and the siblings on its path."""
    return F.aggregate(
        path,
        leaf,
        lambda node, s: F.sha2(F.concat(_hex(s["before"]), node, _hex(s["after"])), 256),
    )


def _with_siblings(nodes: DataFrame, fan_out: int, label: str) -> DataFrame:
    """One level: ``before`` and ``after``, the digests of a node's siblings.

    Nodes have ``grp``, ``at`` (their place in the group), ``n`` (nodes of the group)
    and ``digest``. Each sends its digest to the places its siblings have, and an equijoin
    on group and place brings them together, so runs never meet as a whole anywhere.
    """
    slot = F.col("at") % fan_out
    if fan_out == 2:
        place = F.col("at").bitwiseXOR(F.lit(1).cast("bigint"))
        sent = nodes.withColumn("_to", place)
    else:
        away = F.explode(F.sequence(F.lit(1), F.lit(fan_out - 1)))
        place = F.col("at") - slot + (slot + F.col("_away")) % fan_out
        sent = nodes.withColumn("_away", away).withColumn("_to", place)
    sent = sent.filter(F.col("_to") < F.col("n")).select(
        F.col("grp").alias("_grp"),
        "_to",
        F.struct(slot.alias("slot"), F.col("digest").alias("digest")).alias("_sent"),
    )
    met = nodes.join(
        sent, (F.col("grp") == F.col("_grp")) & (F.col("at") == F.col("_to")), "left"
    )
    kept = [c for c in nodes.columns if c not in ("grp", "at")]
    row = met.groupBy("grp", "at").agg(
        *[F.first(c).alias(c) for c in kept],
        F.array_sort(F.collect_list("_sent")).alias("_met"),
    )

    def side(test) -> Column:
        chosen = F.filter("_met", test)
        return F.unhex(F.array_join(F.transform(chosen, lambda s: F.hex(s["digest"])), ""))

    return freeze(
        row.select(
            "grp",
            "at",
            *kept,
            side(lambda s: s["slot"] < slot).alias("before"),
            side(lambda s: s["slot"] > slot).alias("after"),
        ),
        label,
    )


def _parents(level: DataFrame, fan_out: int) -> DataFrame:
    """The nodes that the rows in slot zero emit."""
    whole = F.concat(_hex(F.col("before")), _hex(F.col("digest")), _hex(F.col("after")))
    return level.filter(F.col("at") % fan_out == 0).select(
        "grp",
        F.expr(f"at div {fan_out}").alias("at"),
        F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
    )


def _tree(leaves: DataFrame, most: int, fan_out: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all groups' trees, lowest first, and each group's last node."""
    levels, ends, nodes = [], [], leaves
    while True:
        ends.append(nodes.filter("n = 1").select("grp", "digest"))
        if most <= 1:
            break
        level = _with_siblings(nodes.filter("n > 1"), fan_out, f"{label}-{len(levels)}")
        levels.append(level)
        nodes, most = _parents(level, fan_out), -(-most // fan_out)
    end = ends[0]
    for other in ends[1:]:
        end = end.union(other)
    return levels, end


def _paths(levels: list[DataFrame], above: DataFrame, fan_out: int) -> DataFrame:
    """``path`` of the lowest level's nodes: their siblings and those above, in order.

    ``above`` has ``grp`` and ``path`` of each group's last node, and is read for
    the groups of every level whose parent is that node.
    """
    own = F.array(F.struct("before", "after"))
    onward = None
    for level in reversed(levels):
        last = level.filter(F.col("n") <= fan_out).join(
            above.withColumnRenamed("grp", "_grp"), F.col("grp") == F.col("_grp")
        )
        made = last.withColumn("path", F.concat(own, "path")).drop("_grp")
        if onward is not None:
            parent = onward.select(
                F.col("grp").alias("_grp"), F.col("at").alias("_at"),
                *[c for c in onward.columns if c in above.columns and c != "grp"],
            )
            same = (F.col("grp") == F.col("_grp")) & (
                F.expr(f"at div {fan_out}") == F.col("_at")
            )
            inner = level.filter(F.col("n") > fan_out).join(parent, same)
            inner = inner.withColumn("path", F.concat(own, "path")).drop("_grp", "_at")
            made = made.unionByName(inner)
        onward = made
    return onward


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    fan_out: int = FAN_OUT,
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Each record's leaf, its group's subroot, the dataset's root and the path between.

    A leaf is the digest of ``fields``. In a group leaves ascend by id, and every
    ``fan_out`` consecutive nodes, the last run perhaps fewer or one alone, become
    one node of the next level until one is left, the subroot. The subroots in the order of
    the groups make the root likewise. At every level each node meets its siblings by
    an equijoin on computed places; the rows in slot zero emit the parents. Records are
    numbered over range-partitioned blocks, so a hot group or id is spread.

    Returns ``id_col``, the columns ``carried`` (computed from the record in the same
    scan), ``leaf``, ``subroot`` and ``root`` as hex text, and ``path``: for each level,
    from the leaf's to the root's, the siblings' digests before and after the node,
    as bytes. ``folded`` takes a leaf along it; ``proof_digest`` sums it up.

    Null fields have a digest of their own, which no text shares. A null group is a
    group, the first. Null ids come first in their group, and records with equal ids
    are in the order of their leaves; repeated rows are separate leaves. A group of one
    has its leaf as subroot, a dataset of one group its subroot as root. An
    empty table gives no rows. Other columns are not read. The jobs run when called.
    """
    if fan_out < 2:
        raise ValueError("a node needs two children or more")
    extra = dict(carried or {})
    digest = F.unhex(record_digest([F.col(f) for f in fields]))
    made = docs.select(
        F.col(id_col).alias("key"),
        F.col(group_col).alias("part"),
        digest.alias("digest"),
        *[value.alias(f"extra_{i}") for i, value in enumerate(extra.values())],
    )
    order = [F.col("key").asc_nulls_first(), F.col("digest").asc()]
    blocks = ordered_blocks(made, "part", order, "leaves")
    parts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    by_part = [F.col("part").asc_nulls_first()]
    groups = freeze(
        running_totals(
            ordered_blocks(parts, "_all", by_part, "groups"), "_all", by_part, {"grp": "1L"}
        ).select(F.col("part").alias("_part"), "grp", "n"),
        "groups",
    )
    sizes = groups.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    placed = running_totals(blocks, "part", order, {"at": "1L"})
    leaves = freeze(
        placed.join(groups, F.col("part").eqNullSafe(F.col("_part"))).select(
            "grp", "at", "n", "digest", "key", *[f"extra_{i}" for i in range(len(extra))]
        ),
        "placed-leaves",
    )
    release(blocks)

    levels, ends = _tree(leaves, sizes["most"] or 0, fan_out, "level")
    subroots = freeze(
        ends.select(
            F.lit(0).cast("bigint").alias("grp"),
            F.col("grp").alias("at"),
            F.lit(sizes["groups"]).cast("bigint").alias("n"),
            "digest",
        ),
        "subroots",
    )
    tops, end = _tree(subroots, sizes["groups"], fan_out, "top-level")
    found = end.first()
    root = F.lit(bytes(found["digest"]).hex() if found else None).cast("string")

    kind = "array<struct<before:binary,after:binary>>"
    no_path = F.array().cast(kind)
    if tops:
        start = subroots.sparkSession.range(1).select(
            F.col("id").alias("grp"), no_path.alias("path")
        )
        above = _paths(tops, start, fan_out).select(
            F.col("at").alias("grp"), "path", F.col("digest").alias("subroot")
        )
    else:
        above = subroots.select(
            F.col("at").alias("grp"), no_path.alias("path"), F.col("digest").alias("subroot")
        )
    above = freeze(above, "group-paths")
    alone = leaves.filter("n = 1").join(above, "grp")
    whole = alone
    if levels:
        whole = whole.unionByName(_paths(levels, above, fan_out).drop("before", "after"))
    return whole.select(
        F.col("key").alias(id_col),
        *[F.col(f"extra_{i}").alias(name) for i, name in enumerate(extra)],
        _hex(F.col("digest")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        "path",
    )


def lowered(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def tamper_report(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents`` and what folding gives where every fifth text was changed.

    A record whose id's CRC-32 is divisible by 5 is folded with its text in lower case;
    ``verified`` says whether the root still follows.
    """
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(changed, lowered(F.col("text"))).otherwise(F.col("text"))
    seen = record_digest([text if f == "text" else F.col(f) for f in FIELDS])
    rows = merkle_manifest(docs, carried={"seen": F.unhex(seen)})
    made = rows.select(
        "doc_id", "leaf", "subroot", "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(_hex(F.col("seen")), F.col("path")).alias("folded_root"),
    )
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
