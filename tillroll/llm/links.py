"""Components of linked texts, from candidate pairs that are verified on whole sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.session import freeze, release

#: Similarity as a fraction: 80 parts in 100.
PARTS, WHOLE = 80, 100
#: Classes of a list are compared in blocks of so many.
BLOCK = 1024
#: Whole texts of at most so many documents are fetched by a broadcast of their keys.
BROADCAST_KEYS = 200_000


def linked(common: int, total: int) -> bool:
    """Sets with ``common`` equal elements, their sizes adding up to ``total``, are alike."""
    return WHOLE * common >= PARTS * (total - common)


def least_common(total):
    """Fewest common elements of two linked sets whose sizes add up to ``total``."""
    return -(-PARTS * total // (WHOLE + PARTS))


def sketch(own: np.ndarray) -> bytes:
    """Parity of the elements in each of some buckets, at least four buckets per element.

    Two sets differ in at least as many elements as their sketches differ in bits, so
    a pair too far apart here cannot be linked, and no linked pair ever is. Halves of
    a sketch, added, are the sketch with half as many buckets.
    """
    buckets = max(1024, 4 << (max(1, len(own)) - 1).bit_length())
    odd = np.bincount(own & (buckets - 1), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch with ``size`` bytes."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


class Sketches:
    """Sketches of sets in ascending order of size, compared one with many."""

    def __init__(self, n: np.ndarray, raw: list[bytes]):
        self._n, self._raw = n, [np.frombuffer(s, np.uint8) for s in raw]
        self._levels: dict[int, tuple[np.ndarray, int]] = {}

    def _level(self, size: int) -> tuple[np.ndarray, int]:
        """Sketches cut down to this many bytes, of the sets that have as many or more."""
        if size not in self._levels:
            first = next(i for i, s in enumerate(self._raw) if len(s) >= size)
            cut = np.array([folded(s, size) for s in self._raw[first:]])
            self._levels[size] = cut, first
        return self._levels[size]

    def larger(self, i: int) -> np.ndarray:
        """The later sets whose size allows a link with set ``i``."""
        return np.arange(i + 1, np.searchsorted(self._n, self._n[i] * WHOLE // PARTS, side="right"))

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the larger ``others`` that can be linked with set ``i``."""
        table, first = self._level(len(self._raw[i]))
        differ = np.bitwise_count(table[others - first] ^ table[i - first]).sum(axis=1)
        total = self._n[i] + self._n[others]
        return others[differ <= total - 2 * least_common(total)]


def can_be_linked(n_one: int, one: bytes, n_other: int, other: bytes) -> bool:
    """Whether sizes and sketches of two sets allow a link."""
    total = n_one + n_other
    room = total - 2 * least_common(total)
    if min(n_one, n_other) < least_common(total):
        return False
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()) <= room


def passing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of classes (``key``, ``n``, ``sketch``) that can be linked."""
    one = classes.select(F.col("key").alias("a"), F.col("sketch").alias("_sa"), F.col("n").alias("_na"))
    other = classes.select(F.col("key").alias("b"), F.col("sketch").alias("_sb"), F.col("n").alias("_nb"))
    met = pairs.select("a", "b").join(other, "b").join(one, "a").filter(
        WHOLE * F.least("_na", "_nb") >= PARTS * F.greatest("_na", "_nb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
            keep = [i for i, pair in enumerate(values) if can_be_linked(*pair)]
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    kind = pairs.schema["a"].dataType.simpleString()
    picked = met.select("a", "b", "_na", "_sa", "_nb", "_sb")
    return picked.mapInArrow(run, f"a {kind}, b {kind}")


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node its links (``a``, ``b``) reach.

    Each round a node takes the smallest label around it and then the label of
    that label, until nothing changes. Labels are written each round, and those of the round
    before are released.
    """
    edges = freeze(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(links.select("b", "a"))
        .distinct(),
        "links",
    )
    labels = freeze(
        edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "labels"
    )
    while True:
        near = edges.join(
            labels.select(F.col("node").alias("other"), F.col("comp").alias("near")), "other"
        )
        around = near.groupBy("node").agg(F.min("near").alias("near"))
        lower = freeze(
            labels.join(around, "node").select(
                "node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")
            ),
            "labels",
        )
        onward = lower.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
        jumped = freeze(
            lower.join(onward, "comp").select(
                "node", "was", F.least("comp", "beyond").alias("comp")
            ),
            "labels",
        )
        release(labels)
        release(lower)
        labels = jumped.select("node", "comp")
        if jumped.filter(F.col("was") != F.col("comp")).isEmpty():
            release(edges)
            return labels


def label_of(df: DataFrame, node: str, comps: DataFrame | None, name: str) -> DataFrame:
    """Add the component of a node; one in no link is its own."""
    if comps is None:
        return df.withColumn(name, F.col(node))
    known = comps.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return (
        df.join(known, F.col(node) == F.col("_node"), "left")
        .withColumn(name, F.coalesce("_comp", node))
        .drop("_node", "_comp")
    )


def united(comps: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components after more links, which are released; None while there are none.

    Only the components that the links join are walked.
    """
    if links.isEmpty():
        release(links)
        return comps
    if comps is None:
        first = connected(links)
        release(links)
        return first
    ends = label_of(label_of(links, "a", comps, "ca"), "b", comps, "cb")
    crossing = ends.filter(F.col("ca") != F.col("cb")).select(
        F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")
    )
    over = connected(crossing.distinct()).toDF("_old", "_new")
    moved = comps.join(over, F.col("comp") == F.col("_old"), "left").select(
        "node", F.coalesce("_new", "comp").alias("comp")
    )
    alone = over.join(comps, F.col("_old") == F.col("node"), "left_anti")
    result = freeze(moved.union(alone.select("_old", "_new")), "components")
    for done in (over, comps, links):
        release(done)
    return result


def apart(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The pairs whose ends are in different components, with these as ``ca`` and ``cb``."""
    ends = label_of(label_of(pairs, "a", comps, "ca"), "b", comps, "cb")
    return ends.filter(F.col("ca") != F.col("cb"))


class Verifier:
    """Verifies pairs of classes of equal texts on the whole shingle sets of their texts.

    ``classes`` has ``key`` and a document that stands for the class: ``rep``, its id, and
    ``text_hash``. Only texts that some pair asks for are moved, as text, which packs better
    than hashes do, and each is shingled where the pair is.
    """

    def __init__(
        self,
        docs: DataFrame,
        classes: DataFrame,
        shingler: Callable[[], Callable[[str], np.ndarray]],
        id_col: str,
        text_col: str,
    ):
        self._classes, self._start = classes, shingler
        self._docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))

    def texts(self, pairs: DataFrame) -> DataFrame:
        asked = freeze(
            pairs.select(F.col("a").alias("key"))
            .union(pairs.select("b"))
            .distinct()
            .join(self._classes.select("key", "rep", "text_hash"), "key"),
            "asked",
        )
        few = asked.count() <= BROADCAST_KEYS
        same = F.col("_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("text_hash"))
        found = self._docs.join(F.broadcast(asked) if few else asked, same)
        # A document that is repeated row by row would stand for its class twice.
        texts = freeze(found.select("key", "text"), "asked-texts")
        twice = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not twice.isEmpty():
            whole = texts
            texts = freeze(whole.dropDuplicates(["key"]), "asked-texts")
            release(whole)
        release(asked)
        return texts

    def __call__(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs ``a``, ``b`` that are linked, written once."""
        pairs = freeze(pairs.select("a", "b"), f"{label}-asked")
        if pairs.isEmpty():
            return pairs
        texts = self.texts(pairs)
        start = self._start

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles = start()
            last_text, last_set = None, None
            for batch in batches:
                keep = []
                for i, (one, other) in enumerate(zip(batch.column(2), batch.column(3))):
                    one, other = one.as_py(), other.as_py()
                    if one != last_text:
                        last_text, last_set = one, shingles(one or "")
                    own = shingles(other or "")
                    common = len(np.intersect1d(last_set, own, assume_unique=True))
                    if linked(common, len(last_set) + len(own)):
                        keep.append(i)
                if keep:
                    kept = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
                    yield kept

        first = texts.select(F.col("key").alias("a"), F.col("text").alias("_one"))
        second = texts.select(F.col("key").alias("b"), F.col("text").alias("_other"))
        # The second ends differ, the first are often shared; so those come last and
        # pairs with the same first end follow each other.
        met = pairs.join(second, "b").join(first, "a").select("a", "b", "_one", "_other")
        kind = pairs.schema["a"].dataType.simpleString()
        found = freeze(met.mapInArrow(check, f"a {kind}, b {kind}"), label)
        release(texts)
        release(pairs)
        return found


def _block_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs across components of one list, or of two of its blocks, that can be linked."""
    rows = rows.sort_values("n", kind="stable")
    comp, block = pd.factorize(rows["comp"])[0], rows["block"].to_numpy(np.int64)
    crossing = block.min() != block.max()
    sketches = Sketches(rows["n"].to_numpy(np.int64), rows["sketch"].tolist())
    keys = rows["key"].tolist()
    left, right = [], []
    for i in range(len(rows) - 1):
        j = sketches.larger(i)
        j = j[comp[j] != comp[i]]
        if crossing:
            j = j[block[j] != block[i]]
        if len(j):
            for x in sketches.near(i, j):
                a, b = sorted((keys[i], keys[x]))
                left.append(a)
                right.append(b)
    return pd.DataFrame({"a": left, "b": right}, dtype=object)


def _with_leads(lists: DataFrame, rank: DataFrame) -> DataFrame:
    """``h``, ``key``, and the leader of the list with its rank: the class of least rank."""
    ranked = freeze(lists.select("h", "key").join(rank, "key"), "ranked")
    leads = ranked.groupBy("h").agg(F.min(F.struct("rank", "key")).alias("lead"))
    led = freeze(
        ranked.join(leads, "h").select(
            "h", "key", F.col("lead.key").alias("lead"), F.col("lead.rank").alias("lead_rank")
        ),
        "led-lists",
    )
    release(ranked)
    return led


def _oriented(pairs: DataFrame, rank: DataFrame) -> DataFrame:
    """Pairs as ``lead`` and ``key``, the class of lesser rank first."""
    one = rank.select(F.col("key").alias("a"), F.col("rank").alias("_ra"))
    other = rank.select(F.col("key").alias("b"), F.col("rank").alias("_rb"))
    ends = [F.struct(F.col(r).alias("rank"), F.col(k).alias("key")) for r, k in (("_ra", "a"), ("_rb", "b"))]
    met = pairs.join(one, "a").join(other, "b")
    low, high = F.least(*ends), F.greatest(*ends)
    return met.select(
        high["key"].alias("key"), low["key"].alias("lead"), low["rank"].alias("lead_rank")
    )


def _open_pairs(led: DataFrame, classes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Pairs across components in the lists that still hold several, leaders left out."""
    rest = freeze(label_of(led.filter(F.col("key") != F.col("lead")), "key", comps, "comp"), "open")
    lists = (
        rest.groupBy("h")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m"))
        .filter(F.col("c0") < F.col("c1"))
        .select("h", F.ceil(F.col("m") / F.lit(BLOCK)).cast("bigint").alias("blocks"))
    )
    meet = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda x: F.struct(F.least("block", x).alias("low"), F.greatest("block", x).alias("high")),
    )
    dealt = (
        rest.join(lists, "h")
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        .join(classes.select("key", "n", "sketch"), "key")
        .withColumn("meet", F.explode(meet))
        .select("h", "meet.low", "meet.high", "block", "key", "n", "sketch", "comp")
    )
    kind = led.schema["key"].dataType.simpleString()
    pairs = dealt.groupBy("h", "low", "high").applyInPandas(_block_pairs, f"a {kind}, b {kind}")
    found = freeze(pairs.distinct(), "open-pairs")
    release(rest)
    return found


def _walked(
    pairs: DataFrame, comps: DataFrame | None, classes: DataFrame, verify: Verifier, label: str
) -> DataFrame | None:
    """Components after all links among ``pairs``.

    Of the pairs that can be linked, one of each two components is verified first; what
    that unites is asked no more.
    """
    near = freeze(passing(apart(pairs, comps), classes), f"{label}-near")
    one_each = freeze(
        apart(near, comps)
        .groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
        .agg(F.min(F.struct("a", "b")).alias("pair"))
        .select("pair.a", "pair.b"),
        f"{label}-each",
    )
    comps = united(comps, verify(one_each, f"{label}-first"))
    rest = apart(near, comps).select("a", "b").join(one_each, ["a", "b"], "left_anti")
    comps = united(comps, verify(rest, f"{label}-rest"))
    for done in (near, one_each):
        release(done)
    return comps


def linked_components(
    lists: DataFrame, pairs: DataFrame | None, classes: DataFrame, verify: Verifier
) -> DataFrame | None:
    """Components of all links among classes that share a list or make a pair; None without.

    ``lists`` has ``h`` and ``key``, no row twice, ``pairs`` has ``a`` and ``b``, and ``classes``
    ``key``, ``n``, ``sketch``, ``rep`` and ``text_hash`` of all keys in them. The class that
    shares most with others leads a list: the middle of a family. A class is first verified
    with the foremost of its leaders, then with the others, then all that is left across
    components is compared in blocks of the lists. Sketches never reject a link, so no
    link between components is lost; links inside a component are not looked for.
    """
    shared = lists.join(lists.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "h").select("key", "m")
    if pairs is not None:
        for end in ("a", "b"):
            shared = shared.union(pairs.select(F.col(end), F.lit(1).cast("bigint")))
    rank = freeze(shared.groupBy("key").agg((-F.sum("m")).alias("rank")), "ranks")
    led = _with_leads(lists, rank)
    stars = led.filter(F.col("key") != F.col("lead")).select("key", "lead", "lead_rank")
    if pairs is not None:
        stars = stars.union(_oriented(pairs, rank))
    stars = freeze(stars.distinct(), "stars")
    foremost = freeze(
        stars.groupBy(F.col("key").alias("b"))
        .agg(F.min(F.struct("lead_rank", "lead")).alias("best"))
        .select(F.col("best.lead").alias("a"), "b"),
        "foremost",
    )
    comps = united(None, verify(passing(foremost, classes), "foremost-links"))
    others = stars.select(F.col("lead").alias("a"), F.col("key").alias("b"))
    others = others.join(foremost, ["a", "b"], "left_anti")
    comps = _walked(others, comps, classes, verify, "stars")
    tried = stars.select(
        F.least("lead", "key").alias("a"), F.greatest("lead", "key").alias("b")
    )
    open_ = _open_pairs(led, classes, comps)
    comps = _walked(open_.join(tried, ["a", "b"], "left_anti"), comps, classes, verify, "open")
    for done in (rank, led, stars, foremost, open_):
        release(done)
    return comps
