"""Packing tokenised documents into sequences of fixed length."""

from __future__ import annotations

import re
import sys
from array import array
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import bounded_side, map_rows
from tillroll.llm.token_counts import load_tokenizer
from tillroll.session import freeze

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096
# Pieces packed together in one task. A group leaves about one sequence partly
# empty, so this many keep the waste far below one in a hundred.
GROUP_PIECES = 8_000
MEMO_ENTRIES = 500_000


# A byte-level vocabulary spells every byte as a visible character: those that are
# visible in Latin-1 as themselves, the others from 256 on, in order.
_HIDDEN = [*range(33), *range(127, 161), 173]
_BYTE_MARKS = {byte: 256 + n for n, byte in enumerate(_HIDDEN)}


def _as_byte_marks(part: str) -> str:
    return part.encode().decode("latin-1").translate(_BYTE_MARKS)


class _PartIds(dict):
    """Parts of words to their ids as little-endian bytes. A full memo starts again."""

    def __init__(self, merge):
        super().__init__()
        self._merge = merge

    def __missing__(self, part: str) -> bytes:
        packed = little_endian([token.id for token in self._merge(part)])
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(part) <= 64:
            self[part] = packed
        return packed


class WordIds(dict):
    """Words between blanks to ids as little-endian bytes, made when first met.

    The tokenizer drops white space, and nothing it does reaches across it, so
    the ids of the words, one after the other, are those of the whole text. Words of
    Latin letters and ASCII marks are put in lower case and cut as the tokenizer
    would; others go through its own steps; then the parts met before are
    known and the others merged. A word that may hold a special string is left to
    the tokenizer. A full memo starts again.
    """

    _PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    _PLAIN_TEXT = re.compile(r"[!-~À-ÖØ-öø-ÿ\x20\t-\r]*")
    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\x20\t-\r]+")
    # Blanks to Python but not to the tokenizer.
    _CONTROL = re.compile(r"[\x1c-\x1f]")
    _BLANK = re.compile(r"[ \t\n]+")

    def __init__(self, path: str | None):
        super().__init__()
        self._tokenizer = load_tokenizer(path, TOKENIZER)
        self._normal = self._tokenizer.normalizer.normalize_str
        self._cut = self._tokenizer.pre_tokenizer.pre_tokenize_str
        self._merge = self._tokenizer.model.tokenize
        self._read = _PartIds(lambda part: self._merge(part if part.isascii() else _as_byte_marks(part)))
        self._marked = _PartIds(self._merge)

    def _packed(self, word: str) -> bytes:
        if "<|" in word:
            return little_endian(self._tokenizer.encode(word, add_special_tokens=False).ids)
        if self._PLAIN.fullmatch(word):
            return b"".join(map(self._read.__getitem__, self._PARTS.findall(word.lower())))
        parts = [part for part, _ in self._cut(self._normal(word))]
        return b"".join(map(self._marked.__getitem__, parts))

    def __missing__(self, word: str) -> bytes:
        packed = self._packed(word)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if "<|" not in text and self._PLAIN_TEXT.fullmatch(text):
            # All words are plain and no part has a blank, so they need not be cut first.
            return b"".join(map(self._read.__getitem__, self._PARTS.findall(text.lower())))
        plain = self._CONTROL.search(text) is None
        words = text.split() if plain else self._BLANK.split(text)
        return b"".join(map(self.__getitem__, words))


def little_endian(ids) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def token_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise whole texts and cut those beyond ``capacity`` into pieces.

    A document is its ids and then ``end_id``. Returns ``id_col``, ``piece`` (from
    0), ``start``, ``length`` and ``ids`` (little-endian unsigned 32-bit integers).
    A null or empty text is one piece of one id. Rows are kept one by one, repeats
    included. An empty table gives no rows.
    """

    def start():
        encode = WordIds(tokenizer_path).encode
        end = little_endian([end_id])

        def row(key, text):
            ids = encode(text or "") + end
            step = 4 * capacity
            return [
                (key, n, at // 4, (min(at + step, len(ids)) - at) // 4, ids[at : at + step])
                for n, at in enumerate(range(0, len(ids), step))
            ]

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids binary"
    return map_rows(docs, [id_col, text_col], start, schema)


def plan_bins(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each length; the bins are as few as this method finds.

    Items above a third of the capacity fit at most two to a bin. Taken from the
    longest, each is matched with the longest other such item that still fits
    beside it. The rest, longest first, go where they leave the smallest gap.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    large = [i for i in order if 3 * lengths[i] > capacity]
    small = order[len(large) :]
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    used: list[int] = []

    # Partners by length; an item that is matched leaves the list.
    waiting = sorted((lengths[i], -k) for k, i in enumerate(large))
    for k, i in enumerate(large):
        at = bisect_left(waiting, (lengths[i], -k))
        if at == len(waiting) or waiting[at] != (lengths[i], -k):
            continue
        waiting.pop(at)
        placed[i] = (len(used), 0)
        used.append(lengths[i])
        fits = bisect_left(waiting, (capacity - lengths[i] + 1, -len(large))) - 1
        if fits >= 0:
            length, partner = waiting.pop(fits)
            placed[large[-partner]] = (len(used) - 1, used[-1])
            used[-1] += length

    gaps = sorted((capacity - n, b) for b, n in enumerate(used) if n < capacity)
    for i in small:
        at = bisect_left(gaps, (lengths[i], -1))
        gap, b = gaps.pop(at) if at < len(gaps) else (capacity, len(used))
        if b == len(used):
            used.append(0)
        placed[i] = (b, used[b])
        used[b] += lengths[i]
        if gap > lengths[i]:
            insort(gaps, (gap - lengths[i], b))
    return placed


def pack_pieces(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
    id_col: str = "doc_id",
) -> DataFrame:
    """Give each piece a ``sequence_id`` and its ``offset`` there.

    ``pieces`` has ``id_col``, ``piece``, ``length`` and any columns to keep. They
    are written once to the shared folder, since their number decides into how many
    groups of about ``group_pieces`` they are dealt. Dealing is by the
    place of the row, so a key that repeats is spread as well. Each group is packed
    in one task whose memory the group size bounds. Sequences that are at most half full,
    one or two of a group, are then packed with each other in the same way, round by round
    until one group holds them; so groups of short pieces waste no more than long ones.
    """
    kept = freeze(pieces.withColumn("_place", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-kept.count() // group_pieces))
    dealt = kept.withColumn("_group", F.pmod(F.xxhash64(id_col, "piece", "_place"), F.lit(groups)))

    def pack(group: pa.Table) -> pa.Table:
        order = [(id_col, "ascending"), ("piece", "ascending"), ("_place", "ascending")]
        group = group.sort_by(order)
        placed = plan_bins(group["length"].to_pylist(), capacity)
        first = group["_group"][0].as_py() << 32
        return (
            group.drop_columns(["_group", "_place"])
            .append_column("sequence_id", pa.array([first + b for b, _ in placed], pa.int64()))
            .append_column("offset", pa.array([at for _, at in placed], pa.int64()))
        )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    schema = ", ".join([*columns, "sequence_id bigint", "offset bigint"])
    packed = dealt.groupBy("_group").applyInArrow(pack, schema)
    return packed if groups == 1 else _merged(freeze(packed, "packed"), capacity, group_pieces)


def _merged(packed: DataFrame, capacity: int, group_pieces: int) -> DataFrame:
    """Put sequences that are at most half full together, each as it is."""
    half = (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("length"))
        .filter(2 * F.col("length") <= capacity)
        .select(F.col("sequence_id").alias("_old"), F.lit(0).alias("piece"), "length")
    )
    again = freeze(pack_pieces(half, capacity, group_pieces, "_old"), "merged")
    # A merged sequence has the least number of those in it, which no other has.
    least = again.groupBy("sequence_id").agg(F.min("_old").alias("_new"))
    moved = freeze(
        again.join(least, "sequence_id").select("_old", "_new", F.col("offset").alias("_shift")),
        "moved",
    )
    found = packed.join(
        bounded_side(moved, "_old"), F.col("sequence_id") == F.col("_old"), "left"
    )
    columns = [c for c in packed.columns if c not in ("sequence_id", "offset")]
    return found.select(
        *columns,
        F.coalesce("_new", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset"),
    )


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with their checksums, packed into sequences.

    Only the checksum of the ids travels to the packing tasks. One row per piece.
    """
    pieces = token_pieces(docs, **options)
    light = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack_pieces(light)
