"""Token counts and packing against the tokenizer library itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from edge_rows import TEXTS, documents, no_documents, small  # noqa: F401
from tokenizers import Tokenizer

from tillroll.llm.packing import WordIds, pack_documents, pack_pieces, plan_bins, token_pieces
from tillroll.llm.queries import QUERIES
from tillroll.llm.token_counts import PretokenCounter, token_counts, whole_tokens

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BITS = [
    "'s", "It's", "WE'LL", "<|endoftext|>", "<|startoftext|>", "é", "é", "ΣΑΣ", "\x1c", "\x1f",
    " ", " ", "\x85", "İ", "ß", "ﬁ", "12", "3.5", "!!", "你好", "😀", "a_b", "don't", "\t", "\n",
    "\r", "\x0b", " ", "  ", "<|", "|>", "'", "\x00", "\x7f", "՘", "hello", " world", "​",
]


def random_texts(n=3000, seed=4):
    draw = random.Random(seed)
    return ["".join(draw.choices(BITS, k=draw.randint(0, 14))) for _ in range(n)]


def test_whole_tokens_are_proved():
    whole = whole_tokens(BYTES)
    assert "<|endoftext|>" not in whole and len(whole) > 40_000
    for text in random.Random(1).sample(sorted(whole), 500):
        assert [t.value for t in BYTES.model.tokenize(text)] == [text]
    # Some vocabulary strings are never reached by merging; they are not in the set.
    assert all(
        len(BYTES.model.tokenize(t)) > 1
        for t in set(BYTES.get_vocab(with_added_tokens=False)) - whole
    )


@pytest.mark.parametrize("entries", [3, 100_000])
def test_counts_equal_the_library_on_odd_texts(entries):
    counter = PretokenCounter(BYTES, whole_tokens(BYTES), entries)
    for text in random_texts():
        assert counter.count(text) == len(BYTES.encode(text, add_special_tokens=False).ids), text


def test_word_ids_equal_the_library_on_odd_texts():
    encode = WordIds(None).encode
    for text in random_texts():
        expected = WORDS.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == expected, text


def test_counts_of_edge_rows(spark):
    found = token_counts(documents(spark)).collect()
    expected = [
        (i, len((t or "").encode()), len(BYTES.encode(t or "", add_special_tokens=False).ids))
        for i, t, _ in TEXTS
    ]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == Counter(expected)
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)
    assert token_counts(no_documents(spark)).collect() == []


def test_count_query_over_the_tables(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {r.doc_id: r.n_tokens for r in QUERIES["op7_token_counts"](spark, small).collect()}
    assert found == {
        i: len(BYTES.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()
    }


def fewest_bins(lengths, capacity):
    """Exhaustive search."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def check_bins(lengths, capacity):
    placed = plan_bins(lengths, capacity)
    bins: dict[int, list] = {}
    for (b, at), n in zip(placed, lengths):
        bins.setdefault(b, []).append((at, n))
    for own in bins.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in own) <= 2
    return len(bins)


def test_bins_are_valid_and_few():
    draw = random.Random(2)
    extra = 0
    for _ in range(150):
        lengths = [draw.randint(1, 12) for _ in range(draw.randint(1, 8))]
        extra += check_bins(lengths, 12) - fewest_bins(lengths, 12)
    assert extra <= 5
    for lengths in ([], [12], [5] * 9, [4] * 9, [7, 5, 7, 5], [1] * 30):
        assert check_bins(lengths, 12) == -(-sum(lengths) // 12) or lengths[0] == 5
    lengths = [draw.randint(1, 4096) for _ in range(4000)]
    assert check_bins(lengths, 4096) <= 1.02 * max(sum(lengths) / 4096, sum(n > 2048 for n in lengths))


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packed_edge_rows(spark, capacity):
    docs = documents(spark)
    pieces = token_pieces(docs, capacity=capacity).collect()
    expected = Counter()
    for i, t, _ in TEXTS:
        ids = [*WORDS.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[(i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in pieces) == expected


def test_packing_is_whole(spark):
    rows = pack_documents(documents(spark)).collect()
    found = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    pieces = token_pieces(documents(spark)).collect()
    assert found == Counter((r.doc_id, r.piece, r.length, zlib.crc32(r.ids)) for r in pieces)
    used: dict[int, list] = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack_documents(no_documents(spark)).collect() == []


def test_packing_query_over_the_tables(spark, small):
    rows = QUERIES["op8_best_fit_packing"](spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    total = sum(len(WORDS.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())
    assert sum(r.length for r in rows) == total
    assert len({r.sequence_id for r in rows}) <= 1.05 * total / 4096 + 1


@pytest.mark.parametrize("most", [7, 60, 4096])
def test_groups_waste_next_to_nothing(spark, most):
    draw = random.Random(most)
    n = 6_000 if most < 1000 else 700
    lengths = [draw.randint(2, most) for _ in range(n)]
    pieces = spark.createDataFrame([(i % 50, 0, length) for i, length in enumerate(lengths)],
                                   "doc_id bigint, piece int, length bigint")
    rows = pack_pieces(pieces, group_pieces=n // 40).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == Counter(
        (i % 50, length) for i, length in enumerate(lengths))
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        assert [at for at, _ in sorted(own)] == [sum(x for _, x in sorted(own)[:k]) for k in range(len(own))]
        assert sum(x for _, x in own) <= 4096 and sum(3 * x > 4096 for _, x in own) <= 2
    if most < 1000:
        assert len(used) <= 1.01 * (-(-sum(lengths) // 4096)) + 1
    half = [own for own in used.values() if 2 * sum(x for _, x in own) <= 4096]
    assert len(half) <= 1
