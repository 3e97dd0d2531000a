"""Circulant MinHash near duplicates against brute force, and the laws behind them."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from edge_rows import LONG, TEXTS, documents, no_documents, small  # noqa: F401

from tillroll.llm import circulant, links, shingles
from tillroll.llm.queries import QUERIES


def shingle_set(text, k=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def expected(rows):
    """(id, set size, smallest id that links reach, kept) of each row, from all pairs."""
    sets = [shingle_set(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])) > 0:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    least = {}
    for a, (i, *_) in enumerate(rows):
        least[root(a)] = min((x for x in (least.get(root(a)), i) if x is not None), default=None)
    return Counter(
        (i, len(sets[a]), least[root(a)], i == least[root(a)]) for a, (i, *_) in enumerate(rows)
    )


def family(n, edits, seed=7, length=60):
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(length)] = f"x{draw.randrange(n)}"
        rows.append((3 * i + 1, " ".join(words), "a"))
    draw.shuffle(rows)
    return rows


def short_texts():
    """Sets of a few elements, at and around the threshold."""
    words = "a b c d e f g h i j k l".split()
    rows = [(i, " ".join(words[:n]), "c") for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])]
    rows += [(50 + i, " ".join(words[i:]).upper(), "c") for i in range(12)]
    return rows + [(80, "a  b\tc", "c"), (81, "A B C", "d"), (82, "a\xa0b c", "d")]


CASES = {
    "edge rows": TEXTS,
    "alike": family(90, 2),
    "chained": family(120, 5),
    "at the threshold": family(60, 8, seed=3),
    "short": short_texts(),
    "two families": family(40, 3, 1) + [(i + 500, t.replace("w", "v"), s) for i, t, s in family(40, 3, 2)],
    "repeats": [(7, "one text of some words", "a")] * 30 + [(None, "one text of some words", "a")] * 30,
    "no ids": [(None, t, s) for _, t, s in family(12, 2)],
    "no links": [(i, f"p{i} q{i} r{i} s{i}", "a") for i in range(30)],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    found = circulant.circulant_duplicates(documents(spark, CASES[case])).collect()
    assert Counter(map(tuple, found)) == expected(CASES[case])


def test_small_blocks_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 8)
    monkeypatch.setattr(links, "BROADCAST_KEYS", 0)
    rows = CASES["at the threshold"]
    found = circulant.circulant_duplicates(documents(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, found)) == expected(rows)


def test_whole_table(spark, small):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = QUERIES["op12_circulant_minhash"](spark, small).collect()
    assert Counter(map(tuple, found)) == expected(rows)


def test_nothing(spark):
    assert circulant.circulant_duplicates(no_documents(spark)).collect() == []


def test_work_grows_with_the_family(spark, monkeypatch):
    asked = []
    whole = links.Verifier.__call__

    def counted(self, pairs, label):
        asked.append(pairs.count())
        return whole(self, pairs, label)

    monkeypatch.setattr(links.Verifier, "__call__", counted)
    for edits in (3, 8):
        for n in (100, 400):
            asked.clear()
            docs = documents(spark, family(n, edits))
            circulant.near_duplicate_classes(docs, "doc_id", "text")
            assert sum(asked) <= 1.5 * n


def test_coordinates_agree_as_often_as_sets_overlap():
    draw = np.random.default_rng(1)
    for size in (10, 200):
        apart, steps = [], []
        for _ in range(150):
            pool = draw.integers(-(2**62), 2**62, 2 * size)
            kept = int(size * draw.uniform(0.1, 1.0))
            a, b = pool[:size], np.concatenate([pool[:kept], pool[size : 2 * size - kept]])
            same = (circulant.signature(a) == circulant.signature(b)).mean()
            apart.append(same - kept / (2 * size - kept))
            steps.append(abs(apart[-1]))
        assert abs(np.mean(apart)) < 0.01 and max(steps) < 0.16


def test_linked_sets_share_a_band():
    draw = np.random.default_rng(2)
    for _ in range(300):
        size = int(draw.integers(5, 300))
        pool = draw.integers(-(2**62), 2**62, 2 * size)
        kept = -(-8 * 2 * size // 18)
        a, b = pool[:size], np.concatenate([pool[:kept], pool[size : 2 * size - kept]])
        one, other = circulant.signature(a), circulant.signature(b)
        assert (circulant.band_keys(one) == circulant.band_keys(other)).any()
        assert links.can_be_linked(size, links.sketch(a), size, links.sketch(b))


def test_both_maps_are_bijections():
    x = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4099)
    y = x.copy()
    circulant.second_permutation(y, np.empty_like(y))
    assert len(np.unique(circulant.first_permutation(x))) == len(np.unique(y)) == len(np.unique(x))


@pytest.mark.parametrize("k", [1, 2, 5])
def test_shingle_hashes_follow_the_words(k):
    hashes = shingles.WordShingles(k)
    texts = [t or "" for _, t, _ in TEXTS] + [
        LONG.upper(), " " + LONG[:1000] + "\x0b", "a b", "ab", "a  b", "b a", " x",
        "x" * (shingles.PIECE - 1), "x" * shingles.PIECE, "y " + "x" * shingles.PIECE + " z",
        "Y\n" + "X" * shingles.PIECE + "\tZ", "q " * shingles.PIECE,
    ]
    for a in texts:
        assert len(hashes(a)) == len(shingle_set(a, k))
        for b in texts:
            both = len(np.intersect1d(hashes(a), hashes(b)))
            assert both == len(shingle_set(a, k) & shingle_set(b, k))
