"""Rows that every operator on documents has to take."""

from __future__ import annotations

from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")

LONG = " ".join(f"word{i % 977}" for i in range(40_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "b"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, " \t\n", "b"),
    (None, "no key but a text of its own that goes on for a while", None),
    (None, None, None),
    (6, LONG, "c"),
    (7, "x", "c"),
    (8, "x", "c"),
    (9, "naïve Ærø 😀   straße <|endoftext|> it's  two\n\nlines ", "d"),
    (10, "a@b.co 1.2.3.4 4111 1111 1111 1111 +1 (234) 555-7890", "d"),
    (-5, "e" * 300_000, "a"),
]
# Names the operators use for columns of their own.
CLASHES = (
    "size", "score", "kept", "shard", "slot", "position", "text_hash", "n_tokens", "spans", "base",
    "cid", "h", "_id", "_hash", "_block", "_place", "_key", "_range", "_tail", "_spans", "aside_0",
    "taken", "piece", "length", "n", "component_id", "features", "_target", "id",
)


def documents(spark, rows=TEXTS, clashes=CLASHES):
    made = [(i, t, "en", s, None if t is None else len(t)) + ("x",) * len(clashes) for i, t, s in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    schema += "".join(f", `{name}` string" for name in clashes)
    return spark.createDataFrame(made, schema)


def no_documents(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def small():
    """The folder of the smallest test tables."""
    if not FOLDER.exists():
        pytest.skip("no test tables here")
    return str(FOLDER)
