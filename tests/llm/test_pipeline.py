"""Each stage of the pipeline against a plain version on what the one before kept."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from edge_rows import documents, no_documents, small  # noqa: F401
from test_search import true_components, true_spans
from tokenizers import Tokenizer

import corpus_pipeline
from tillroll.llm import quality
from tillroll.session import freeze

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):  # noqa: F811
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = freeze(stage(spark, docs, small), name)
    return {name: df.collect() for name, df in out.items()}, out


def masked(text):
    """Base spans in angle brackets; of overlapping ones the first names the whole."""
    spans = []
    for span in true_spans(text or ""):
        kind, start, end = span.split(":")
        spans.append((int(start), int(end), kind))
    made, at = "", 0
    for start, end, kind in sorted(spans):
        if start >= at:
            made += text[at:start] + f"<{kind.upper()}>"
        at = max(at, end)
    return made + text[at:]


def test_stages(spark, stages, small):  # noqa: F811
    rows, frames = stages
    for name, df in frames.items():
        if name != "best_fit_packing":
            assert df.columns == COLUMNS
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit_quality(frames["documents"], quality.graded(labels))
    kept = {r.doc_id for r in quality.score_quality(frames["documents"], model).collect() if r.kept}
    first = rows["quality_classifier"]
    assert {r.doc_id for r in first} == kept and len(first) == len(kept)

    components = true_components([(r.doc_id, r.text, r.source) for r in first])
    second = rows["ngram_jaccard_join"]
    assert sorted(r.doc_id for r in second) == sorted({c for _, _, c in components})

    third = {r.doc_id: r for r in rows["personal_data"]}
    assert set(third) == {r.doc_id for r in second}
    for r in second:
        # No value is met in two different texts here, so no term is told.
        assert third[r.doc_id].text == masked(r.text)
        assert third[r.doc_id].n_chars == len(third[r.doc_id].text)

    def sizes(docs):
        found = defaultdict(int)
        for r in docs:
            found[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        return found

    before, after = sizes(third.values()), sizes(rows["mixing"])
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) <= len(before)
    assert all(after[s] <= 2 * before[s] for s in before)
    assert all(third[r.doc_id].text.startswith(r.text) for r in rows["mixing"])

    packed = rows["best_fit_packing"]
    tokens = [len(WORDS.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows["mixing"]]
    assert sum(r.length for r in packed) == sum(tokens)
    assert len({r.sequence_id for r in packed}) <= 1.05 * sum(tokens) / 4096 + 1
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_edge_rows_go_through_every_stage(spark, small):  # noqa: F811
    for docs in (documents(spark, clashes=()), no_documents(spark).select(*COLUMNS)):
        for _, stage in corpus_pipeline.STAGES:
            docs = freeze(stage(spark, docs, small), "edge")
        docs.collect()
