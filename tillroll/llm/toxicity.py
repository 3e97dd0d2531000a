"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import bounded_sample, map_rows
from tillroll.llm.features import MEMO_ENTRIES, BucketMemo, held_out, plain_terms, sigmoid, training_rows

BUCKETS = 1 << 18
FACTORS = 4
PREFIXES = (4, 5, 6, 7)
#: The most labelled rows the model is fitted on.
TRAINING_ROWS = 20_000
#: Mini-batches that a fit on few rows goes on for at least.
LEAST_STEPS = 200
#: Standard errors from which a term counts in full, and the least that any counts.
FULL_Z, FLOOR = 6.0, 0.05


@dataclass(frozen=True)
class FactorizationMachine:
    """Weights of ``buckets``, the sorted ones met in training; the rest count nothing."""

    buckets: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, present: np.ndarray) -> float:
        """Score before squashing, for the sorted distinct buckets of a text.

        The pairwise part is computed in the linear form: half of the squared
        sum of factors less the sum of their squares.
        """
        if not len(self.buckets):
            return self.bias
        rows = np.searchsorted(self.buckets, present).clip(max=len(self.buckets) - 1)
        rows = rows[self.buckets[rows] == present]
        if not len(rows):
            return self.bias
        v = self.factors[rows]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return self.bias + float(self.linear[rows].sum()) + pairs


class TermEncoder:
    """Text to the sorted distinct buckets of its terms.

    The terms of a word are itself and its beginnings of four to seven characters,
    which stand for its stem. A term met at least twice, and one met at least three
    times, also count as terms of their own, so one passing use differs from many.
    """

    def __init__(self):
        self._bucket = BucketMemo(BUCKETS)
        self._words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        stems = {word[:n] for n in PREFIXES if len(word) >= n}
        terms = [word.encode(), *(b"^" + stem.encode() for stem in sorted(stems))]
        packed = np.fromiter(map(self._bucket.__getitem__, terms), np.int32).tobytes()
        if len(self._words) >= MEMO_ENTRIES:
            self._words.clear()
        if len(word) <= 64:
            self._words[word] = packed
        return packed

    def __call__(self, text: str) -> np.ndarray:
        known = self._words
        parts = [known.get(w) or self._word(w) for w in plain_terms(text)]
        found, count = np.unique(np.frombuffer(b"".join(parts), np.int32), return_counts=True)
        repeated = [
            (found[count >= least].astype(np.int64) * 40503 + least * 7919) % BUCKETS
            for least in (2, 3)
        ]
        return np.unique(np.concatenate([found, *repeated])).astype(np.int32)


def _evidence(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets met, and by how many standard errors their share of documents
    differs between the labels."""
    toxic, clean = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    total, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, label in zip(rows, y):
        total[row] += 1.0
        hits[row] += label
    share = (total + 1.0) / (toxic + clean + 2.0)
    error = np.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
    z = np.abs(hits / toxic - (total - hits) / clean) / error
    met = np.flatnonzero(total > 0).astype(np.int32)
    return met, z[met]


def fit(
    rows: list[np.ndarray],
    y: np.ndarray,
    factors: int = FACTORS,
    least_z: float = 0.0,
    epochs: int = 6,
    rate: float = 1.0,
    factor_rate: float = 0.03,
    shrink: float = 0.0,
    full_z: float = FULL_Z,
    floor: float = FLOOR,
) -> FactorizationMachine:
    """Fit by mini-batches with sparse AdaGrad steps on the logistic loss.

    Texts are sets of buckets, and every bucket met gets weights unless ``least_z``
    asks for fewer: what matters only beside another term has no share of its own
    that differs. A bucket enters with a value: the square of how many standard errors
    its share of documents differs between the labels, 1 from ``full_z`` on and never
    below ``floor``. So a term that is rare, or alike in both, has to be paid for with a
    larger weight, and cannot explain a label by chance. One factor brings texts to about
    unit length; ``shrink`` over the number of rows also shrinks weights when touched.
    Rates fall to zero over the epochs. Without both labels in the sample the model is its
    bias, the share of toxic rows.
    """
    positive = (float(y.sum()) + 0.5) / (len(y) + 1.0)
    bias = float(np.log(positive / (1 - positive)))
    kept, z = _evidence(rows, y) if 0 < y.sum() < len(y) else (np.empty(0, np.int32), np.empty(0))
    kept, z = kept[z >= least_z], z[z >= least_z]
    random = np.random.default_rng(7)
    # The linear weight of each bucket, then its factors.
    p = np.zeros((len(kept), 1 + factors), np.float32)
    p[:, 1:] = random.normal(0.0, 0.01, (len(kept), factors))
    if not len(kept):
        return FactorizationMachine(kept, bias, p[:, 0], p[:, 1:])
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    value = np.clip((z / full_z) ** 2, floor, 1.0)
    met_by = np.bincount(place[np.concatenate(rows)] + 1, minlength=len(kept) + 1)[1:]
    value = (value / np.sqrt((met_by * value**2).sum() / len(rows))).astype(np.float32)
    rates = np.array([rate] + [factor_rate] * factors, np.float32)
    gb, gp = 1e-8, np.full_like(p, 1e-6)
    met, slot = np.zeros(len(kept), bool), np.zeros(len(kept), np.int64)
    size = 128
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(rows) // size)))
    for epoch in range(epochs):
        slow = np.float32(1 - epoch / epochs)
        order = random.permutation(len(rows))
        for start in range(0, len(order), size):
            batch = order[start : start + size]
            at = place[np.concatenate([rows[i] for i in batch])]
            row = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            at, row = at[at >= 0], row[at >= 0]
            full, first = np.unique(row, return_index=True)
            used = p[at] * value[at][:, None]
            sums, squares = np.zeros((len(batch), 1 + factors)), np.zeros(len(batch))
            if len(at):
                sums[full] = np.add.reduceat(used, first, axis=0)
                squares[full] = np.add.reduceat((used[:, 1:] ** 2).sum(axis=1), first)
            pairs = 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            slope = (sigmoid(bias + sums[:, 0] + pairs) - y[batch]) / len(batch)
            met[:] = False
            met[at] = True
            touched = np.flatnonzero(met)
            slot[touched] = np.arange(len(touched))
            where, now = slot[at], p[touched]
            each = value[touched]
            own = np.bincount(where, weights=slope[row], minlength=len(touched))
            d = np.empty(now.shape)
            d[:, 0] = own
            for k in range(1, 1 + factors):
                through = (slope * sums[:, k])[row]
                d[:, k] = np.bincount(where, weights=through, minlength=len(touched))
            d[:, 1:] -= now[:, 1:] * (each * own)[:, None]
            d = d * each[:, None] + shrink / len(rows) * now
            gp[touched] += d * d
            p[touched] = now - slow * rates * d / np.sqrt(gp[touched])
            db = slope.sum()
            gb += db * db
            bias -= 0.1 * slow * db / np.sqrt(gb)
    p *= value[:, None]
    return FactorizationMachine(kept, float(bias), p[:, 0], p[:, 1:])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = TRAINING_ROWS
) -> FactorizationMachine:
    """Learn ``labels.toxic`` from at most ``sample_rows`` rows not held out.

    A document with several labels counts as toxic if any says so; rows without a
    label or an id are left aside.
    """
    labelled = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )

    def start():
        encode = TermEncoder()
        return lambda text: encode(text).tobytes()

    made = training_rows(docs, bounded_sample(labelled, "doc_id", sample_rows), "toxic", start)
    rows = [np.frombuffer(b, np.int32) for b in made["features"]]
    return fit(rows, made["target"].to_numpy(float))


def score_toxicity(
    docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``score`` in (0, 1) and ``predicted`` for every whole text.

    Only the text is read. A null text scores as an empty one: by the bias alone.
    One row per input row, repeats included, with ``id_col`` and ``held_out``.
    """

    def start():
        encode = TermEncoder()

        def row(key, text):
            return key, float(sigmoid(model.margin(encode(text or ""))))

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    scored = map_rows(docs, [id_col, text_col], start, f"`{id_col}` {kind}, score double")
    return scored.select(
        id_col,
        held_out(F.col(id_col)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
