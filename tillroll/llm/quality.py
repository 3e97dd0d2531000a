"""Text quality by ordinal regression on graded ratings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import bounded_sample, map_rows
from tillroll.llm.features import MEMO_ENTRIES, BucketMemo, encoded_rows, sigmoid

BUCKETS = 1 << 16
#: The most rated rows the model is fitted on.
TRAINING_ROWS = 20_000
KEEP_GRADE = 1

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_SHOUTED = re.compile(r"[A-ZÀ-ÖØ-Þ]{2}")


def _kind(run: re.Match) -> str:
    letters = run[0]
    if _SHOUTED.search(letters):
        return "U"
    return "C" if letters[0].isupper() else "w"


def _shape(word: str) -> str:
    """The word with its runs of letters and digits replaced by their kind."""
    return _DIGITS.sub("9", _LETTERS.sub(_kind, word))[:12]


class FeatureEncoder:
    """Text to packed (bucket, value) pairs of unit length.

    The terms are words, their shapes, and how long and how repetitive the text is.
    Counts are damped by a square root of their share, so length alone moves little.
    """

    def __init__(self):
        self._bucket = BucketMemo(BUCKETS)
        self._shapes: dict[str, str] = {}

    def _shape_of(self, word: str) -> str:
        shape = self._shapes.get(word)
        if shape is None:
            if len(self._shapes) >= MEMO_ENTRIES:
                self._shapes.clear()
            shape = _shape(word)
            if len(word) <= 64:
                self._shapes[word] = shape
        return shape

    def pairs(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(text.split())
        total = max(1, sum(counts.values()))
        shapes: Counter = Counter()
        for word, n in counts.items():
            shapes[self._shape_of(word)] += n
        bucket = self._bucket
        at = [bucket[b"w" + w.encode()] for w in counts]
        value = [0.5 * (n / total) ** 0.5 for n in counts.values()]
        at += [bucket[b"s" + s.encode()] for s in shapes]
        value += [(n / total) ** 0.5 for n in shapes.values()]
        length = total.bit_length()
        repeats = int(10 * len(counts) / total)
        most = int(10 * max(counts.values(), default=0) / total)
        marks = (f"len{length}", f"rep{repeats}:{min(length, 9)}", f"top{most}")
        at += [bucket[b"d" + m.encode()] for m in marks]
        value += [0.5] * len(marks)
        found, where = np.unique(np.array(at, np.int32), return_inverse=True)
        return found, np.bincount(where, weights=value)

    def packed(self, text: str) -> bytes:
        at, value = self.pairs(text)
        return at.tobytes() + value.astype(np.float32).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(data) // 2
    return np.frombuffer(data[:half], np.int32), np.frombuffer(data[half:], np.float32)


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . x), one set of weights."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; never rising with k."""
        latent = float(self.weights[at] @ value)
        return sigmoid(latent - self.thresholds)


def fit_ordinal(
    rows: list[tuple[np.ndarray, np.ndarray]],
    grades: np.ndarray,
    top: int,
    epochs: int = 25,
    rate: float = 0.3,
    shrink: float = 1e-5,
) -> OrdinalModel:
    """Fit the cumulative-link model by mini-batches with AdaGrad steps.

    The thresholds are the first one plus positive steps (their logarithms are
    what is learnt), so they stay in order. They start where the shares of the
    grades put them, which is also the model for a sample without rows.
    """
    share = (np.bincount(grades, minlength=top + 1) + 0.5) / (len(grades) + 0.5 * (top + 1))
    below = np.cumsum(share)[:-1]
    first = np.log(below / (1 - below))
    theta0, steps = first[0], np.log(np.maximum(np.diff(first), 1e-3))
    w = np.zeros(BUCKETS)
    gw, g0, gs = np.full(BUCKETS, 1e-8), 1e-8, np.full(len(steps), 1e-8)
    random = np.random.default_rng(11)
    for _ in range(epochs if len(rows) else 0):
        order = random.permutation(len(rows))
        for start in range(0, len(order), 128):
            batch = order[start : start + 128]
            at = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch]).astype(float)
            row = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            latent = np.bincount(row, weights=w[at] * value, minlength=len(batch))
            theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
            y = grades[batch]
            upper = np.where(y < top, sigmoid(theta[np.minimum(y, top - 1)] - latent), 1.0)
            lower = np.where(y > 0, sigmoid(theta[np.maximum(y - 1, 0)] - latent), 0.0)
            mass = np.maximum(upper - lower, 1e-9)
            du = np.where(y < top, upper * (1 - upper), 0.0) / mass
            dl = np.where(y > 0, lower * (1 - lower), 0.0) / mass
            n = len(batch)
            dlatent = (du - dl) / n
            dtheta = np.zeros(top)
            np.add.at(dtheta, np.minimum(y, top - 1), -du / n)
            np.add.at(dtheta, np.maximum(y - 1, 0), dl / n)
            touched, where = np.unique(at, return_inverse=True)
            dw = np.bincount(where, weights=dlatent[row] * value) + shrink * w[touched]
            gw[touched] += dw * dw
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            d0 = dtheta.sum()
            g0 += d0 * d0
            theta0 -= rate * d0 / np.sqrt(g0)
            if len(steps):
                ds = np.cumsum(dtheta[::-1])[::-1][1:] * np.exp(steps)
                gs += ds * ds
                steps = np.clip(steps - rate * ds / np.sqrt(gs), -7.0, 7.0)
    theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
    return OrdinalModel(w, theta)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the two labels, on a scale of three grades.

    0 is text without quality, 1 is good text that is toxic, 2 is good and clean.
    Of several labels for a document the worst grade counts.
    """
    known = F.col("doc_id").isNotNull() & F.col("quality").isNotNull()
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1)
    return (
        labels.filter(known)
        .groupBy("doc_id")
        .agg(F.min(grade.otherwise(2)).alias("grade"))
    )


def fit_quality(
    docs: DataFrame, ratings: DataFrame, top: int = 2, sample_rows: int = TRAINING_ROWS
) -> OrdinalModel:
    """Learn ``ratings.grade`` (0 to ``top``) from at most ``sample_rows`` rated rows.

    The model is fitted in a task, over the features of that many rows in the order of their
    ids; only its weights and thresholds come to the driver.
    """

    def start():
        return FeatureEncoder().packed

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades = [], []
        for batch in batches:
            rows += [_unpacked(v.as_py()) for v in batch.column("features")]
            grades += batch.column("target").to_pylist()
        model = fit_ordinal(rows, np.array(grades, int), top)
        made = {"weights": model.weights, "thresholds": model.thresholds}
        yield pa.RecordBatch.from_pydict({k: [v.tobytes()] for k, v in made.items()})

    made = encoded_rows(docs, bounded_sample(ratings, "doc_id", sample_rows), "grade", start)
    ordered = made.repartition(1).sortWithinPartitions("id").select("target", "features")
    found = ordered.mapInArrow(fitted, "weights binary, thresholds binary").first()
    if found is None:
        return fit_ordinal([], np.array([], int), top)
    return OrdinalModel(np.frombuffer(found.weights), np.frombuffer(found.thresholds))


def score_quality(
    docs: DataFrame,
    model: OrdinalModel,
    keep_grade: int = KEEP_GRADE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Expected grade and tail probability of every whole text.

    ``expected_grade`` is the sum of the tails, ``tail`` is P(grade >=
    ``keep_grade``), and ``kept`` says whether that is at least one half. A null
    text is scored as empty. One row per input row, repeats included.
    """

    def start():
        encoder = FeatureEncoder()

        def row(key, text):
            tails = model.tails(*encoder.pairs(text or ""))
            return key, float(tails.sum()), float(tails[keep_grade - 1])

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, expected_grade double, tail double"
    scored = map_rows(docs, [id_col, text_col], start, schema)
    return scored.withColumn("kept", F.col("tail") >= 0.5)


def select_quality(
    docs: DataFrame,
    model: OrdinalModel,
    keep_grade: int = KEEP_GRADE,
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose grade is likelier than not ``keep_grade`` or more.

    Rows keep all their columns; the text is scored beside them, without a join.
    """

    def start():
        encoder = FeatureEncoder()

        def row(*values):
            tails = model.tails(*encoder.pairs(values[at] or ""))
            return [values] if tails[keep_grade - 1] >= 0.5 else []

        return row

    at = docs.columns.index(text_col)
    return map_rows(docs, docs.columns, start, docs.schema)
