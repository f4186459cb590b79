"""Ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score), with ordered thresholds and one score for all grades:
the sum of hashed-text weights. Features are the distinct words of a text (each once) and the shares of its
words' shapes (letters as a or A, digits as 0, other characters as they are, runs shortened to three),
of words equal to the one before, and of words that are not new to the text.

The model is fitted on the driver, on at most ``sample`` labelled documents, those with the least hash of
their id; the bound doesn't grow with the corpus. Every document is scored whole. Grades come from labels
as 0 for poor quality, 1 for good quality that is toxic, and 2 for good and clean.

Defined cases: null, empty and wordless texts have no feature and get the grade of score zero; labels with a
null in any column and labels without a document are left out of the fit; if no labels are left, or one
grade is missing, the thresholds still separate by the grades there are; of repeated labels each counts;
null ids and repeated rows are scored like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, DIMENSIONS, GRADES = 4000, 1 << 18, 3
REMEMBER = 300_000
RUNS = re.compile(r"(.)\1\1+")


def shape(word: str) -> str:
    return RUNS.sub(r"\1\1\1", "".join("0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in word)).replace("AAA", "A").replace("aaa", "a")


class Features:
    """Text -> places and values of its features."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.words: dict[bytes, int] = {}
        self.shapes: dict[bytes, int] = {}

    def place(self, name: bytes) -> int:
        from xxhash import xxh64_intdigest

        return xxh64_intdigest(name, 11) % self.dimensions

    def of(self, text: bytes | None) -> tuple[list[int], list[float]]:
        words = (text or b"").split()
        if not words:
            return [], []
        if len(self.words) > REMEMBER:
            self.words.clear()
            self.shapes.clear()
        counts = Counter(words)
        shapes: Counter = Counter()
        at: set[int] = set()
        for w, n in counts.items():
            if (k := self.words.get(w)) is None:
                text_of = w.decode("utf-8", "replace")
                k = self.words[w] = self.place(b"w " + text_of.lower().strip(".,;:!?\"'()").encode())
                self.shapes[w] = self.place(b"s " + shape(text_of).encode())
            at.add(k)
            shapes[self.shapes[w]] += n
        same = sum(map(bytes.__eq__, words, words[1:]))
        shapes[self.place(b"# same")] += same
        shapes[self.place(b"# old")] += len(words) - len(counts)
        return [*at, *shapes], [1.0] * len(at) + [10 * n / len(words) for n in shapes.values()]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def telling(at: np.ndarray, doc: np.ndarray, y: np.ndarray, dimensions: int, least: float) -> np.ndarray:
    """Which features go with the grade: the mean grade of their documents is ``least`` standard errors or more from that of all."""
    if not len(y) or not y.std():
        return np.zeros(dimensions, dtype=bool)
    n = np.bincount(at, minlength=dimensions)
    z = (np.bincount(at, y[doc], minlength=dimensions) - n * y.mean()) / (np.sqrt(np.maximum(n, 1)) * y.std())
    return (np.abs(z) >= least) | (n > 0.5 * len(y))


def fit(rows: list[tuple[list[int], list[float], int]], dimensions: int = DIMENSIONS, grades: int = GRADES, epochs: int = 30, rate: float = 0.05, decay: float = 3e-3, least: float = 5.0, seed: int = 7) -> Model:
    """Minibatch Adam on the likelihood; thresholds are the first and the logs of the gaps.

    Features are screened first: words of a few documents would else explain those one by one.
    """
    rng, w, cut = np.random.default_rng(seed), np.zeros(dimensions), np.array([-1.0, *[0.0] * (grades - 2)])
    state = [np.zeros(dimensions), np.zeros(dimensions), np.zeros(grades - 1), np.zeros(grades - 1)]
    sizes = np.array([len(r[0]) for r in rows], dtype=np.int64)
    ends = np.cumsum(sizes)
    at = np.array([k for r in rows for k in r[0]], dtype=np.int64)
    value = np.array([v for r in rows for v in r[1]])
    y = np.array([r[2] for r in rows], dtype=np.int64)
    stay = telling(at, np.repeat(np.arange(len(rows)), sizes), y, dimensions, least)[at] if len(at) else np.zeros(0, dtype=bool)
    sizes = np.bincount(np.repeat(np.arange(len(rows)), sizes)[stay], minlength=len(rows))
    ends, at, value = np.cumsum(sizes), at[stay], value[stay]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    edges = lambda: np.cumsum(np.r_[cut[0], np.exp(cut[1:])])
    step = 0
    for _ in range(epochs if rows else 0):
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), 128):
            own = order[low : low + 128]
            n = sizes[own]
            pick = np.repeat(ends[own] - n - np.cumsum(n) + n, n) + np.arange(n.sum())
            doc, a, v = np.repeat(np.arange(len(own)), n), at[pick], value[pick]
            score = np.bincount(doc, w[a] * v, minlength=len(own))
            theta, g = edges(), y[own]
            upper = np.where(g < grades - 1, sigmoid(np.r_[theta, 0][g] - score), 1.0)
            lower = np.where(g > 0, sigmoid(np.r_[0, theta][g] - score), 0.0)
            p = np.maximum(upper - lower, 1e-9)
            up, down = upper * (1 - upper) / p, lower * (1 - lower) / p
            by_score = (up - down) / len(own)  # of -log p
            d_w = np.bincount(a, by_score[doc] * v, minlength=dimensions) + decay * w / grades
            d_theta = np.array([-(up[g == k].sum() - down[g == k + 1].sum()) for k in range(grades - 1)]) / len(own)
            d_cut = np.r_[d_theta.sum(), [d_theta[k:].sum() * np.exp(cut[k]) for k in range(1, grades - 1)]]
            step += 1
            for x, d, m, s in ((w, d_w, state[0], state[1]), (cut, d_cut, state[2], state[3])):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            cut[1:] = np.clip(cut[1:], -3, 3)
    return Model(w.astype(np.float32), edges())


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.dropna(subset=[id_col, "quality", "toxic"]).select(id_col, F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, dimensions: int = DIMENSIONS, n_grades: int = GRADES) -> Model:
    """grades: (id, grade). Fits on at most ``sample`` labelled documents: those of the ``sample`` labels of least hash, and of rows that share their ids again the ``sample`` of least hash."""
    chosen = grades.orderBy(F.xxhash64(id_col), id_col, "grade").limit(sample)
    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(chosen), id_col)  # at most ``sample`` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(dimensions)
        for b in batches:
            if len(b):
                at, value = zip(*(features.of(x.as_py()) for x in b.column("_text")), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), b.column("grade"), b.column(id_col)], names=["at", "value", "grade", "i"])

    table = rows.mapInArrow(run, f"at array<int>, value array<float>, grade int, i {rows.schema[id_col].dataType.simpleString()}")
    table = table.orderBy(F.xxhash64("i"), "i", "grade", F.xxhash64("at", "value")).limit(sample).toArrow()
    table = table.sort_by([("i", "ascending"), ("grade", "ascending")])
    return fit([(a, v, g) for a, v, g in zip(table["at"].to_pylist(), table["value"].to_pylist(), table["grade"].to_pylist(), strict=True)], dimensions, n_grades)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.7) -> DataFrame:
    """(id, expected_grade, tail_1, ..., kept): tail_k is P(grade >= k); kept if the highest grade has probability ``at_least``."""
    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    n = len(model.thresholds)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        features = Features(len(own.weights))
        for b in batches:
            score = np.zeros(len(b))
            for i, x in enumerate(b.column(1)):
                at, value = features.of(x.as_py())
                score[i] = float(np.dot(own.weights[at], value)) if at else 0.0
            tails = own.tails(score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), *(pa.array(tails[:, k]) for k in range(n)), pa.array(tails[:, -1] >= at_least)], names=["i", "e", *(f"t{k}" for k in range(n)), "k"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, expected_grade double, " + ", ".join(f"tail_{k + 1} double" for k in range(n)) + ", kept boolean")
