"""Quality by ordinal cumulative-link regression: graded ratings, hashed text, one shared weight vector and ordered thresholds.

P(grade <= k) is the logistic function of threshold k minus the text's score. The score is a sum of weights of the hashed words and
sign runs that the text has. The expected grade orders documents; tail probabilities P(grade >= k) select them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from papertrellis.llm.decontam import words
from papertrellis.llm.tables import raw, slices

BUCKETS = 1 << 20
#: Labelled documents that a model is fitted on at most; those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Standard errors by which a feature's shares in two groups of grades have to differ for the model to use it.
TELLING = 6.0
_SIGNS = re.compile(rb"[!-/:-@\[-`{-~]{1,4}")


def buckets(text: bytes | None) -> np.ndarray:
    """Different hashed features of a text, sorted: lower-cased words and runs of signs; none for a null or blank text."""
    found = {zlib.crc32(w) for w in words(text)} | {zlib.crc32(s, 1) for s in _SIGNS.findall(text or b"")}
    return np.unique(np.fromiter(found, np.int64, len(found)) & (BUCKETS - 1)).astype(np.int32)


def telling(features: list[np.ndarray], marks: np.ndarray, grades: int, least: float = TELLING) -> np.ndarray:
    """Which buckets tell one grade from those above it: the two shares of texts with the feature differ by ``least`` standard errors."""
    n = np.fromiter(map(len, features), np.int64, len(features))
    flat, of = np.concatenate([np.zeros(0, np.int32), *features]), np.repeat(marks, n)
    seen = np.stack([np.bincount(flat[of == k], minlength=BUCKETS) for k in range(grades)], 1).astype(float)
    total = np.bincount(marks, minlength=grades).astype(float)
    out = np.zeros(BUCKETS, bool)
    for k in range(grades - 1):
        here, there = total[k], total[k + 1:].sum()
        if here and there:
            a, b = seen[:, k], seen[:, k + 1:].sum(1)
            share = (a + b) / (here + there)
            error = np.sqrt(share * (1 - share) * (1 / here + 1 / there))
            out |= np.abs(a / here - b / there) > least * np.maximum(error, 1e-9)
    return out


class Ordinal:
    """Weights, and thresholds in ascending order (one less than grades)."""

    def __init__(self, grades: int, weights: np.ndarray | None = None, thresholds: np.ndarray | None = None):
        self.grades = grades
        self.weights = np.zeros(BUCKETS) if weights is None else weights
        self.thresholds = np.linspace(-1, 1, max(1, grades - 1))[: grades - 1] if thresholds is None else thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        n = np.fromiter(map(len, features), np.int64, len(features))
        if not n.sum():
            return np.zeros(len(features))
        row = np.repeat(np.arange(len(features)), n)
        return np.bincount(row, self.weights[np.concatenate(features)], len(features))

    def fit(self, features: list[np.ndarray], marks: np.ndarray, rounds: int = 40, rate: float = 0.5, shrink: float = 1e-5, batch: int = 64, seed: int = 7) -> Ordinal:
        """Maximum likelihood of the features that tell grades apart, by adaptive gradient steps over shuffled batches."""
        keep = telling(features, marks, self.grades)
        features = [f[keep[f]] for f in features]
        rng, seen = np.random.default_rng(seed), np.full(BUCKETS, 1e-6)
        first, gap = float(self.thresholds[0]), np.log(np.maximum(np.diff(self.thresholds), 1e-3))
        slow = np.full(1 + len(gap), 1e-6)
        for _ in range(rounds):
            order = rng.permutation(len(marks))
            for lo in range(0, len(order), batch):
                pick = order[lo:lo + batch]
                some, y = [features[i] for i in pick], marks[pick]
                self.thresholds = first + np.concatenate([[0], np.cumsum(np.exp(gap))])
                s = self.score(some)
                upto = np.column_stack([np.zeros(len(y)), 1 - self.tails(s), np.ones(len(y))])
                slope = upto * (1 - upto)
                at = np.arange(len(y))
                p = np.maximum(upto[at, y + 1] - upto[at, y], 1e-12)
                by_score = (slope[at, y + 1] - slope[at, y]) / p  # of the negative log likelihood
                by_cut = np.zeros((len(y), self.grades + 1))
                by_cut[at, y + 1] -= slope[at, y + 1] / p
                by_cut[at, y] += slope[at, y] / p
                by_cut = by_cut[:, 1:-1].sum(0)
                n = np.fromiter(map(len, some), np.int64, len(some))
                if n.sum():
                    ids, back = np.unique(np.concatenate(some), return_inverse=True)
                    step = np.bincount(back, np.repeat(by_score, n)) + shrink * self.weights[ids]
                    seen[ids] += step**2
                    self.weights[ids] -= rate * step / np.sqrt(seen[ids])
                steps = np.array([by_cut.sum(), *(by_cut[::-1].cumsum()[::-1][1:] * np.exp(gap))]) / len(y)
                slow += steps**2
                move = 0.1 * steps / np.sqrt(slow)
                first, gap = first - move[0], np.clip(gap - move[1:], -5, 5)
        self.thresholds = first + np.concatenate([[0], np.cumsum(np.exp(gap))])
        return self


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic: 0 toxic, 1 neither toxic nor good, 2 good. Rows with nulls rate nothing; the lowest counts."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    known = labels.where("doc_id is not null and toxic is not null and quality is not null")
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """A model from the documents that ``ratings`` (doc_id, grade) rates; of more than ``sample``, those with the smallest hashed ids.

    Without ratings the model knows nothing: score 0 and tails from the starting thresholds.
    """
    kind = ratings.schema["doc_id"].dataType
    chosen = ratings.where("grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("__id"), F.col("grade").cast("int").alias("grade"))
    texts = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([buckets(t) for t in raw(batch.column("text"))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), found], names=["id", "grade", "features"])

    rows = texts.mapInArrow(run, f"id {kind.simpleString()}, grade int, features array<int>").toArrow().sort_by("id")
    model = Ordinal(grades)
    if not rows.num_rows:
        return model
    features = rows["features"].combine_chunks()
    ids, cuts = features.values.to_numpy(), features.offsets.to_numpy()
    return model.fit([ids[a:b] for a, b in zip(cuts, cuts[1:])], rows["grade"].to_numpy().astype(np.int64))


def grade(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and expected_grade, tails (array of P(grade >= 1), P(grade >= 2), ...); columns of these names are replaced.

    A null or blank text has score 0.
    """
    columns = [c for c in docs.columns if c not in ("expected_grade", "tails")]
    chosen = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).cast("string").alias("__text"))
    some = np.flatnonzero(model.weights).astype(np.int32)
    sent = docs.sparkSession.sparkContext.broadcast((model.grades, some, model.weights[some], model.thresholds))
    empty = docs.sparkSession.createDataFrame([], "expected_grade double, tails array<double>").schema
    schema = chosen.drop("__text").schema.add(empty["expected_grade"]).add(empty["tails"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, at, weights, thresholds = sent.value
        full = np.zeros(BUCKETS)
        full[at] = weights
        own = Ordinal(grades, full, thresholds)
        for batch in slices(batches, "__text"):
            tails = own.tails(own.score([buckets(t) for t in raw(batch.column("__text"))]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(columns))], pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64()))], names=[*columns, "expected_grade", "tails"])

    return chosen.mapInArrow(run, schema)


def selected(least: int, probability: float = 0.5) -> Column:
    """Condition on a graded table: the grade is at least ``least`` with this probability."""
    return F.element_at("tails", least) >= probability
