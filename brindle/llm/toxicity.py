"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - b_k): one weight for each word, shared across the ordered thresholds b_1 < b_2 < ..., so the grades
stay ordered. x says which words (lower case, without punctuation around them, hashed to 2^FEATURE_BITS) a text has. Training
takes at most `max_rows` labelled rows, those with the smallest hash of their id, on the driver: gradient steps with an L1
penalty select the words that tell, and a refit without it gives them their weights. Scoring sums weights of a text's distinct words; the expected severity is the
sum of P(grade > k) over k.

Nulls: a null text has no words and a severity from the thresholds alone; rows whose id or grade is null aren't trained on; a null
id is scored. Repeated rows each give a row. Texts are read whole. With labelled rows of one grade only, every text gets that
grade; without any, grade 0. Grades below 0 fail with ValueError.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import parts, table

FEATURE_BITS = 20
#: Labelled rows to train on at most, and the rows a word must be in to count.
MAX_ROWS = 8000
MIN_ROWS = 3
STEPS = 300
#: L1 penalty of the selection, over the square root of the rows; the refit of selected words has next to none.
STRENGTH = 0.03
REFIT_PENALTY = 2e-6
#: A grade is passed if that is at least so probable: toxic texts are rare, so one that resembles them at all stands out.
CUT = 0.3
_EDGE = string.punctuation + "…“”„«»¿¡’‘–—"


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words of all texts; repeats stay."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, offsets = parts.values, parts.offsets.to_numpy()
    coded = words.dictionary_encode()
    mask = (1 << FEATURE_BITS) - 1
    of = np.array([xxhash.xxh64_intdigest(x, 7) & mask if (x := w.strip(_EDGE).lower()) else -1 for w in coded.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    feature = of[coded.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)
    return row[feature >= 0], feature[feature >= 0]


@dataclass(frozen=True)
class Model:
    """Features in order, their weights, and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))

    def score(self, texts: pa.Array) -> np.ndarray:
        row, feature = _features(texts)
        if not len(self.features):
            return np.zeros(len(texts))
        place = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)  # of the few that the model has
        known = self.features[place] == feature
        pairs = np.unique(row[known] << FEATURE_BITS | place[known])
        return np.bincount(pairs >> FEATURE_BITS, self.weights[pairs & ((1 << FEATURE_BITS) - 1)], minlength=len(texts))


def features_of(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct features of each text."""
    row, feature = _features(pa.array(texts, pa.large_string()))
    pairs = np.unique(row << FEATURE_BITS | feature)
    return np.split((pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32), np.searchsorted(pairs >> FEATURE_BITS, np.arange(1, len(texts))))


def fit(features: list[np.ndarray], grades: list[int], steps: int = STEPS, strength: float = STRENGTH, min_rows: int = MIN_ROWS) -> Model:
    """Words selected under an L1 penalty, and then their weights. features as from features_of(); grades are whole numbers from 0."""
    first = _descend(features, grades, steps, strength / np.sqrt(max(1, len(grades))), min_rows)
    if not len(first.features):
        return first
    keep = np.zeros(1 << FEATURE_BITS, bool)
    keep[first.features] = True
    return _descend([x[keep[x]] for x in features], grades, steps, REFIT_PENALTY, 1)


def _descend(features: list[np.ndarray], grades: list[int], steps: int, penalty: float, min_rows: int) -> Model:
    """Adagrad steps with a proximal L1 step on the cumulative-link likelihood."""
    y = np.asarray(grades, np.int64)
    if len(set(grades)) < 2 or y.min() < 0:
        raise ValueError("training needs two grades at least, from 0 up")
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in features])
    feature = np.concatenate(features)
    kept, place, n_rows = np.unique(feature, return_inverse=True, return_counts=True)
    use = (n_rows >= min_rows)[place]
    row, place = row[use], (np.cumsum(n_rows >= min_rows) - 1)[place[use]]
    kept = kept[n_rows >= min_rows]
    n, k = len(y), int(y.max())
    w, seen = np.zeros(len(kept)), np.full(len(kept), 1e-6)
    # thresholds as the first and the logarithms of the gaps
    share = np.array([np.clip((y > j).mean(), 1e-4, 1 - 1e-4) for j in range(k)])
    b = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(k))
    seen_b = np.full(k, 1e-6)
    for _ in range(steps):
        s = np.bincount(row, w[place], minlength=n) if len(kept) else np.zeros(n)
        up = 1 / (1 + np.exp(-np.clip(s[:, None] - b[None, :], -50, 50)))
        cum = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        p = np.maximum(cum[np.arange(n), y] - cum[np.arange(n), y + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))], axis=1)
        ds = -(slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / p / n
        db = np.zeros(k)
        for j in range(k):
            db[j] = (np.where(y == j + 1, slope[:, j + 1] / p, 0) - np.where(y == j, slope[:, j + 1] / p, 0)).sum() / n
        g = np.bincount(place, ds[row], minlength=len(kept))
        seen += g * g
        step = 0.3 / np.sqrt(seen)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        seen_b += db * db
        b = np.maximum.accumulate(b - 0.3 / np.sqrt(seen_b) * db)
    told = w != 0
    return Model(kept[told], w[told], b)


def constant(grade: int) -> Model:
    """A model without features, by which every text has `grade`; thresholds as fit() has them for a share of all or none."""
    share = np.clip((grade > np.arange(max(1, grade))).astype(float), 1e-4, 1 - 1e-4)
    return Model(np.zeros(0, np.int64), np.zeros(0), np.log((1 - share) / share))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", grade_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """A model from the labelled rows of docs, max_rows of them at most (by hash of the id, then grade; an id's texts in order)."""
    known = labels.select(F.col(f"`{label_id_col}`").cast("long").alias("l_id"), F.col(f"`{grade_col}`").cast("int").alias("grade")).filter("l_id is not null and grade is not null").groupBy("l_id").agg(F.max("grade").alias("grade"))
    some = known.orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("d_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = d.join(F.broadcast(some), F.col("d_id") == F.col("l_id")).select(F.xxhash64("d_id").alias("h"), "d_id", "grade", "text")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.record_batch([*b.columns[:-1], pa.array(features_of(b.column(3).to_pylist()) if b.num_rows else [], pa.list_(pa.int32()))], ["h", "d_id", "grade", "features"])

    # texts stay on the executors; the driver gets max_rows lists of features
    got = rows.mapInArrow(told, "h long, d_id long, grade int, features array<int>").orderBy("h", "d_id", "features").limit(max_rows).select("grade", "features").toArrow()
    grades = got.column("grade").to_pylist()
    if len(set(grades)) < 2 and min(grades, default=0) >= 0:
        return constant(max(grades, default=0))
    lists = got.column("features").combine_chunks()
    return fit([x.values.to_numpy() for x in lists], grades)


def grade(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (those in keep, if given), severity (expected grade) and grade (how many thresholds are passed with a probability of CUT or more)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("severity", "grade")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            above = model.above(model.score(b.column(b.num_columns - 1)))
            yield pa.record_batch([*b.columns[:-1], pa.array(above.sum(axis=1)), pa.array((above >= CUT).sum(axis=1).astype(np.int32))], [*b.schema.names[:-1], "severity", "grade"])

    src = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").cast("string").alias("t"))
    out = src.drop("t").withColumns({"severity": F.lit(0.0), "grade": F.lit(0)})
    return src.mapInArrow(run, out.schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "severity", "grade")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: kept is false where the grade is above 0."""
    docs = table(spark, sf_dir, "documents")
    out = grade(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", "severity", "grade", (F.col("grade") == 0).alias("kept"))
