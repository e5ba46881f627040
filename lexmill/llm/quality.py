"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each document becomes a short vector of statistics of its whole text (lengths, shares of character
classes, repetition), transformed so that they are about normal.  Count, sums and sums of products
per class are aggregated over all labelled training rows: exact, linear in the input, and a few
hundred numbers at the driver whatever the input's size.  Class covariances are shrunk towards the
pooled one and towards a multiple of the identity; their Cholesky factors are computed once and go
with the scoring function.  A score is the logistic function of the difference of the two
log densities (Mahalanobis distance and determinant) plus the log prior odds.

Edge cases: null and empty texts have statistics of their own (zeros) and are scored like others;
labels that are null are not used; a row without a doc_id counts as held out (nothing labels it); a doc_id
labelled twice counts twice; if a class has too few rows for a covariance, the score of every document is the share of label 1 among the labelled (0.5 if there
is none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import FEW_ROWS, WORD, id_remainder, scratch, settle, whole_text

#: Shares of the pooled covariance and of the identity in each class covariance.
TO_POOLED, TO_IDENTITY = 0.1, 0.02
#: A document is kept if its score reaches this.
THRESHOLD = 0.3


def statistics(text: Column) -> list[Column]:
    """The transformed statistics of a text; every one is defined for the empty text too."""

    def n(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    chars, words = F.length(text).cast("double"), n(WORD)
    lines = F.split(text, "\n")
    upper, marks = n(r"\p{Lu}"), n(r"[^\p{L}\p{N}\s.,;:'\"()+=@/_-]")
    bare = n(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])")
    ends, commas, bangs = n(r"[.?]"), n(","), n("[!|#$%&*]")
    tails = n(r"(?<![^\p{L}\p{N}\s.,;:])[^\p{L}\p{N}\s.,;:]{2,}+(?![^\x20\x09-\x0D])")  # from a run's beginning alone: linear
    short = n(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])")
    doubled = n(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)\x20\1(?![^\x20\x09-\x0D])")
    distinct = F.size(F.array_distinct(F.split(text, "[\x20\x09-\x0d]+"))).cast("double")
    repeats = (F.size(lines) - F.size(F.array_distinct(lines))).cast("double")

    def rate(part: Column, whole: Column, usual: float = 0.0, weight: float = 20.0) -> Column:
        """A share, drawn to what is usual in prose as if ``weight`` more units had been seen."""
        return F.asinh(20 * (part + usual * weight) / (whole + weight))

    return [
        F.log1p(words),
        F.log1p((chars + 100.0) / (words + 20.0)),
        rate(upper, chars, 0.03, 100.0),
        rate(marks, chars, 0.0, 100.0),
        rate(bare, words),
        rate(ends, words, 0.1),
        rate(commas, words, 0.05),
        rate(bangs, words),
        rate(tails, words),
        rate(doubled, words),
        rate(short, words, 0.4),
        F.log1p((words + 2.0) / (distinct + 2.0)),
        rate(repeats, F.size(lines).cast("double"), 0.0, 5.0),
        rate(F.size(lines).cast("double") - 1, words, 0.03),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t")).select("doc_id", F.array(*statistics(F.col("t"))).alias("x"))


@dataclass
class Discriminant:
    """Two means with the Cholesky factors of their covariances, or a constant score."""

    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    odds: float
    constant: float = 0.5

    @cached_property
    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """The inverse Cholesky factors, made once for all batches."""
        return tuple(np.linalg.solve(f, np.eye(len(f))) for f in self.factors)

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = self.whitening[k] @ (x - self.means[k]).T
        return -0.5 * (z * z).sum(axis=0) - np.log(np.diag(self.factors[k])).sum()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.constant)
        margin = self.log_density(x, 1) - self.log_density(x, 0) + self.odds
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def moments(labelled: DataFrame, width: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(count, sums, sums of products) by label, over all rows of ``labelled`` (label, x)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
            for k in np.unique(labels):
                own = np.hstack([np.ones((int((labels == k).sum()), 1)), x[labels == k]])
                held[int(k)] = held.get(int(k), 0) + own.T @ own
        for k, m in held.items():
            rows, cols = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array([k] * m.size, pa.int32()), pa.array(rows.ravel(), pa.int32()), pa.array(cols.ravel(), pa.int32()), pa.array(m.ravel())], ["k", "i", "j", "v"])

    parts = labelled.mapInArrow(work, "k int, i int, j int, v double")
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():  # a few hundred rows
        found.setdefault(r["k"], np.zeros((width + 1, width + 1)))[r["i"], r["j"]] = r["v"]
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in found.items()}


def fit(labelled: DataFrame, width: int, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """The discriminant of ``labelled`` (label 0 or 1, x)."""
    found = moments(labelled.where("label in (0, 1)").select(F.col("label").cast("int"), "x"), width)
    n = {k: found[k][0] if k in found else 0.0 for k in (0, 1)}
    if min(n.values()) < 3:
        return Discriminant(None, None, 0.0, n[1] / sum(n.values()) if sum(n.values()) else 0.5)
    means = {k: s / c for k, (c, s, _) in found.items()}
    own = {k: p / c - np.outer(means[k], means[k]) for k, (c, _, p) in found.items()}
    pooled = sum(n[k] * own[k] for k in (0, 1)) / sum(n.values())
    factors = []
    for k in (0, 1):
        c = (1 - to_pooled) * own[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / width, 1e-6) * np.eye(width)
        factors.append(np.linalg.cholesky((c + c.T) / 2))
    return Discriminant((means[0], means[1]), (factors[0], factors[1]), float(np.log(n[1] / n[0])))


def score(rows: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` (doc_id, x, ...) as (doc_id, score, predicted)."""
    kind, width = rows.schema["doc_id"].dataType.simpleString(), len(statistics(F.lit("")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    out = rows.select("doc_id", "x").mapInArrow(work, f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; rows of fold 0 of 5 are never learned from."""
    rows = settle(features(docs).withColumn("held_out", id_remainder() == 0))
    model = train(rows, labels)
    return score(rows, model).select("doc_id", (id_remainder() == 0).alias("held_out"), "score", "predicted")


def train(rows: DataFrame, labels: DataFrame) -> Discriminant:
    known = rows.where("not held_out").join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    return fit(known.select("label", "x"), len(statistics(F.lit(""))))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns.

    Statistics are taken of the labelled rows to learn and of each row once to score.  Rows are scored where
    they stand and never joined back, so ids may repeat or be null.
    """
    with scratch(docs.sparkSession):
        ids = settle(labels.where("doc_id is not null and quality is not null").select("doc_id").where(id_remainder() != 0).distinct())
        known = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= FEW_ROWS else ids, "doc_id", "left_semi")
        model = train(settle(features(known).withColumn("held_out", F.lit(False))), labels)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else np.empty(0))

    x = F.array(*statistics(whole_text("quality_doc.text")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("quality_doc"))
    return whole.where(scored(x) >= THRESHOLD).select("quality_doc.*")
