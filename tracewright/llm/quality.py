"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance of the statistics, the covariance shrunk towards a diagonal of the pooled
variances. A text's score is the sigmoid of the difference of the two classes' Gaussian log densities (Mahalanobis
distances by the cached Cholesky factors) and log shares. Spark sums the moments of all labelled rows, so that the
driver sees a few hundred numbers whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_texts, rewrite_texts, settled, table

#: A score from here on counts as good.
THRESHOLD = 0.7
#: Weight of the diagonal target in each class's covariance.
SHRINKAGE = 0.15
STATISTICS = (
    "chars_per_word",
    "long_words",
    "symbols",
    "repeated_symbols",
    "bars",
    "capitals",
    "digits",
    "stops",
    "line_breaks",
    "repeated_words",
    "repeated_pairs",
    "same_as_next",
    "distinct_words",
    "log_words",
)
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*@^~<>=_{}[]\\/+!`")] = True
#: Statistics are over stretches of this many words and averaged by their lengths, so that a very long text is judged as its parts are.
STRETCH = 400


def _stretch(words: list[bytes]) -> list[float]:
    joined = b" ".join(words)
    data = np.frombuffer(joined, np.uint8)
    n, counts = len(words), np.bincount(data, minlength=256)
    letters = max(1, int(counts[LETTERS].sum()))
    marks = MARKS[data]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    after = sum(a == b for a, b in zip(words, words[1:], strict=False))
    long = sum(len(w) > 12 for w in words)
    return [
        len(data) / n,
        long / n,
        counts[MARKS].sum() / n,
        float((marks[1:] & marks[:-1]).sum()) / n,
        counts[124] / n,
        counts[65:91].sum() / letters,
        counts[48:58].sum() / len(data),
        (counts[44] + counts[46]) / n,
        0.0,
        1 - distinct / n,
        1 - pairs / max(1, n - 1),
        after / max(1, n - 1),
        # Distinct words, against what is usual for so many (a power law), so that lengths can be compared.
        np.log((distinct + 1) / (n + 1) ** 0.9),
        0.0,
    ]


def statistics(text: str) -> np.ndarray:
    """STATISTICS of a whole text, each transformed so that small shares spread out."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return np.zeros(len(STATISTICS))
    total = np.zeros(len(STATISTICS))
    for i in range(0, len(words), STRETCH):
        part = words[i : i + STRETCH]
        total += np.array(_stretch(part)) * len(part)
    out = total / len(words)
    out[8] = raw.count(b"\n") / len(words)
    out[13] = np.log1p(len(words))
    shares = [i for i, name in enumerate(STATISTICS) if name not in ("chars_per_word", "distinct_words", "log_words")]
    out[shares] = np.log(out[shares] + 0.01)
    out[0] = np.log(out[0])
    return out


def _forward(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """z with lower @ z = b, for a lower triangular matrix: row by row."""
    z = np.empty_like(b)
    for i in range(len(lower)):
        z[i] = (b[i] - lower[i, :i] @ z[:i]) / lower[i, i]
    return z


@dataclass
class Discriminant:
    """Means, Cholesky factors of the shrunk covariances and log shares of labels 0 and 1; or only the share of 1."""

    share: float = 0.5
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    scale: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: list[float], sums: list[np.ndarray], squares: list[np.ndarray], shrinkage: float = SHRINKAGE) -> Discriminant:
        total = sum(counts)
        out = cls(share=counts[1] / total if total else 0.5)
        if min(counts) < 2:
            return out
        covariances = []
        for n, s, q in zip(counts, sums, squares, strict=True):
            out.means.append(s / n)
            covariances.append(q / n - np.outer(s / n, s / n))
        pooled = np.diag(sum(n * np.diag(c) for n, c in zip(counts, covariances, strict=True)) / total + 1e-3)
        out.factors = [np.linalg.cholesky((1 - shrinkage) * c + shrinkage * pooled) for c in covariances]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """For rows of statistics, how likely label 1 is."""
        if not self.factors:
            return np.full(len(x), self.share)
        logs = []
        for mean, factor, share in zip(self.means, self.factors, (1 - self.share, self.share), strict=True):
            z = _forward(factor, (x - mean).T)
            logs.append(np.log(share) - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x (STATISTICS) of each row: a hundred bytes, where a text has thousands, so that texts stay where they are read."""

    def make():
        return lambda keys, texts: {"doc_id": keys, "x": [statistics(t) for t in texts]}

    return over_texts(docs, make, "doc_id long, x array<double>", limit=1 << 20)


def _rows(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from all rows of docs that have a label 0 or 1 (column quality) by doc_id; rows with several count each."""
    return fit_measured(measured(docs), labels)


def fit_measured(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """fit() by measured() rows: they meet the labels, not the texts."""
    size = len(STATISTICS)
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_of"), F.col("quality").cast("int").alias("y")).distinct()
    labelled = rows.join(known, F.col("doc_id") == F.col("_of")).select("y", "x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = _rows(batch.column(1))
            for label in (0, 1):
                own = x[y == label]
                sums[label] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_pydict({"y": pa.array([0, 1], pa.int32()), "m": pa.array(list(sums), pa.list_(pa.float64()))})

    parts = labelled.mapInArrow(moments, "y int, m array<double>").select("y", F.posexplode("m").alias("at", "v"))
    out = np.zeros((2, 1 + size + size * size))
    for r in parts.groupBy("y", "at").agg(F.sum("v").alias("v")).collect():  # two times 1 + size + size**2 rows
        out[r["y"], r["at"]] = r["v"]
    return Discriminant.fit(list(out[:, 0]), list(out[:, 1 : 1 + size]), [m.reshape(size, size) for m in out[:, 1 + size :]])


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score of each row; an empty text has one, too."""
    return score_measured(measured(docs), model)


def score_measured(rows: DataFrame, model: Discriminant) -> DataFrame:
    """score() by measured() rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_rows(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Only rows that are learnable() teach. A null or empty text counts as one without words; with a null doc_id a row is
    scored, not held out; repeated rows are scored each; without labels of both kinds the score is their share of 1
    (0.5 without any); other columns are ignored; an empty table gives no rows.
    """
    rows = settled(measured(docs))  # for both passes
    model = fit_measured(rows.where(learnable(F.col("doc_id"))), labels)
    held_out = ~F.coalesce(learnable(F.col("doc_id")), F.lit(True))
    predicted = (F.col("score") >= threshold).cast("int")
    return score_measured(rows, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that classify() predicts 1 for, with all their columns."""
    # Settled, so that no task has a Python worker for the statistics and one for their moments.
    model = fit_measured(settled(measured(docs.where(learnable(F.col("doc_id"))))), labels)

    def make():
        def work(texts: list[str]) -> list[str | None]:
            scores = model.score(np.array([statistics(t) for t in texts]))
            return [t if s >= threshold else None for t, s in zip(texts, scores.tolist(), strict=True)]

        return work

    return rewrite_texts(docs, make)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
