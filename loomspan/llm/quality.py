"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. Class means and
covariances are summed in Spark over at most ``FIT_ROWS`` labelled rows, taken by the hash
of their id; the covariances are shrunk towards their pooled matrix and its diagonal, and
their Cholesky factors, inverted and cached once, turn every score into two Mahalanobis
distances: the score is the logistic of the tempered difference of the two Gaussian
log-densities. Every text is read once to be scored.

Defined cases: a null text counts as empty; an empty text gets the statistics of no
words and so a score like any other row; rows with null labels or null ids are never
learnt from; repeated rows count as often as they occur; with fewer than two rows of
either class every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows at most that the classes are fitted on; 16 statistics need far fewer.
FIT_ROWS = 20_000
#: Shrinkage of a class covariance to the pooled one, and of that to its diagonal.
TO_POOLED, TO_DIAGONAL = 0.05, 0.05
#: The log-density difference is divided by this before the logistic, so that scores
#: do not all round to 0 or 1. The sign, and so the prediction, is unchanged.
TEMPER = 8.0

_PUNCT = np.frombuffer(b".,;:'\"()-?", np.uint8)
N_STATS = 16


def _share(k: float, n: float, prior: float = 0.5) -> float:
    """Log-odds of a share, smoothed so that 0 and 1 stay finite."""
    return float(np.log((k + prior) / (max(n - k, 0) + prior)))


def text_stats(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = (text or "").split()
    m = len(words)
    upper, lower, digit = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    space, high = int(c[[9, 10, 13, 32]].sum()), int(c[128:].sum())
    punct = int(c[_PUNCT].sum())
    symbol = n - upper - lower - digit - space - high - punct
    counts = Counter(words)
    top = max(counts.values(), default=0)
    again = sum(map(str.__eq__, words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    letters = upper + lower + high
    return [
        np.log1p(n),
        np.log1p(n / (m + 1.0)),
        np.log1p(m / (len(lines) + 1.0)),
        _share(upper, letters),
        _share(symbol, n),
        _share(c[33], n),
        _share(digit, n),
        _share(punct, n),
        _share(high, n),
        _share(space, n),
        np.log1p(len(counts)) - 0.85 * np.log1p(m),
        _share(top, m),
        _share(again, m),
        _share(max(m - 2, 0) - triples, max(m - 2, 0)),
        _share(len(lines) - len(set(lines)), len(lines)),
        len(zlib.compress(raw, 1)) / (n + 50.0),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def stats_udf(texts: pd.Series) -> pd.Series:
    return texts.map(text_stats)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and constants; None without both classes."""

    prior: float
    centre: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.centre is None:
            return np.full(len(x), self.prior)
        logs = [k - 0.5 * np.square((x - mu) @ f.T).sum(1) for mu, f, k in zip(self.centre, self.factors, self.constants)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPER, -700, 700)))


def fit(stats: DataFrame, label: str = "label", column: str = "stats") -> Discriminant:
    """Fits on rows of a statistics array and a 0/1 label; sums are made in Spark.

    Only the (d + 1)(d + 2) / 2 sums of each class reach the driver, whatever the
    number of rows.
    """
    products = F.flatten(
        F.transform(F.col("x"), lambda a, i: F.transform(F.slice("x", i + 1, F.size("x") - i), lambda b: a * b))
    )
    sums = (
        stats.where(F.col(label).isin(0, 1))
        .select(F.col(label).alias("y"), F.concat(F.array(F.lit(1.0)), F.col(column)).alias("x"))
        .select("y", F.posexplode(products))
        .groupBy("y", "pos")
        .agg(F.sum("col").alias("s"))
        .collect()
    )
    d = N_STATS + 1
    full = np.zeros((2, d, d))
    rows, cols = np.triu_indices(d)
    for r in sums:
        full[r.y, rows[r.pos], cols[r.pos]] = full[r.y, cols[r.pos], rows[r.pos]] = r.s
    n = full[:, 0, 0]
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5)
    mu = full[:, 0, 1:] / n[:, None]
    cov = np.array([full[k, 1:, 1:] / n[k] - np.outer(mu[k], mu[k]) for k in (0, 1)])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d - 1)
    cov = (1 - TO_POOLED) * cov + TO_POOLED * pooled
    lower = np.linalg.cholesky(cov)
    logdet = 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1)
    return Discriminant(float(n[1] / n.sum()), mu, np.linalg.inv(lower), np.log(n / n.sum()) - 0.5 * logdet)


def held_out(doc_id: Column) -> Column:
    """True for the third of documents that labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Discriminant:
    """Fits on labelled rows of ``docs`` that aren't held out, ``FIT_ROWS`` labels at most."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").alias("label"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(FIT_ROWS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    return fit(rows.select("label", stats_udf("text").alias("stats")))


def _density(model: Discriminant):
    @F.pandas_udf("double")
    def density(texts: pd.Series) -> pd.Series:
        x = np.array([text_stats(t) for t in texts], dtype=float).reshape(-1, N_STATS)
        return pd.Series(model.scores(x))

    return density


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    ``labels`` has the id and ``quality``.
    """
    density = _density(_fitted(docs, labels, id_col, text_col))
    return docs.select(
        F.col(id_col),
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        density(text_col).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5, unchanged.

    Each row is judged by itself as it is read, so texts need no shuffle and null or
    repeated ids no care.
    """
    density = _density(_fitted(docs, labels, id_col, text_col))
    return docs.where(density(F.col(text_col)) >= 0.5)


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    read = spark.read.parquet
    return score(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))
