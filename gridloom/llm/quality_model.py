"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has a mean and a covariance, shrunk towards the covariance of all and towards
a multiple of the identity. A score is the logistic of the difference of the two Mahalanobis log-densities
and of the logs of the classes' shares, with each Cholesky factor inverted once, on the driver.
Statistics, moments and scores are Spark expressions; what comes to the driver is one row of
moments a class.

Defined results: null or empty text has defined statistics, and so a score. Labels that are null,
or neither 0 nor 1, are not learnt from; without labels of both classes the score is the share of class 1
(0.5 without any label). A document with several label rows counts once for each. Repeated rows are scored alike, and equal scores
stand side by side, in no order; an empty table gives an empty one. A very long text is measured whole. Other columns are no inputs and pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, all_stop_words, fresh, let, split_words, written

SHRINK_POOLED, SHRINK_IDENTITY = 0.1, 0.02
KEEP_AT = 0.7
#: The log-density difference is divided by this before the logistic, as its inputs are not independent.
TEMPER = 4.0
#: Words of plain prose that every text is taken to have besides its own.
PSEUDO = 30


def statistics(text: Column) -> Column:
    """array<double> of transformed statistics of a text."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        return let(split_words(t), lambda w: let(lines, lambda n: from_parts(t, w, n)))

    def from_parts(t: Column, w: Column, lines: Column) -> Column:
        # pseudo-counts pull the shares of short texts towards those of plain prose
        words, chars = F.size(w) + float(PSEUDO), F.length(t) + 6.0 * PSEUDO
        n_lines = F.size(lines) + PSEUDO / 5.0
        share = lambda n, d: F.sqrt(F.least(n / d, F.lit(4.0)))
        stop = F.size(F.filter(w, lambda x: x.isin(all_stop_words())))
        return F.array(
            F.log(words),
            F.log(chars / words),
            share(F.regexp_count(t, F.lit(r"[#*$%&|<>@\^~=+{}\[\]\\]")), words),
            share(F.regexp_count(t, F.lit(r"[!?]")), words),
            share(F.regexp_count(t, F.lit("[A-Z]")) + 0.15 * PSEUDO, chars),
            share(F.regexp_count(t, F.lit("[0-9]")), chars),
            (F.size(F.array_distinct(w)) + 0.8 * PSEUDO) / words,
            F.sqrt((stop + 0.25 * PSEUDO) / words),
            (F.size(F.array_distinct(lines)) + PSEUDO / 5.0) / n_lines,
            F.log(words / n_lines),
        )

    return let(F.coalesce(text, F.lit("")), of)


DIMENSIONS = 10


@dataclass(frozen=True)
class Model:
    share: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    inverse_factors: tuple[np.ndarray, np.ndarray] | None = None
    log_dets: tuple[float, float] | None = None

    def score(self, x: Column) -> Column:
        """0 to 1, from the statistics."""
        if self.means is None:
            return F.lit(self.share)
        dens = [self._log_density(x, k) for k in (0, 1)]
        odds = (dens[1] - dens[0]) / TEMPER + float(np.log(self.share / (1 - self.share)))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))

    def _log_density(self, x: Column, k: int) -> Column:
        total = F.lit(self.log_dets[k])
        for row in self.inverse_factors[k]:
            z = F.lit(float(-row @ self.means[k]))
            for j in np.nonzero(row)[0]:
                z = z + F.get(x, F.lit(int(j))) * float(row[j])
            total = total - z * z / 2
        return total


def fit(labelled: DataFrame) -> Model:
    """From rows of (x, label): counts, sums and products of each class in one aggregation."""
    d = range(DIMENSIONS)
    x = lambda i: F.get("x", F.lit(i))
    pairs = [(i, j) for i in d for j in d if j <= i]
    rows = labelled.where(F.col("label").isin(0, 1)).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(x(i)) for i in d]).alias("s"),
        F.array(*[F.sum(x(i) * x(j)) for i, j in pairs]).alias("p"),
    ).collect()
    by = {r["label"]: r for r in rows}
    n = {k: by[k]["n"] if k in by else 0 for k in (0, 1)}
    if not n[0] or not n[1]:
        return Model(n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5)
    means, scatters = [], []
    for k in (0, 1):
        m = np.array(by[k]["s"]) / n[k]
        c = np.zeros((DIMENSIONS, DIMENSIONS))
        for (i, j), v in zip(pairs, by[k]["p"], strict=True):
            c[i, j] = c[j, i] = v / n[k] - m[i] * m[j]
        means.append(m)
        scatters.append(c)
    pooled = (n[0] * scatters[0] + n[1] * scatters[1]) / (n[0] + n[1])
    scale = np.maximum(np.diag(pooled), 1e-6)
    inverses, dets = [], []
    for c in scatters:
        s = (1 - SHRINK_POOLED) * c + SHRINK_POOLED * pooled
        s = (1 - SHRINK_IDENTITY) * s + SHRINK_IDENTITY * np.diag(scale) + 1e-6 * np.eye(DIMENSIONS)
        factor = np.linalg.cholesky(s)
        inverses.append(np.linalg.inv(factor))
        dets.append(float(-np.log(np.diag(factor)).sum()))
    return Model(n[1] / (n[0] + n[1]), tuple(means), tuple(inverses), tuple(dets))


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _usable(labels: DataFrame) -> DataFrame:
    own = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("label"))
    return own.where(F.col("label").isNotNull() & ~held_out(F.col("__id")))


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    own = _usable(labels)
    return stats.join(own, stats["doc_id"] == own["__id"]).select("x", "label")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From the texts with labels that may be learnt from; only these are measured where so few ids can be broadcast."""
    rows = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    ids = _usable(labels).select("__id").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(ids), rows["doc_id"] == ids["__id"], "left_semi")
    return fit(_labelled(rows.select("doc_id", statistics(F.col("text")).alias("x")), labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score KEEP_AT or more."""
    return docs.where(let(statistics(F.col("text")), train(docs, labels).score) >= KEEP_AT)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `quality_score` (underscores appended if docs has one already)."""
    return docs.withColumn(fresh(docs, "quality_score")[0], let(statistics(F.col("text")), train(docs, labels).score))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = written(docs.select("doc_id", statistics(F.col("text")).alias("x")), "statistics")
    score = fit(_labelled(stats, labels)).score(F.col("x"))
    rows = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))
