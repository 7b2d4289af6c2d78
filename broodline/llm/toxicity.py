"""Toxicity severity by cumulative-link ordinal regression.

``labels`` say whether a text is toxic; how severely follows from how much of the learned
toxic vocabulary it uses: grade 0 is not toxic, 1 toxic, and each number of distinct
vocabulary words in ``GRADES`` that a toxic text reaches raises its grade by one. The model is
P(grade <= k) = sigmoid(t_k - w.x) with one weight vector w for all thresholds
t_0 <= t_1 <= ... and x the distinct words of the text (lower-cased runs of letters) that
are in the vocabulary. The expected severity is the sum over k of P(grade > k), from 0 to
``len(GRADES) + 1``.

Training uses a bounded sample of labelled rows, ``MAX_ROWS`` in expectation, chosen by a
hash of doc_id. Copies of a text would make all its words look toxic, so of sampled texts
that agree in their least or in their largest 2-word shingle hash one is used. The
vocabulary is the words of the sample in at least ``MIN_DOCS`` documents whose share of
toxic documents is clearly above the rest (a 2 x 2 chi-square of ``MIN_CHI``), at most
``MAX_WORDS``. Weights have a Gaussian prior of variance ``SPREAD``, so a word seen in a few
documents only gets a small weight, and are fitted by accelerated gradient steps. Prediction
covers all rows of whole texts.

Defined results: a null or empty text has no features and gets the intercept's result.
Labels with a null doc_id or toxic are left out; of several labels of one document the
toxic one counts. Without labels of both kinds the severity is 0 for every text.
Repeated rows each get their result; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.llm.common import add_columns, fresh, map_batches
from broodline.llm.minhash import shingle_hashes
from broodline.session import stage

MAX_ROWS = 20_000  # bound of the training sample, in expectation
MAX_WORDS = 2_000
MIN_DOCS = 5
MIN_CHI = 20.0
SPREAD = 30.0  # variance of the prior of a weight
GRADES = (4, 7)  # distinct vocabulary words from which a toxic text has the next grade
LIMIT = 0.5  # chance of toxicity from which a text counts as toxic
_WORDS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


@dataclass(frozen=True)
class SeverityModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def predict(self, texts: list[str | None]) -> tuple[list[float], list[float]]:
        """Expected severity and the probability of any toxicity, for each text."""
        known = self.weights.keys()
        score = np.array([sum(self.weights[w] for w in sorted(words_of(t) & known)) for t in texts], float)
        if not self.thresholds:
            return [0.0] * len(texts), [0.0] * len(texts)
        above = 1 / (1 + np.exp(np.array(self.thresholds)[None, :] - score[:, None]))
        return np.round(above.sum(axis=1), 6).tolist(), np.round(above[:, 0], 6).tolist()


def fit(rows: list[tuple[int, list[int]]], n_words: int, spread: float = SPREAD,
        steps: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from (grade, word numbers) rows: the most probable ones, by
    accelerated gradient steps on the mean negative log-likelihood and the prior."""
    counted = Counter((g, tuple(w)) for g, w in rows)
    grade = np.array([g for g, _ in counted])
    n = np.array(list(counted.values()), float) / len(rows)
    levels = int(grade.max())
    length = np.array([len(w) for _, w in counted])
    row = np.repeat(np.arange(len(grade)), length)
    word = np.concatenate([np.asarray(w, int) for _, w in counted])
    share = np.array([n[grade <= k].sum() for k in range(levels)]).clip(1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    w, ridge = np.zeros(n_words), 1 / (spread * len(rows))
    theta_y, w_y, pace = theta.copy(), w.copy(), 1.0
    rate = 1.0 / (0.5 * (1 + length.max(initial=1)) + ridge)
    sigmoid = lambda z: 1 / (1 + np.exp(-z.clip(-40, 40)))
    for _ in range(steps):
        score = np.bincount(row, w_y[word], len(grade))
        upper = np.where(grade < levels, sigmoid(theta_y[np.minimum(grade, levels - 1)] - score), 1.0)
        lower = np.where(grade > 0, sigmoid(theta_y[np.maximum(grade - 1, 0)] - score), 0.0)
        chance = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = n * upper * (1 - upper) / chance, n * lower * (1 - lower) / chance
        d_theta = np.array([d_lower[grade == k + 1].sum() - d_upper[grade == k].sum() for k in range(levels)])
        w_new = w_y - rate * (np.bincount(word, (d_upper - d_lower)[row], n_words) + ridge * w_y)
        theta_new = np.maximum.accumulate(theta_y - rate * d_theta)
        pace_new = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        w_y = w_new + (pace - 1) / pace_new * (w_new - w)
        theta_y = np.maximum.accumulate(theta_new + (pace - 1) / pace_new * (theta_new - theta))
        w, theta, pace = w_new, theta_new, pace_new
    return w, theta


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> SeverityModel:
    spark = docs.sparkSession
    grades = (labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null")
              .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")))
    n = grades.count()
    chosen = grades.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1, max_rows / max(n, 1))))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows small rows

    def make():
        def apply(toxic, text):
            text = text.to_pylist()
            hashes = [shingle_hashes(t, 2) for t in text]
            return [toxic, [sorted(words_of(t)) for t in text],
                    [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in hashes]]

        return apply

    sample = map_batches(texts.select("toxic", "text"), make, T.StructType([
        T.StructField("toxic", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("digest", T.BinaryType())])).where("digest is not null")
    # texts of the same set of 2-word shingles are copies; a text of its own is never dropped
    sample = sample.groupBy("digest").agg(F.min(F.struct("toxic", "words")).alias("first")).select("first.*")
    sample = stage(sample.select("toxic", "words"))
    total, bad = sample.select(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not bad or bad == total:
        return SeverityModel()
    a, m = F.col("toxic_docs"), F.col("docs")
    chi = (F.lit(float(total)) * F.pow(a * F.lit(float(total - bad)) - (m - a) * F.lit(float(bad)), F.lit(2))
           / (m * (F.lit(float(total)) - m) * F.lit(float(bad)) * F.lit(float(total - bad))))
    vocabulary = (sample.select("toxic", F.explode("words").alias("word")).groupBy("word")
                  .agg(F.count("*").alias("docs"), F.count_if(F.col("toxic") == 1).alias("toxic_docs"))
                  .where((F.col("docs") >= MIN_DOCS) & (a * total > m * bad)).withColumn("chi", chi)
                  .where(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "word").limit(MAX_WORDS)
                  .select("word").collect())
    number = {w: i for i, w in enumerate(sorted(r[0] for r in vocabulary))}
    known = sample.select("toxic", F.array_intersect("words", F.array(*map(F.lit, number)).cast("array<string>")).alias("words"))
    rows = sorted((toxic * (1 + sum(len(words) >= n for n in GRADES)), sorted(number[w] for w in words))
                  for toxic, words in known.collect())  # MAX_ROWS short rows
    weights, thresholds = fit(rows, len(number))
    return SeverityModel({w: float(x) for w, x in zip(number, weights)}, tuple(map(float, thresholds)))


def severity(docs: DataFrame, model: SeverityModel, expected: str = "severity", chance: str = "p_toxic") -> DataFrame:
    """``docs`` with the expected severity of ``text`` and the chance of any toxicity."""

    def make():
        def apply(texts):
            return list(model.predict(texts.to_pylist()))

        return apply

    return add_columns(docs, ["text"], make, [T.StructField(expected, T.DoubleType()), T.StructField(chance, T.DoubleType())])


def clean(docs: DataFrame, model: SeverityModel, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` whose chance of toxicity is below ``limit``."""
    expected, chance = fresh(docs, "severity"), fresh(docs, "p_toxic")
    return severity(docs, model, expected, chance).where(F.col(chance) < limit).drop(expected, chance)
