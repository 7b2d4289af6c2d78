"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. The vector of a trigram binds the
vectors of its letters, each rotated by its place (``rotate(a, 2) * rotate(b, 1) * c``); a
text's vector bundles (sums) the vectors of its trigrams; a language's prototype bundles
all texts of that language. A text gets the language whose prototype has the largest
cosine with it.

Training counts (language, trigram) over all rows it is given, an aggregate that Spark
combines before its shuffle, and bundles the counted trigrams; the sums are integers, so
prototypes do not depend on the order of rows. Only the prototypes reach the driver: one
vector for each language.

Letters are the characters for which ``str.isalpha`` holds, in lower case; every run of
other characters counts as one space, and a text starts and ends with one.

Defined results: a text that is null or has no letter gets ``und`` with score 0, and so
does every text when nothing was learned. Ties go to the language first in order. The
score is the cosine, 0 if negative, rounded to 6 digits. Repeated rows each get their
result; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.llm.common import U64, add_columns, map_batches, mix64, seeds

DIM = 1024
UNKNOWN = "und"
GROUP = 64  # documents whose trigrams are bound together
NOISE = 4 / DIM**0.5  # a text's largest cosine is above, if it is in a learned language
ENOUGH = 32  # trigrams of a text from which on that can be told
PART = 2048  # trigrams whose vectors are held together
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text, 21 bits a letter, and their counts."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    symbol = np.concatenate(([32], np.where(_is_letter()[code], code, 32), [32])).astype(np.int64)
    symbol = symbol[np.concatenate(([True], (symbol[1:] != 32) | (symbol[:-1] != 32)))]
    if len(symbol) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique((symbol[:-2] << 42) | (symbol[1:-1] << 21) | symbol[2:], return_counts=True)


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each letter, the same on every machine."""
    with np.errstate(over="ignore"):
        words = mix64(codes.astype(U64)[:, None] * U64(0x9E3779B97F4A7C15) ^ seeds(DIM // 64)[None, :])
    bits = np.unpackbits(words.view(np.uint8).reshape(len(codes), -1), axis=1)
    return (2 * bits.astype(np.int8) - 1).astype(np.int8)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    low = (1 << 21) - 1
    places = [codes >> 42, (codes >> 21) & low, codes & low]
    letters, at = np.unique(np.concatenate(places), return_inverse=True)
    vector = letter_vectors(letters)
    first, second, third = np.split(at, 3)
    return np.roll(vector, 2, axis=1)[first] * np.roll(vector, 1, axis=1)[second] * vector[third]


def bundles(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The vectors of several texts from their trigram counts; exact integers."""
    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    n = np.concatenate([k for _, k in found])
    kind = np.float32 if n.sum() < 1 << 23 else np.float64
    counts = np.zeros((len(found), len(codes)), kind)
    counts[np.repeat(np.arange(len(found)), [len(c) for c, _ in found]), at] = n
    total = np.zeros((len(found), DIM))
    for a in range(0, len(codes), PART):  # exact sums, in any order
        total += counts[:, a : a + PART] @ trigram_vectors(codes[a : a + PART]).astype(kind)
    return total


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # a unit vector for each language

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.measure(texts)[:2]

    def measure(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Language, score and number of trigrams of each text."""
        names, scores, sizes = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
        if not self.languages:
            return names, scores, sizes
        for start in range(0, len(texts), GROUP):
            found = [trigrams(t) for t in texts[start : start + GROUP]]
            rows = [i for i, (c, _) in enumerate(found) if len(c)]
            if not rows:
                continue
            vectors = bundles([found[i] for i in rows])
            cosine = vectors @ self.prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
            cosine = np.round(cosine, 6)
            for i, best, row in zip(rows, cosine.argmax(axis=1), cosine):
                names[start + i] = self.languages[best]
                scores[start + i] = min(1.0, max(0.0, float(row[best])))
                sizes[start + i] = int(found[i][1].sum())
        return names, scores, sizes


def train(rows: DataFrame) -> Profiles:
    """Profiles from all ``rows``(text, lang) whose text and lang are not null."""

    def counting():
        def apply(texts, langs):
            found: dict[str, list] = {}
            for text, lang in zip(texts.to_pylist(), langs.to_pylist()):
                found.setdefault(lang, []).append(trigrams(text))
            name, code, n = [], [], []
            for lang, parts in found.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                count = np.bincount(at, np.concatenate([k for _, k in parts]), len(codes)).astype(np.int64)
                name += [lang] * len(codes)
                code.append(codes)
                n.append(count)
            join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
            return [name, join(code), join(n)]

        return apply

    def bundling():
        def apply(langs, codes, counts):
            langs, codes, counts = np.array(langs.to_pylist(), object), np.asarray(codes), np.asarray(counts)
            names = sorted(set(langs))
            total = []
            for lang in names:
                at = np.flatnonzero(langs == lang)
                total.append(sum((counts[p] @ trigram_vectors(codes[p]).astype(np.int64)
                                  for p in np.array_split(at, len(at) // PART + 1)), np.zeros(DIM, np.int64)))
            return [names, [v.tolist() for v in total]]

        return apply

    text = lambda *more: T.StructType([T.StructField("lang", T.StringType()), *more])
    long = T.LongType()
    counted = (map_batches(rows.select("text", "lang").where("text is not null and lang is not null"), counting,
                           text(T.StructField("code", long), T.StructField("n", long)))
               .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    parts = map_batches(counted, bundling, text(T.StructField("vector", T.ArrayType(long))))
    sums = (parts.select("lang", F.posexplode("vector").alias("place", "x"))
            .groupBy("lang", "place").agg(F.sum("x").alias("x")))
    vectors: dict[str, np.ndarray] = {}
    for lang, place, x in sums.collect():  # DIM numbers a language
        vectors.setdefault(lang, np.zeros(DIM))[place] = x
    names = sorted(vectors)
    matrix = np.array([vectors[n] for n in names]).reshape(len(names), DIM)
    return Profiles(names, matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-9)[:, None])


def identify(docs: DataFrame, profiles: Profiles, lang: str = "lang_pred", score: str = "score",
             size: str | None = None) -> DataFrame:
    """``docs`` with the predicted language of ``text``, its score and, if named, the number
    of its trigrams."""

    def make():
        def apply(texts):
            return list(profiles.measure(texts.to_pylist()))[: len(fields)]

        return apply

    fields = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    fields += [T.StructField(size, T.LongType())] if size else []
    return add_columns(docs, ["text"], make, fields)


def held_out(doc_id) -> F.Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> Profiles:
    return train(docs.where(~held_out("doc_id")))
