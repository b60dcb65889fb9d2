"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams hashed into a fixed number of
buckets. Document frequencies are counted over all training rows in Spark. The
weights are trained with follow-the-regularised-leader (proximal) and an
elastic-net penalty on a bounded sample of labelled rows (``sample_rows``); a
part of that sample is held back to fit the temperature of the scores.
Predictions read whole texts and nothing but the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texweave.llm.common import trim, trimmed

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    sizes: tuple[int, ...] = (1, 2, 3)
    #: Bound of the labelled rows that weights are fitted on.
    sample_rows: int = 3000
    #: Share of those held back for the temperature.
    calibration: float = 0.2
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-2


@dataclass(frozen=True)
class Model:
    """Bounded by ``buckets`` times the number of languages."""

    languages: tuple[str, ...]
    weights: np.ndarray  # languages x buckets
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    settings: Settings


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter; beyond the basic plane all count as such after a check of the text."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)] + [True])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_counts(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with their counts of all character n-grams; runs of non-letters are one space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[np.minimum(codes, 0x10000)], codes, np.uint32(32))
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint64)
    total = np.zeros(settings.buckets, np.int64)
    for size in settings.sizes:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        keys = np.full(n, size, np.uint64)
        for k in range(size):
            keys = (keys + codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(31)
        total += np.bincount((keys % np.uint64(settings.buckets)).astype(np.int64), minlength=settings.buckets)
    found = np.flatnonzero(total)
    return found, total[found]


def tfidf(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts
    value = (1.0 + np.log(n)) * idf[at]
    norm = float(np.sqrt((value * value).sum()))
    return at, value / norm if norm else value


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias."""
    z = np.zeros((n_labels, s.buckets + 1))
    g2 = np.zeros((n_labels, s.buckets + 1))

    def weight(z_at: np.ndarray, g2_at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z_at) * np.maximum(np.abs(z_at) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(g2_at)) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for (at, value), label in zip(rows, labels):
            at, value = np.append(at, s.buckets), np.append(value, 1.0)
            z_at, g2_at = z[:, at], g2[:, at]
            w = weight(z_at, g2_at)
            error = softmax(w @ value)
            error[label] -= 1.0
            g = error[:, None] * value
            sigma = (np.sqrt(g2_at + g * g) - np.sqrt(g2_at)) / s.alpha
            z[:, at] = z_at + g - sigma * w
            g2[:, at] = g2_at + g * g
    w = weight(z, g2)
    return w[:, :-1], w[:, -1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search.

    Targets are smoothed by one case in n + 2, else a sample without an error
    would ask for a temperature of nought.
    """
    n, n_labels = logits.shape
    if not n or n_labels < 2:
        return 1.0
    target = np.full((n, n_labels), 1.0 / (n + 2) / (n_labels - 1))
    target[np.arange(n), labels] = 1.0 - 1.0 / (n + 2)

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (target * z).sum(axis=1)).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from ``rows`` with ``text`` and ``lang``; rows without either, or without a letter, are no use and skipped.

    With no usable row the model has no language and predicts ``und`` only.
    """
    labelled = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")

    @trimmed
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(settings.buckets, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                df[ngram_counts(value.as_py(), settings)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], names=["bucket", "n"])

    counted = labelled.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # buckets + 1 rows at most
    df = np.zeros(settings.buckets)
    inside = counted[counted.bucket >= 0]
    df[inside.bucket.to_numpy(np.int64)] = inside.n
    total = float(counted.n[counted.bucket < 0].sum())
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    # The rows of the smallest hashes are the sample; equal rows count once.
    hashed = labelled.withColumn("h", F.xxhash64("text", "lang"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(settings.sample_rows).agg(F.max("h")).first()[0]
    if chosen is None:
        return Model((), np.zeros((0, settings.buckets)), np.zeros(0), idf, 1.0, settings)

    @trimmed
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(x.as_py(), settings) if has_letter(x.as_py()) else (np.empty(0, np.int64),) * 2 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["h", "lang", "at", "n"])

    sample = (
        hashed.filter(F.col("h") <= chosen)
        .select("h", "lang", "text")
        .mapInArrow(features, "h long, lang string, at array<long>, n array<long>")
        .groupBy("h")
        .agg(*(F.first(c).alias(c) for c in ("lang", "at", "n")))
        .toPandas()  # sample_rows rows at most, each bounded by the buckets
    )
    sample = sample[sample["at"].map(len) > 0].sort_values("h", ignore_index=True)
    languages = tuple(sorted(sample.lang.unique()))
    labels = sample.lang.map({x: k for k, x in enumerate(languages)}).to_numpy(np.int64)
    x = [tfidf((np.asarray(a, np.int64), np.asarray(n, np.int64)), idf) for a, n in zip(sample["at"], sample.n)]
    back = int(len(x) * settings.calibration)
    weights, bias = ftrl(x[back:], labels[back:], len(languages), settings)
    logits = np.array([weights[:, at] @ value + bias for at, value in x[:back]]).reshape(back, len(languages))
    return Model(languages, weights, bias, idf, fit_temperature(logits, labels[:back]), settings)


def predict_text(model: Model, text: str | None) -> tuple[str, float]:
    """The language and its calibrated probability; ``und`` and 0 for null or letterless text."""
    if not text or not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    at, value = tfidf(ngram_counts(text, model.settings), model.idf)
    p = softmax((model.weights[:, at] @ value + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text`` of every row with ``lang_pred`` and ``score``; one pass, no shuffle.

    The model (bounded) is broadcast. Null, empty and letterless texts get
    ``und`` and 0; repeated rows are predicted each; ties go to the first
    language by name; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            yield pd.DataFrame([predict_text(shared.value, x) for x in text], columns=["lang_pred", "score"])
        trim()

    return docs.withColumn("_language", language(F.col("text").cast("string")))


def held_out(doc_id: Column) -> Column:
    """Whether the row's fold (crc32 of the id as text, mod 4) is the test fold; null ids are not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, learned from the rows outside the test fold."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), settings)
    return predict(docs.select("doc_id", "text"), model).select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "_language.lang_pred", "_language.score")


def keep(docs: DataFrame, least: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more, columns unchanged."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), settings)
    judged = predict(docs, model)
    return judged.filter((F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.score") >= least)).drop("_language")
