"""Quality classifier: regularised quadratic discriminant over transformed statistics of a document's whole text.

Each class has its mean and a covariance that is shrunk towards the pooled one and its diagonal; a document's score is the posterior
from the difference of the two log densities, by Mahalanobis distances with Cholesky factors that are computed once.
Counts, sums and products come from all labelled rows (no sample), added up on the executors; the driver gets one matrix a class.

Only the text is an input of a score. Defined results: null and empty texts have the statistics of no words and a score like others;
rows without a label, or without an id, are scored only; repeated rows score alike and count each with their label; repeated labels count each; a class without rows leaves the prior of the other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod5, drop_stash, stash, text_views
from .decontaminate import words

THRESHOLD = 0.3
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWERCASE, _UPPERCASE, _DIGIT, _HIGH = (np.zeros(256, bool) for _ in range(4))
_LOWERCASE[97:123] = _UPPERCASE[65:91] = _DIGIT[48:58] = _HIGH[128:] = True
_STOP, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?'\"-()"]] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK &= ~_STOP
_LINE = np.zeros(256, bool)
_LINE[10] = True
FEATURES = (
    "word_length", "uppercase", "digits", "stops", "marks", "beyond_ascii", "lines", "distinct", "repeats", "capitals", "marked_words", "worst_marks", "worst_uppercase", "worst_repeats",
)
#: Part of a document that the worst_ statistics look at: so many words.
SPAN = 32
#: Words without anything odd that are added to each document, so that short ones don't stand out by chance.
SMOOTH = 10


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x FEATURES: logarithms of counts, and of shares moved off zero."""
    n_docs, size = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    hashes, bounds, starts = words(data, offsets, ~_SPACE)
    n_words = np.diff(bounds)
    doc_of = np.repeat(np.arange(n_docs), n_words)
    ends = np.empty(len(starts), np.int64)  # a word's share of bytes runs to the next word
    if len(starts):
        ends[:-1] = starts[1:]
        ends[-1] = len(data)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask[data], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)

    def per_doc(v: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of, v, n_docs)

    upper, mark, high = per_word(_UPPERCASE), per_word(_MARK), per_word(_HIGH)
    lower, digit, stop, line = per_word(_LOWERCASE), per_word(_DIGIT), per_word(_STOP), per_word(_LINE)
    same = np.zeros(len(starts))
    if len(starts) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc_of[1:] == doc_of[:-1])
    key = np.sort((doc_of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n_docs)[:n_docs].astype(np.float64)
    marked, capital = (mark > 0).astype(float), ((upper >= 2) & (lower == 0)).astype(float)
    # the worst span of SPAN words of each document
    place = np.arange(len(starts)) - np.repeat(bounds[:-1], n_words)
    spans = (n_words + SPAN - 1) // SPAN
    span_of = np.repeat(np.cumsum(spans) - spans, n_words) + place // SPAN
    in_span = np.bincount(span_of, minlength=int(spans.sum()))

    def worst(v: np.ndarray) -> np.ndarray:
        share = np.bincount(span_of, v, int(spans.sum())) / np.maximum(in_span, 8)
        out = np.zeros(n_docs)
        np.maximum.at(out, np.repeat(np.arange(n_docs), spans), share)
        return out

    w, b = np.maximum(n_words, 1), np.maximum(size, 1)
    share = lambda v, of, least=1e-3: np.log(v / (of + SMOOTH) + least)
    letters = np.maximum(per_doc(upper + lower + high), 1)
    return np.stack([
        np.log((b + 6 * SMOOTH) / (w + SMOOTH)), share(per_doc(upper), letters), share(per_doc(digit), b), share(per_doc(stop), w, 1e-2), share(per_doc(mark), w), share(per_doc(high), letters, 1e-2), share(per_doc(line), w),
        np.log((distinct + SMOOTH) / (w + SMOOTH)), share(per_doc(same), w), share(per_doc(capital), w), share(per_doc(marked), w), np.log(worst(marked) + 1e-2), np.log(worst(capital) + 1e-2), np.log(worst(same) + 1e-2),
    ], 1)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, features array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_views(batch):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, features array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log priors less half the log determinants, by class."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(rows: DataFrame, pooled: float = 0.1, diagonal: float = 0.02) -> Discriminant:
    """rows: features, label 0 or 1. Moments are summed over all rows; shrinkage by the two parameters."""
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (d + 1) ** 2))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            for k in (0, 1):
                total[k] += (x[y == k].T @ x[y == k]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], (d + 1) ** 2), pa.int32()), pa.array(np.tile(np.arange((d + 1) ** 2), 2), pa.int32()), pa.array(total.ravel())], names=["label", "cell", "v"])

    total = np.zeros((2, (d + 1) ** 2))
    for r in rows.select("features", F.col("label").cast("int")).mapInArrow(moments, "label int, cell int, v double").groupBy("label", "cell").agg(F.sum("v").alias("v")).collect():
        total[r["label"], r["cell"]] = r["v"]
    m = total.reshape(2, d + 1, d + 1)
    n = m[:, d, d]
    mean = m[:, d, :d] / np.maximum(n, 1)[:, None]
    scatter = m[:, :d, :d] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    common = scatter.sum(0) / max(n.sum() - 2, 1)
    means, factors, constants = np.empty((2, d)), np.empty((2, d, d)), np.empty(2)
    for k in (0, 1):
        own = scatter[k] / max(n[k] - 1, 1) if n[k] > 1 else common
        cov = (1 - pooled) * own + pooled * common
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means[k] = mean[k] if n[k] else mean[1 - k]
        factors[k] = np.linalg.inv(factor)
        constants[k] = np.log((n[k] + 0.5) / (n.sum() + 1)) - np.log(np.diag(factor)).sum()
    return Discriminant(means, factors, constants)


def train(feats: DataFrame, labels: DataFrame) -> Discriminant:
    """From the labelled rows whose fold is not 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).filter("label in (0, 1)")
    return fit(feats.filter(crc32_mod5(F.col("doc_id")) != 0).join(known, "doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    feats = stash(features(docs), "features")
    model = train(feats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))))], names=["doc_id", "score"])

    scored = feats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc32_mod5(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold. Nothing but statistics is shuffled. Each row is judged for
    itself, so repeated rows, rows without an id and null texts (empty) stay or go by their score; an empty table stays empty."""
    feats = stash(features(docs), "features")
    model = train(feats, labels)
    drop_stash(feats)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_views(batch, batch.schema.names[at]):
                good = model.score(statistics(data, offsets)) >= threshold
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
