"""Toxicity by non-negative positive-unlabelled learning.

Trained from confirmed toxic documents and unlabelled text. With the class prior p,
the risk of calling unlabelled text clean is corrected by the toxic share in it,
``p R_p(+) + max(0, R_u(-) - p R_p(-))``; where the corrected part turns negative, a
step goes back on it, so that the classifier cannot call all unlabelled text clean
by remembering it. Features are the presence of words and beginnings of words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.llm.sampling import in_batches, sample_ids, with_texts

WORD = re.compile(r"[^\W\d_]+")
BINS = 1 << 21
PREFIXES = (3, 4, 5)
MAX_FEATURES = 2048
CACHED_WORDS = 100_000


class Model(NamedTuple):
    """Weights by feature bin, averaged over the trained classifiers."""

    weights: dict[int, float]
    bias: float


def word_bins(word: str) -> list[int]:
    """Feature bins of a lower-cased word: the word and its beginnings."""
    names = [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(name.encode()) % BINS for name in names]


class _Words(dict):
    """What ``compute`` finds for a word; forgets all when it is full."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, word: str):
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = self.compute(word)
        return found


def _bins_of_documents(docs: DataFrame) -> DataFrame:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(word_bins)
        for batch in batches:
            found = [
                np.array(sorted({b for w in set(WORD.findall((t.as_py() or "").lower())) for b in known[w]}), np.int32)
                for t in batch["text"]
            ]
            columns = [batch["doc_id"], batch["toxic"], pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "bins"])

    source = in_batches(docs).select(F.col("doc_id").cast("bigint"), "toxic", "text")
    return source.mapInArrow(extract, "doc_id bigint, toxic int, bins array<int>")


def train(
    docs: DataFrame,
    labels: DataFrame,
    n_toxic: int = 3000,
    n_unlabelled: int = 9000,
    classifiers: int = 3,
    steps: int = 300,
) -> Model | None:
    """Fit on at most ``n_toxic`` toxic and ``n_unlabelled`` other documents of ``docs``.

    ``labels`` has doc_id and toxic, 0 or 1. Only ``toxic`` = 1 is used as a label;
    the prior is the share of toxic rows in ``labels``, kept between 0.001 and 0.5. Unlabelled documents are a
    sample of all of ``docs``, whose labels, if any, are not looked at. None without a
    toxic document. The samples are picked by a hash of doc_id; a repeated one counts once.
    """
    prior = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    toxic = sample_ids(labels.where("toxic = 1").select("doc_id"), n_toxic).withColumn("toxic", F.lit(1))
    unlabelled = sample_ids(docs.select("doc_id"), n_unlabelled).withColumn("toxic", F.lit(0))
    rows = _bins_of_documents(with_texts(toxic.union(unlabelled), docs)).toArrow()  # n_toxic + n_unlabelled at most
    rows = rows.sort_by([("toxic", "ascending"), ("doc_id", "ascending")])  # the same model however rows are split
    is_toxic = rows["toxic"].to_numpy() == 1
    if not is_toxic.any() or is_toxic.all():
        return None
    bins = rows["bins"].combine_chunks()
    sizes = np.diff(bins.offsets.to_numpy())
    return _fit(bins.values.to_numpy(), sizes, is_toxic, min(max(prior, 1e-3), 0.5), classifiers, steps)


def _fit(
    bins: np.ndarray, sizes: np.ndarray, is_toxic: np.ndarray, prior: float, classifiers: int, steps: int
) -> Model:
    row_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    n_toxic, n_other = is_toxic.sum(), (~is_toxic).sum()
    in_toxic = np.bincount(bins[is_toxic[row_of]], minlength=BINS) / n_toxic
    in_other = np.bincount(bins[~is_toxic[row_of]], minlength=BINS) / n_other
    # how far beyond chance a feature is more common in toxic documents than elsewhere
    spread = np.sqrt((in_other + 1 / n_toxic) * (1 / n_toxic + 1 / n_other))
    # and only where the prior makes it likely that a document with it is toxic
    excess = np.where(prior * in_toxic > 0.4 * in_other, (in_toxic - in_other) / spread, 0)
    features = np.argsort(-excess, kind="stable")[:MAX_FEATURES]
    features = features[excess[features] > 4]
    column_of = np.full(BINS, -1, np.int32)
    column_of[features] = np.arange(len(features))
    known = column_of[bins] >= 0
    rows, columns = row_of[known], column_of[bins[known]]
    fitted = [
        _descend(rows, columns, is_toxic, len(features), prior, steps, np.random.default_rng(seed))
        for seed in range(classifiers)
    ]
    weights = np.mean([w for w, _ in fitted], axis=0)
    return Model(dict(zip(features.tolist(), weights.tolist())), float(np.mean([b for _, b in fitted])))


def estimated_risk(
    z: np.ndarray, share: np.ndarray, is_toxic: np.ndarray, prior: float
) -> tuple[float, float, np.ndarray]:
    """The risk of calling toxic text clean, that of the reverse (corrected), and how to change the outputs ``z``.

    The last is the slope of their sum or, where the corrected part is negative, of
    that part with its sign changed. ``share`` is the weight of each document in its kind.
    """
    called = 1 / (1 + np.exp(-z))
    risk_other = np.logaddexp(0, z) * share  # of calling a document toxic
    corrected = risk_other[~is_toxic].sum() - prior * risk_other[is_toxic].sum()
    missed = prior * (np.logaddexp(0, -z) * share)[is_toxic].sum()
    slope_clean = np.where(is_toxic, -prior, 1.0) * called * share
    slope_toxic = np.where(is_toxic, prior * (called - 1), 0.0) * share
    return missed, corrected, slope_toxic + slope_clean if corrected >= 0 else -slope_clean


def _descend(rows, columns, is_toxic, n_features, prior, steps, rng, rate=0.1, decay=1e-3):
    """One classifier on a bootstrap of the documents: logistic loss, Adam."""
    copies = np.zeros(len(is_toxic))
    for kind in (is_toxic, ~is_toxic):
        members = np.flatnonzero(kind)
        copies += np.bincount(rng.choice(members, len(members)), minlength=len(copies))
    share = np.where(is_toxic, copies / is_toxic.sum(), copies / (~is_toxic).sum())
    theta = np.zeros(n_features + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(rows, theta[columns], minlength=len(is_toxic))
        _, _, slope = estimated_risk(z, share, is_toxic, prior)
        gradient = np.append(np.bincount(columns, slope[rows], minlength=n_features), slope.sum())
        gradient[:-1] += decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= rate / (1 + step / 100) * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], theta[-1]


class _Scorer:
    """Scores of texts under a model."""

    def __init__(self, model: Model):
        self.weights, self.bias = model
        self.known = _Words(lambda word: tuple(b for b in word_bins(word) if b in self.weights))

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = set(WORD.findall((text.as_py() or "").lower()))
            z[i] = self.bias + sum(self.weights[b] for b in sorted({b for w in words for b in self.known[w]}))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5) of each whole text.

    A missing text is empty and scored as such; without a model every score is 0.
    Repeated rows are repeated, other columns ignored. The model is at most
    ``MAX_FEATURES`` weights.
    """
    if model is None:
        scored = docs.select(F.col("doc_id").cast("bigint"), F.lit(0.0).alias("score"))
        return scored.withColumn("predicted", F.lit(0))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            scores = pa.array(scorer.scores(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], scores], ["doc_id", "score"])

    scored = in_batches(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(apply, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below 0.5; all without a model."""
    if model is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch["text"]) < 0.5))

    return in_batches(docs).mapInArrow(keep, docs.schema)
