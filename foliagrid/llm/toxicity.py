"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w . x - t_k): one weight for a word at all thresholds, thresholds ascending (McCullagh 1980).
Features are the distinct words of a text and their stems, hashed. The expected severity is the sum of P(grade > k) over k.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import GRAM_SALTS, NOT_LETTER, lean, longs, mix, running, slices, spans

FEATURE_BITS = 20
GRADES = 4
#: Longer words also count by their first bytes, so that forms of a word share a feature.
STEM_BYTES = 4
STEM_SALT = GRAM_SALTS[-2]
#: Labelled documents that the model is fitted on, at most: those with the least hash of doc_id. Of a longer text, the
#: sample has so many features, those with the least hashes (scores read all features of every text).
MOST_LABELLED, MOST_FEATURES = 10_000, 2_048
#: Parts of the sample that are scored by models of the other parts, to find the limit from which documents are rejected.
FOLDS = 3
#: Association with the label, as chi-squared with one degree of freedom (p = 0.000001, as words are many), that makes a
#: word a feature.
LEAST_CHI2 = 24.0
ROUNDS = 400
PENALTY = 0.1
#: Documents of the sample that a word must be in.
LEAST_DOCUMENTS = 3


def word_features(t) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and stems by row, and where each row's begin."""
    row = np.repeat(np.arange(len(t.n_words)), t.n_words)
    stemmed = t.ends - t.starts > STEM_BYTES
    starts = t.starts[stemmed]
    stems = mix(spans(running(t.data), starts, starts + STEM_BYTES) ^ STEM_SALT)
    h = np.concatenate([t.hashes, stems]) >> np.uint64(64 - FEATURE_BITS)
    key = np.unique((np.concatenate([row, row[stemmed]]) << FEATURE_BITS) | h.astype(np.int64))
    return (key & ((1 << FEATURE_BITS) - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(t.n_words) + 1) << FEATURE_BITS)


def least_hashed(features: np.ndarray, most: int = MOST_FEATURES) -> np.ndarray:
    """All of a text's features, or those with the least hashes, sorted."""
    if len(features) <= most:
        return features
    return np.sort(features[np.argsort(mix(features.astype(np.uint64)), kind="stable")[:most]])


def _featurize(batches):
    for batch in batches:
        out = []
        for _, _, t in slices(batch, lower=True, breaks=NOT_LETTER):
            f, ptr = word_features(t)
            out += [least_hashed(f[a:b]) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([digest(x) for x in out], pa.binary()), pa.array([x.tobytes() for x in out], pa.binary())], names=["toxic", "digest", "features"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the penalised likelihood, by gradient steps with per-parameter rates (Adam).

    Thresholds are a first one and positive gaps, so they can't cross.
    """
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    column = np.concatenate([np.zeros(0, np.int64), *features]).astype(np.int64)
    m = n_grades - 1
    p = np.zeros(n_features + m)
    p[n_features] = 1.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    n = max(1, len(features))
    for step in range(1, rounds + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        t = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(row, w[column], minlength=len(features)) if len(column) else np.zeros(len(features))
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        upper, lower = sigmoid(edge[grades + 1] - s), sigmoid(edge[grades] - s)
        mass = np.maximum(upper - lower, 1e-12)
        by_score = upper + lower - 1
        slope_u, slope_l = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        by_t = np.array([slope_u[grades == k].sum() - slope_l[grades == k + 1].sum() for k in range(m)])
        g = np.empty_like(p)
        g[:n_features] = np.bincount(column, by_score[row], minlength=n_features) if len(column) else 0
        g[:n_features] -= penalty * w
        g[n_features] = by_t.sum()
        g[n_features + 1 :] = np.cumsum(by_t[::-1])[::-1][1:] * gaps
        g /= n
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        p = p + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def best_limit(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The limit with the best F0.7 (a clean document lost weighs twice as much as a toxic one kept), in the middle between the
    severities on its sides."""
    order = np.argsort(-severity, kind="stable")
    hits = np.cumsum(toxic[order])
    f = 1.5 * hits / (np.arange(1, len(order) + 1) + 0.5 * toxic.sum())
    between = np.append(np.diff(severity[order]) < 0, True)
    at = int(np.argmax(np.where(between, f, -1)))
    low = severity[order][at + 1] if at + 1 < len(order) else 0.0
    return float((severity[order][at] + low) / 2)


class Model:
    """Weights by hashed word, thresholds, and the severity from which a document is rejected."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, reject_from: float):
        self.weights, self.thresholds, self.reject_from = weights, thresholds, reject_from

    @classmethod
    def fit(cls, features: list[np.ndarray], toxic: np.ndarray, n_grades: int = GRADES) -> "Model":
        """From distinct features and a label 0 or 1 each. The labels know two grades, 0 and some; a toxic document's
        grade is the number of tell-tale words in it, those that over half of the documents with them are toxic for and
        that the label depends on, 1 at least and the highest grade at most.

        Documents with the same words and label count once, so that a copy is no evidence. The rejection limit is the
        middle of the gap between severities at which F0.7 is best, of severities that models of other parts of the sample
        give. Without documents of both labels nothing is toxic.
        """
        once = {(digest(f), int(y)): i for i, (f, y) in enumerate(zip(features, toxic, strict=True))}
        features, toxic = [features[i] for i in once.values()], toxic[list(once.values())]
        model = cls.fit_grades(features, toxic, n_grades)
        if not 0 < toxic.sum() < len(toxic):
            return model
        part = np.array([d[0] for d, _ in once]) % FOLDS  # of a text's digest, so that a text with both labels is in one part
        severity = np.zeros(len(features))
        for fold in range(FOLDS):
            own, rest = np.flatnonzero(part == fold), np.flatnonzero(part != fold)
            other = cls.fit_grades([features[i] for i in rest], toxic[rest], n_grades)
            ptr = np.concatenate([[0], np.cumsum([len(features[i]) for i in own])]).astype(np.int64)
            severity[own] = other.severity(np.concatenate([np.zeros(0, np.int32), *[features[i] for i in own]]), ptr)
        model.reject_from = best_limit(severity, toxic)
        return model

    @classmethod
    def fit_grades(cls, features: list[np.ndarray], toxic: np.ndarray, n_grades: int) -> "Model":
        """Words that the label depends on, grades, weights and thresholds; the limit is out of reach."""
        width = 1 << FEATURE_BITS
        n, n_toxic = len(features), int(toxic.sum())
        if not n_toxic or n_toxic == n:
            return cls(np.zeros(width, np.float32), np.full(n_grades - 1, 50.0), float(n_grades))
        with_all, with_toxic = np.zeros(width, np.int32), np.zeros(width, np.int32)
        for f, y in zip(features, toxic, strict=True):
            with_all[f] += 1  # a document's features are distinct
            if y:
                with_toxic[f] += 1
        some = np.flatnonzero(with_all >= LEAST_DOCUMENTS)
        both, bad = with_all[some].astype(float), with_toxic[some]
        expected = both * n_toxic / n
        spread = expected * (1 - n_toxic / n) * (n - both) / max(1, n - 1)
        chi2 = np.where(spread > 0, (bad - expected) ** 2 / np.maximum(spread, 1e-12), 0)
        chosen = some[chi2 >= LEAST_CHI2]
        telling = bad[chi2 >= LEAST_CHI2] * 2 > both[chi2 >= LEAST_CHI2]
        number = np.full(width, -1, np.int32)
        number[chosen] = np.arange(len(chosen), dtype=np.int32)
        own = [x[x >= 0] for x in (number[f] for f in features)]
        grades = np.array([min(n_grades - 1, max(1, int(telling[f].sum()))) if y else 0 for f, y in zip(own, toxic, strict=True)])
        weights, thresholds = fit_ordinal(own, grades, len(chosen), n_grades)
        out = np.zeros(width, np.float32)
        out[chosen] = weights
        return cls(out, thresholds, float(n_grades))

    def severity(self, features: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Expected grade of each row."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[features], dtype=np.float64)])
        score = total[ptr[1:]] - total[ptr[:-1]]
        return sigmoid(score[:, None] - self.thresholds[None, :]).sum(axis=1)


def digest(features: np.ndarray) -> bytes:
    return hashlib.blake2b(features, digest_size=16).digest()


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model from the documents that labels (doc_id, toxic) names, most of them at most, chosen by hash of doc_id.

    The sample's ids are broadcast (a bounded number); rows of the same words and label count once, and most rows at most
    come to the driver, with MOST_FEATURES features at most. Several labels of a document count as the highest; rows
    without doc_id or label don't count; without documents of both labels nothing is toxic.
    """
    sample = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("toxic", "text").mapInArrow(lean(_featurize), "toxic int, digest binary, features binary")
    rows = rows.groupBy("digest", "toxic").agg(F.first("features").alias("features")).orderBy("digest", "toxic").limit(most).toArrow()
    features = [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("features")]
    toxic = (rows.column("toxic").to_numpy() > 0).astype(np.int64)
    order = sorted(range(len(features)), key=lambda i: (rows.column("digest")[i].as_py(), toxic[i]))  # the same sums in whatever order tasks end
    return Model.fit([features[i] for i in order], toxic[np.array(order, np.int64)])


def _scorer(model):
    def score(batches):
        m = model.value
        for batch in batches:
            found = [m.severity(*word_features(t)) for _, _, t in slices(batch, lower=True, breaks=NOT_LETTER)]
            ids, valid = longs(batch, "doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), pa.array(np.concatenate([np.zeros(0), *found]))], names=["doc_id", "severity"])

    return score


def score(docs: DataFrame, model: Model, reject_from: float | None = None) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), grade (the nearest) and kept (severity below
    reject_from, or the model's own limit).

    A null or empty text has no features and gets the severity of that; repeated rows get the same; other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(lean(_scorer(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, severity double")
    return scored.select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") < (model.reject_from if reject_from is None else reject_from)).alias("kept"))


def _dropper(model, reject_from):
    def drop(batches):
        m = model.value
        for batch in batches:
            found = [m.severity(*word_features(t)) for _, _, t in slices(batch, lower=True, breaks=NOT_LETTER)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *found]) < reject_from))

    return drop


def civil_documents(docs: DataFrame, model: Model, reject_from: float | None = None) -> DataFrame:
    """The documents below reject_from, or the model's own limit, with the columns of docs, without a shuffle.

    A null or empty text has no features and stays unless the limit is below that severity; rows that repeat stay or go
    alike; an empty table gives no rows.
    """
    return docs.mapInArrow(lean(_dropper(docs.sparkSession.sparkContext.broadcast(model), model.reject_from if reject_from is None else reject_from)), docs.schema)
