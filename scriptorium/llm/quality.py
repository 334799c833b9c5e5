"""A quality classifier learned from positives and unlabelled text.

Trusted positives are rows labelled 1; unlabelled text is any row that may be learned from, whatever
its label. A linear model minimises the non-negative unbiased risk (Kiryo et al., 2017): with class
prior ``p``, risk = p E_P[l(z)] + max(0, E_U[l(-z)] - p E_P[l(-z)]), l the logistic loss; where the
second term falls below zero, the step goes up its gradient instead. The prior is estimated from
positives and unlabelled rows alone (1/2 where there are fewer than four), no label 0 is read: a model fitted on one half of them scores the
other half, and of all thresholds the one is taken whose ratio of unlabelled to positive rows above it
is smallest with a margin for chance (best bin estimation, Garg et al., 2021); then the halves change
places, and the mean of both counts. A prior may also be given.

Features are of the whole text: shares of pairs of neighbouring byte classes, and shares that tell of
repetition (distinct words, the most frequent word, equal neighbours, distinct runs of three words,
distinct lines), lengths of words and lines and of the text, and how all of it compresses, block by block. Source,
language, identifier and labels are never features.

The fit takes at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` rows, those with the smallest
hash of their identifier (ties: the smallest identifier; of rows that share one, those whose features
come first), so the sample is bounded at every size; everything else covers all rows. An identifier
with both labels is a positive. Texts of any length are read whole, in time that grows with it.
Null and empty texts have the same, defined features and get a score like any other. Rows that repeat
an identifier get equal scores if their texts are equal. Where there is no positive to learn from,
every score is 0.5. A null identifier is not learned from. Empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, ship, text_of

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 8_000
BLOCK = 4096

_CLASSES = ["\t\r\x0b\x0c ", "\n", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", ".", ",;:", "!?", "\"'()[]", "-_/", "|", "$%&#*@+=~^", "<>{}\\`"]
_OTHER = len(_CLASSES)  # control characters and bytes of other characters
N_CLASSES = _OTHER + 1
_LUT = np.full(256, _OTHER, np.uint8)
for _i, _c in enumerate(_CLASSES):
    _LUT[np.frombuffer(_c.encode(), np.uint8)] = _i
N_FEATURES = N_CLASSES * N_CLASSES + 14


def features(text: str) -> np.ndarray:
    """Features of a text, float32."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES, np.float32)
    if raw:
        c = _LUT[np.frombuffer(raw, np.uint8)].astype(np.uint16)
        pairs = np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_CLASSES * N_CLASSES)
        out[: N_CLASSES * N_CLASSES] = np.sqrt(pairs / len(raw))
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    rest = out[N_CLASSES * N_CLASSES :]
    rest[0] = np.log1p(len(raw)) / 10
    if n:
        counts = Counter(words)
        rest[1] = len(counts) / n
        rest[2] = len(counts) / n**0.7
        rest[3] = max(counts.values()) / n
        rest[4] = sum(map(str.__eq__, words, words[1:])) / n
        rest[5] = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
        rest[6] = min(1.0, len(raw) / n / 20)
        rest[7] = 1 / n**0.5
        rest[8] = sum(map(str.isupper, words)) / n
        rest[9] = sum(map(str.islower, words)) / n
        rest[10] = sum(map(str.isalpha, words)) / n
    if lines:
        rest[11] = len(set(lines)) / len(lines)
        rest[12] = min(1.0, len(text) / len(lines) / 500)
        rest[13] = sum(len(zlib.compress(raw[lo : lo + BLOCK], 1)) for lo in range(0, len(raw), BLOCK)) / len(raw)
    return out


@dataclass(frozen=True)
class Model:
    """A linear model of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.clip(-40, 40)))


def gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Where to step down from: the gradient of the risk, or, where its second term is below zero, of minus that term."""
    zp, zu = p @ w, u @ w
    sig = lambda z: 1 / (1 + np.exp(-z.clip(-40, 40)))
    up = -prior * (p.T @ sig(-zp)) / len(p)  # of p E_P[l(z)]
    down = (u.T @ sig(zu)) / len(u) - prior * (p.T @ sig(zp)) / len(p)
    return up + down if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0 else -down


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 300, rate: float = 0.03, l2: float = 1e-3) -> Model:
    """Minimise the non-negative risk by Adam over whole batches."""
    mean, scale = unl.mean(0), unl.std(0) + 1e-3
    p, u = (((x - mean) / scale).clip(-8, 8).astype(np.float32) for x in (pos, unl))
    w, b = np.zeros(p.shape[1] + 1, np.float32), np.float32(1e-8)
    m, v = np.zeros_like(w), np.zeros_like(w)
    p, u = (np.c_[x, np.ones(len(x), np.float32)] for x in (p, u))
    for t in range(1, steps + 1):
        g = gradient(w, p, u, prior)
        g = (g + l2 * np.r_[w[:-1], 0]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + b)
    return Model(mean, scale, w[:-1].astype(np.float32), float(w[-1]), prior)


def risk(model: Model, pos: np.ndarray, unl: np.ndarray) -> float:
    """The non-negative risk of a model, without the ridge."""
    z = lambda x: ((x - model.mean) / model.scale).clip(-8, 8) @ model.weights + model.bias
    up, down = np.logaddexp(0, -z(pos)).mean(), np.logaddexp(0, z(unl)).mean() - model.prior * np.logaddexp(0, z(pos)).mean()
    return float(model.prior * up + max(0.0, down))


def class_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1, margin: float = 0.01) -> float:
    """The share of positives among unlabelled rows, from these and positives alone; rows in random order."""
    if min(len(pos), len(unl)) < 4:
        return 0.5
    found = []
    for k in (0, 1):
        model = fit_nnpu(pos[k::2], unl[k::2], 0.5)
        p, u = np.sort(model.score(pos[1 - k :: 2])), np.sort(model.score(unl[1 - k :: 2]))
        at = np.unique(p)
        above = lambda x: 1 - np.searchsorted(x, at) / len(x)  # noqa: E731, B023
        qp, qu = above(p), above(u)
        chance = np.sqrt(np.log(4 / delta) / (2 * len(u))) + np.sqrt(np.log(4 / delta) / (2 * len(p)))
        best = int(np.argmin((qu + (1 + margin) * chance) / qp))
        found.append(qu[best] / qp[best])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def may_learn(id_col: str = "doc_id", folds: int = 3, held: int = 1) -> Column:
    """Rows whose labels may be learned from."""
    return F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held)


def _features_of(rows: DataFrame, extra: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                x = [features(t).tobytes() for t in b.column(1).slice(lo, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 200), pa.array(x, pa.binary())], [extra.split()[0], "x"])

    return rows.mapInArrow(released(run), f"{extra}, x binary")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model | None:
    """Fit on bounded samples; None where there is no positive."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(may_learn("doc_id") & F.col("y").isNotNull())
    order = F.xxhash64("doc_id")
    # The identifiers with the smallest hashes: a top-k in each task, then of those (no text moves).
    pos_ids = known.where("y = 1").select("doc_id").dropDuplicates().orderBy(order, "doc_id").limit(max_positive)
    unl_ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where(may_learn("doc_id")).orderBy(order, "doc_id").limit(max_unlabelled)
    ids = pos_ids.select("doc_id", F.lit(1).alias("kind")).unionByName(unl_ids.select("doc_id", F.lit(0).alias("kind"))).groupBy("doc_id").agg(F.sum(F.when(F.col("kind") == 1, 1).otherwise(2)).alias("kind"))
    # At most max_positive + max_unlabelled rows of two numbers: a bounded broadcast.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "doc_id").select(F.struct("kind", "doc_id").alias("k"), "text")
    got = _features_of(rows, "k struct<kind:bigint,doc_id:bigint>").orderBy("k", "x").limit(2 * (max_positive + max_unlabelled)).collect()
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(-1, N_FEATURES)
    kind = np.array([r.k.kind for r in got])
    pos, unl = x[kind % 2 == 1], x[kind >= 2]
    if not len(pos) or not len(unl):
        return None
    return fit_nnpu(pos, unl, class_prior(pos, unl) if prior is None else prior)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row, 0 to 1; higher: label 1 likelier."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.column(1).slice(lo, 200).to_pylist()
                s = np.full(len(part), 0.5) if m is None else m.score(np.array([features(t) for t in part]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 200), pa.array(s.astype(float), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(released(run), "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is ``threshold`` or more; rows go through one map and no shuffle."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                s = np.full(part.num_rows, 0.5) if m is None else m.score(np.array([features(t or "") for t in part.column(at).to_pylist()]))
                yield part.filter(pa.array(s >= threshold))

    return docs.mapInArrow(released(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""
    out = score(docs, fit(docs, labels, **options), options.get("id_col", "doc_id"), options.get("text_col", "text"))
    held = ~may_learn("doc_id") & F.col("doc_id").isNotNull()
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
