"""Quality classifier learned from trusted positives and unlabelled text.

Every text becomes a short vector of surface statistics. The classifier is linear with the logistic loss and minimises
the non-negative unbiased risk of positive-unlabelled learning: with ``p`` the share of good texts, the risk on
negatives is ``E_unlabelled[loss(-)] - p * E_positive[loss(-)]`` and is kept from turning negative. Both expectations
are sums over all rows, made where the rows lie; the driver only sees sums of the vectors' size, and takes Newton steps.

The prior ``p`` is estimated without any negative label: a first classifier separates positives from unlabelled
texts; below a score threshold the unlabelled hold ``p`` times the share that the positives hold plus all bad texts, so
above it ``p`` is at most the ratio of the two shares, and the least such ratio over thresholds estimates it.

Null and empty texts have a vector too and get a score. Documents without label rows are unlabelled; a document is a
positive if any of its label rows says 1. Several rows of one document count each. Without positives or without texts
there is nothing to learn and every score is the prior given, 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import crc_of_id, pieces, released, store, texts_of
from tideline.shipping import ship_package

#: Classes of bytes: lower, upper, digit, space, line end, sentence marks, other ASCII marks, non-ASCII.
CLASSES = 8
BINS = 200


def byte_classes() -> np.ndarray:
    kind = np.full(256, 6, np.uint8)
    kind[128:] = 7
    for value, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:?'\"()-")):
        kind[[ord(c) for c in members]] = value
    return kind


def vectors(texts: list[bytes]) -> np.ndarray:
    """A row per text: shares of byte classes and of their pairs, word statistics, repetition."""
    kind = byte_classes()
    out = np.zeros((len(texts), CLASSES + CLASSES * CLASSES + 6))
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        data = np.frombuffer(text, np.uint8)
        k = kind[data]
        row[:CLASSES] = np.bincount(k, minlength=CLASSES) / len(k)
        pairs = np.bincount(k[:-1] * np.uint8(CLASSES) + k[1:], minlength=CLASSES * CLASSES)
        row[CLASSES:-6] = pairs / max(1, len(k) - 1)
        words = text.split()
        n = max(1, len(words))
        different = len(set(words))
        row[-6:] = (
            np.log(len(text)) / 10, len(text) / n / 10, different / n, np.log(n) / 10,
            np.log(n / max(1, different)), text.count(b"\n") / n,
        )
    return out


def width() -> int:
    return vectors([b""]).shape[1] + 1


def fields_of(df: DataFrame, columns: list[str]) -> T.StructType:
    """The fields of the given columns."""
    return T.StructType([df.schema[c] for c in columns])


def featurize(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns and ``x``, the vector of the text."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            x = vectors(texts_of(batch.column(text))).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], flat], names=[*columns, "x"])

    fields = fields_of(docs, columns)
    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, fields.add("x", T.ArrayType(T.FloatType())))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(np.float64)


def _summed(data: DataFrame, function, size: int) -> np.ndarray:
    """Sum over all rows of vectors of ``size`` that ``function`` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += function(_matrix(batch), batch.column("positive").to_numpy(zero_copy_only=False))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["i", "v"])

    got = data.select("x", "positive").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect()
    out = np.zeros(size)
    for i, v in got:
        out[i] = v
    return out


def _score(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.c_[np.clip((x - model["mean"]) / model["scale"], -8, 8), np.ones(len(x))] @ model["weights"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _newton(data: DataFrame, model: dict, prior: float | None, steps: int, ridge: float) -> np.ndarray:
    """Minimise the risk. Without a prior: positives against unlabelled texts, each half of the weight."""
    d = len(model["mean"]) + 1
    weights = np.zeros(d)

    def sums(w: np.ndarray):
        def run(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
            x = np.c_[np.clip((x - model["mean"]) / model["scale"], -8, 8), np.ones(len(x))]
            z = np.clip(x @ w, -40, 40)
            s, parts = 1 / (1 + np.exp(-z)), []
            for rows in (positive, ~positive):
                a, p = x[rows], s[rows]
                plus, minus = np.logaddexp(0, -z[rows]).sum(), np.logaddexp(0, z[rows]).sum()
                parts += [[len(a), plus, minus], a.T @ p, a.sum(0), ((a * (p * (1 - p))[:, None]).T @ a).ravel()]
            return np.concatenate([np.ravel(v) for v in parts])

        return run

    size = 3 + 2 * d + d * d
    best, step, move = np.inf, 1.0, np.zeros(d)
    for _ in range(steps):
        tried = weights - step * move
        got = _summed(data, sums(tried), 2 * size).reshape(2, size)
        (n_p, plus_p, minus_p), (n_u, _, minus_u) = got[0, :3], got[1, :3]
        n_all = n_p + n_u
        sp, su = got[0, 3 : 3 + d] / n_p, got[:, 3 : 3 + d].sum(0) / n_all
        xp = got[0, 3 + d : 3 + 2 * d] / n_p
        hp, hu = got[0, 3 + 2 * d :].reshape(d, d) / n_p, got[:, 3 + 2 * d :].sum(0).reshape(d, d) / n_all
        penalty = ridge * np.r_[tried[:-1], 0]
        if prior is None:
            risk = (plus_p / n_p + (minus_p + minus_u) / n_all) / 2
            gradient, hessian = ((sp - xp) + su) / 2, (hp + hu) / 2
        else:
            risk = prior * plus_p / n_p + max(0.0, (minus_p + minus_u) / n_all - prior * minus_p / n_p)
            gradient, hessian = su - prior * xp, hu  # of the unclipped risk, which is convex
        risk += penalty @ tried / 2
        if risk >= best - 1e-7:
            if step < 1e-2:
                break
            step /= 4  # too far, or the risk on negatives has fallen below zero
            continue
        best, weights, step = risk, tried, 1.0
        move = np.linalg.solve(hessian + (ridge + 1e-9) * np.eye(d), gradient + penalty)
    return weights


def estimate_prior(data: DataFrame, model: dict) -> float:
    """The least ratio of the shares of unlabelled and positive texts above a score, with room for chance."""

    def histogram(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        b = np.minimum((_score(x, model) * BINS).astype(int), BINS - 1)
        return np.r_[np.bincount(b[positive], minlength=BINS), np.bincount(b, minlength=BINS)].astype(float)

    p, u = _summed(data, histogram, 2 * BINS).reshape(2, BINS)
    above = lambda v: np.cumsum(v[::-1]) / v.sum()
    share_p, share_u = above(p), above(u)
    ok = share_p > 0.3  # fewer positives make the ratio a matter of chance
    slack = (1 / np.sqrt(p.sum()) + 1 / np.sqrt(u.sum())) / 2
    return float(np.clip(((share_u[ok] + slack) / share_p[ok]).min(), 0.05, 0.98))


def fit(vectors_: DataFrame, prior: float | None = None, steps: int = 20, ridge: float = 1e-3) -> dict:
    """Learn from columns ``x`` and ``positive`` (trusted good texts; all others are unlabelled)."""
    d = width() - 1
    moments = lambda x, positive: np.r_[len(x), positive.sum(), x.sum(0), (x * x).sum(0)]
    got = _summed(vectors_, moments, 2 + 2 * d)
    n, positives = got[:2]
    if not n or not positives:
        return {"mean": np.zeros(d), "scale": np.ones(d), "weights": np.zeros(d + 1), "prior": 0.5}
    mean = got[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(got[2 + d :] / n - mean * mean, 0))
    model = {"mean": mean, "scale": np.where(scale > 1e-9, scale, 1.0)}
    if prior is None:
        model["weights"] = _newton(vectors_, model, None, steps, 1e-3)
        prior = estimate_prior(vectors_, model)
    model["weights"], model["prior"] = _newton(vectors_, model, prior, steps, ridge), prior
    return model


def score(vectors_: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """The given columns and ``score``, the probability that the text is good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _score(_matrix(batch), model) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(s)], names=[*columns, "score"])

    fields = fields_of(vectors_, columns)
    return vectors_.select(*columns, "x").mapInArrow(run, fields.add("score", T.DoubleType()))


def held_out() -> Column:
    """Documents whose labels are never learned from."""
    return crc_of_id("doc_id") % 5 == 0


def _trained(data: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """Rows with ``doc_id`` and ``x``, written with ``positive``, and the model they give."""
    good = labels.where((F.col("quality") == 1) & ~held_out()).select(F.col("doc_id").alias("_good")).distinct()
    data = data.join(good, F.col("doc_id") == F.col("_good"), "left")
    data = store(data.withColumn("positive", F.col("_good").isNotNull()).drop("_good"), "quality")
    return data, fit(data)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out`` and ``score`` of every row."""
    data, model = _trained(featurize(docs.select("doc_id", "text"), ["doc_id"]), labels)
    return score(data, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score")


def classify_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Whole rows as ``doc`` with their ``score``; the vectors are made again, in the task that scores them, rather than written with the texts."""
    _, model = _trained(featurize(docs.select("doc_id", "text"), ["doc_id"]), labels)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (pa.RecordBatch.from_arrays([b.column("doc"), b.column("doc").field("text")], names=["doc", "text"]) for b in batches)
        for batch in pieces(both, "text"):
            s = _score(vectors(texts_of(batch.column("text"))).astype(np.float32).astype(np.float64), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(s)], names=["doc", "score"])

    return packed.mapInArrow(released(run), T.StructType([*packed.schema.fields, T.StructField("score", T.DoubleType())]))
