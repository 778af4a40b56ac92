"""Quality classification by co-training.

Two views of a document each have a classifier: the shape of its text, and its metadata. Both are fitted on
labelled documents. Over several rounds each scores documents without labels and hands those it is most
confident about, with the label it holds for right, to the other's training set. Each view is then calibrated on
labelled documents kept aside, and the calibrated views are combined there, so that a weak view counts for
little. All documents are scored.

Features are computed once for all documents, where they are; a document's features are a short array. Fitting takes
the features of at most ``SAMPLE`` labelled documents and ``POOL`` others, those of least hash, so the models
are the same whatever the partitions.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.llm.common import least_hashed, stored

SAMPLE, POOL = 10_000, 10_000
ROUNDS, GROW, CONFIDENT = 5, 200, 0.95
KEEP = 0.5
SYMBOLS, STOPS = b"|*&%$#!@^~=+<>{}[]\\/_", b".,;:?'\"()-"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
BEYOND = bytes(range(128, 256))
LANGS, SOURCES = 8, 32


# views ----------------------------------------------------------------------------------------------

def text_features(text: str) -> list[float]:
    """The shape of a text: its sizes, its shares of kinds of characters, and how much repeats."""
    data = text.encode()
    n = len(data) or 1
    shares = [(n - len(data.translate(None, kind))) / n if data else 0.0 for kind in (SYMBOLS, STOPS, UPPER, DIGITS, BEYOND)]
    words = data.split()
    lines = data.split(b"\n")
    w = len(words) or 1
    letters = len(data.translate(None, SYMBOLS + STOPS + DIGITS + b" \n\t\r")) / n if data else 0.0
    return [*shares, letters, math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / w,
            len({*words}) / w, len({*words}) / math.sqrt(w), len({*lines}) / len(lines), math.log1p(len(data) / len(lines)),
            shares[0] * n / w, shares[2] * n / w, math.log1p(max(map(len, words), default=0))]


def meta_features(lang: Column, source: Column, n_chars: Column) -> Column:
    """Hashed language and source, and the size the table states; nulls have places of their own."""
    def one_hot(value: Column, size: int) -> list[Column]:
        place = F.when(value.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(value.cast("string")), F.lit(size - 1)))
        return [(place == i).cast("double") for i in range(size)]

    size = F.log1p(F.greatest(F.coalesce(n_chars.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.array(*one_hot(lang, LANGS), *one_hot(source, SOURCES), size, n_chars.isNull().cast("double"))


def _text_view(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def shaped(texts):
        import pandas as pd

        return pd.Series([text_features(t or "") for t in texts])

    return shaped(text.cast("string"))


def views(docs: DataFrame) -> DataFrame:
    """Add ``text_view`` and ``meta_view``, arrays of doubles. Null texts are empty."""
    return docs.withColumns({"text_view": _text_view(F.col("text")), "meta_view": meta_features(
        F.col("lang"), F.col("source"), F.col("n_chars"))})


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_view, meta_view)`` of every row, kept in the shared folder: texts are read once."""
    return stored(views(docs).select("doc_id", "text_view", "meta_view"), "features")


# models ---------------------------------------------------------------------------------------------

@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


@dataclass
class Model:
    text: Logistic | None
    meta: Logistic | None
    text_scale: np.ndarray  # slope and intercept that calibrate a view
    meta_scale: np.ndarray
    mix: np.ndarray  # weights of the calibrated views, and the intercept
    prior: float


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    return Logistic(mean, scale, _newton(np.clip((x - mean) / scale, -8, 8), y, weight, 1.0))


def _one_logit(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt's slope and intercept, with his softened targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    return _newton(z[:, None], target, np.ones(len(y)), 1e-3)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, pool_text: np.ndarray,
             pool_meta: np.ndarray, rounds: int = ROUNDS, grow: int = GROW, confident: float = CONFIDENT) -> Model:
    """Fit both views, let them teach one another, then calibrate and combine them on the rows ``held`` aside."""
    known = [(text[~held], y[~held]), (meta[~held], y[~held])]
    pools, other = [pool_text, pool_meta], (1, 0)
    taught: list[dict[int, float]] = [{}, {}]  # pseudo-labels of each view's own training set

    def train(view: int) -> Logistic:
        x, labels = known[view]
        extra = [*taught[view]]
        x = np.concatenate([x, pools[view][extra]]) if extra else x
        labels = np.concatenate([labels, [taught[view][i] for i in extra]]) if extra else labels
        # pseudo-labels together weigh no more than the given ones
        weight = np.r_[np.ones(len(known[view][1])), np.full(len(extra), min(1.0, len(known[view][1]) / max(1, len(extra))))]
        return _logistic(x, labels, weight)

    models = [train(0), train(1)]
    share = known[0][1].mean()
    for _ in range(rounds if len(pool_text) else 0):
        for view in (0, 1):
            p = sigmoid(models[view].logit(pools[view]))
            for label, sure, most in ((1.0, p, grow * share), (0.0, 1 - p, grow * (1 - share))):
                order = np.argsort(-sure, kind="stable")
                order = order[sure[order] >= confident]
                new = [i for i in order.tolist() if i not in taught[other[view]]][:max(1, round(most))]
                taught[other[view]].update(dict.fromkeys(new, label))
        models = [train(0), train(1)]
    text_z, meta_z = models[0].logit(text[held]), models[1].logit(meta[held])
    text_scale, meta_scale = _one_logit(text_z, y[held]), _one_logit(meta_z, y[held])
    both = np.c_[text_z * text_scale[0] + text_scale[1], meta_z * meta_scale[0] + meta_scale[1]]
    return Model(*models, text_scale, meta_scale, _newton(both, y[held], np.ones(held.sum()), 1.0), float(y.mean()))


def fit(found: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, pool: int = POOL) -> Model:
    """Fit on the features of labelled documents and of others.

    Null keys and labels are left out; a document labelled more than once is good if any label says so. A fifth of
    the labelled documents, by hash, is kept aside for calibration. With fewer than ten labelled documents, or only
    one class among either part, there is no model and every document scores the labels' mean, 1 without labels.
    """
    given = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("labelled")).agg(F.max(F.col(target).cast("double")).alias("label"))
    met = found.join(given, F.col("doc_id") == F.col("labelled"), "left")
    met = stored(met.select("doc_id", "text_view", "meta_view", "label"), "labelled")
    known, others = (least_hashed(met.filter(part), limit, "doc_id", "text_view").collect() for part, limit in (
        ("label IS NOT NULL", sample), ("label IS NULL", pool)))
    y = np.array([min(1.0, max(0.0, float(r["label"]))) for r in known])
    held = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in known], bool)
    if len(y) < 10 or any(len({*part.tolist()}) < 2 for part in (y[held], y[~held])):
        return Model(None, None, np.zeros(2), np.zeros(2), np.zeros(3), float(y.mean()) if len(y) else 1.0)
    columns = [np.array([r[c] for r in rows]).reshape(len(rows), -1) for rows in (known, others) for c in ("text_view", "meta_view")]
    return co_train(columns[0], columns[1], y, held, *(columns[2:] if len(others) else (columns[0][:0], columns[1][:0])))


# scores ---------------------------------------------------------------------------------------------

def _probability(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _logit(view: Column, model: Logistic) -> Column:
    def numbers(values) -> Column:
        return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")

    centred = F.zip_with(view, numbers(model.mean), lambda x, m: x - m)
    scaled = F.zip_with(centred, numbers(model.scale), lambda x, s: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), x / s)))
    parts = F.zip_with(scaled, numbers(model.weights[:-1]), lambda x, w: x * w)
    return F.aggregate(parts, F.lit(float(model.weights[-1])), lambda a, x: a + x)


def score(found: DataFrame, model: Model, keep_from: float = KEEP) -> DataFrame:
    """Add ``text_score`` and ``meta_score``, the calibrated views, ``score``, the combined one, and ``keep``."""
    if model.text is None:
        same = F.lit(model.prior)
        return found.withColumns({"text_score": same, "meta_score": same, "score": same, "keep": F.lit(True)})
    text = _logit(F.col("text_view"), model.text) * float(model.text_scale[0]) + float(model.text_scale[1])
    meta = _logit(F.col("meta_view"), model.meta) * float(model.meta_scale[0]) + float(model.meta_scale[1])
    rows = found.withColumns({"text_logit": text, "meta_logit": meta})
    mixed = F.col("text_logit") * float(model.mix[0]) + F.col("meta_logit") * float(model.mix[1]) + float(model.mix[2])
    return rows.withColumns({
        "text_score": _probability(F.col("text_logit")), "meta_score": _probability(F.col("meta_logit")),
        "score": _probability(mixed), "keep": _probability(mixed) >= keep_from}).drop("text_logit", "meta_logit")
