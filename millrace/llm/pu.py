"""Quality classifier from positive and unlabelled texts: non-negative unbiased risk, fitted on all rows.

With class prior p, loss l and score z, the risk is

    p * mean over positives of l(z)  +  max(0, mean over all of l(-z) - p * mean over positives of l(-z))

where the last part stands for the risk of negatives and may not go below 0.  The logistic loss makes
it convex while that part is positive.  The score is additive in steps of document statistics, so each
pass over the table needs a sum of one gradient per task.

Labelled negatives are not used anywhere.  The prior comes from positives and unlabelled texts alone: a
score that tells them apart is cut where the share of unlabelled texts above it, over the share of
positives above it, is least (best bin estimation).  The weight of the penalty is chosen by the risk on
positives and unlabelled texts that a fit has not seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut
from millrace.llm.docstats import FEATURES, scored_statistics

KNOTS = (0.003, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.997)


def steps(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """1 and, per feature and knot, whether the feature is above the knot."""
    above = x[:, :, None] > knots[None, :, :]
    return np.hstack([np.ones((len(x), 1)), above.reshape(len(x), -1)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def sums(x: np.ndarray, positive: np.ndarray, knots: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over the rows given: l(-z) of all, count, its gradient; then l(-z) and l(z) of positives, count,
    gradients of both."""
    a = steps(x, knots)
    z = a @ w
    s, minus, plus = sigmoid(z), np.logaddexp(0, z), np.logaddexp(0, -z)
    p = positive.astype(float)
    return np.concatenate([[minus.sum(), len(x)], a.T @ s, [minus @ p, plus @ p, p.sum()], a.T @ (s * p), a.T @ ((s - 1) * p)])


def risk(total: np.ndarray, w: np.ndarray, prior: float, l2: float) -> tuple[float, np.ndarray, float]:
    """(value, gradient, estimated risk of negatives) of the non-negative risk from ``sums`` over all rows.
    Where that estimate is below 0 the gradient is that of its opposite, along which it comes up again."""
    d = len(w)
    all_, n, g_all = total[0], max(total[1], 1), total[2 : 2 + d]
    minus, plus, m = total[2 + d], total[3 + d], max(total[4 + d], 1)
    g_minus, g_plus = total[5 + d : 5 + 2 * d], total[5 + 2 * d :]
    negative = all_ / n - prior * minus / m
    slope = g_all / n - prior * g_minus / m
    decay = np.append(0, w[1:])
    value = prior * plus / m + max(0.0, negative) + 0.5 * l2 * decay @ decay
    return value, (prior * g_plus / m + slope + l2 * decay if negative >= 0 else -slope), negative


def apart(total: np.ndarray, w: np.ndarray, l2: float) -> tuple[float, np.ndarray, float]:
    """Like ``risk``, of telling positives from unlabelled texts."""
    d = len(w)
    n, m = max(total[1], 1), max(total[4 + d], 1)
    decay = np.append(0, w[1:])
    return total[0] / n + total[3 + d] / m + 0.5 * l2 * decay @ decay, total[2 : 2 + d] / n + total[5 + 2 * d :] / m + l2 * decay, 1.0


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, float]], w: np.ndarray, passes: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent, one evaluation a pass; the best point is returned.

    Where the risk of negatives is below 0, a plain step of the length that should bring it back to 0 is
    taken as it is, and what was learned of the curvature is dropped, so that pairs of steps and changes of
    the gradient always belong to one and the same function.
    """
    value, g, negative = evaluate(w)
    best, best_w, pairs, scale = value, w, [], 1.0
    for _ in range(passes):
        if negative < 0:
            pairs, scale = [], 1.0
            w = w - g * min(1.5 * -negative / max(g @ g, 1e-12), 6.0 / max(np.linalg.norm(g), 1e-12))
            value, g, negative = evaluate(w)
            if value < best - 1e-12:
                best, best_w = value, w
            continue
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), alpha in zip(pairs, reversed(alphas), strict=True):
            q += s * (alpha - y @ q / (s @ y))
        step = -scale * q
        size = np.linalg.norm(step)
        step *= min(1.0, 6.0 / max(size, 1e-12))
        new_value, new_g, new_negative = evaluate(w + step)
        if new_value > value + 1e-9:
            scale *= 0.3  # too far: shorter from the same point
            if scale < 1e-3:
                break
            continue
        y = new_g - g
        if new_negative >= 0 and step @ y > 1e-10:
            pairs = [*pairs[-memory + 1 :], (step, y)]
        w, value, g, negative, scale = w + step, new_value, new_g, new_negative, 1.0
        if value < best - 1e-12:
            best, best_w = value, w
        if negative >= 0 and np.linalg.norm(g) < 1e-5:
            break
    return best_w


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from counts of positives and of unlabelled texts by score, lowest bin first.

    Above a score where only positives lie, the share of the unlabelled is the prior times that of the
    positives; anywhere else it is more.  So the least ratio is taken, with an allowance for chance that
    grows where few positives are left (confidence 0.9).  Of the interval that the allowance spans, the
    lower end is returned: with too large a prior the risk of negatives is cut off at 0 and they go unseen,
    with one a little too small it is not.  The interval closes as the rows become more.
    """
    n_p, n_u = max(positive.sum(), 1), max(unlabelled.sum(), 1)
    above_p, above_u = positive[::-1].cumsum()[::-1] / n_p, unlabelled[::-1].cumsum()[::-1] / n_u
    chance = np.sqrt(np.log(40) / 2 / n_u) + np.sqrt(np.log(40) / 2 / n_p)
    some = above_p > 0
    k = int(np.argmin(np.where(some, (above_u + 1.01 * chance) / np.where(some, above_p, 1.0), np.inf)))
    return float(np.clip((above_u[k] - chance) / max(above_p[k], 1e-12), 0.02, 0.98))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def quantiles(rows: DataFrame) -> np.ndarray:
    """(features, knots): where the steps of each feature lie."""
    spots = rows.agg(*[F.percentile_approx(F.col("features")[k], list(KNOTS), 10_000).alias(f"q{k}") for k in range(len(FEATURES))]).first()
    return np.array([v if v is not None else [0.0] * len(KNOTS) for v in spots])


class Sample(NamedTuple):
    """Features of a bounded sample of both halves of the rows, half by half."""

    x: list[np.ndarray]
    positive: list[np.ndarray]


def draw_sample(rows: DataFrame, most: int) -> Sample:
    """At most ``most`` positives and as many of all rows, in each half those with the smallest hashes."""
    x, positive = [], []
    for half in (0, 1):
        own = rows.where(F.col("half") == half).orderBy("place").select("features", "positive")
        found = [own.where("positive").limit(most // 2).collect(), own.limit(most // 2).collect()]
        x.append(np.array([r.features for part in found for r in part]).reshape(-1, len(FEATURES)))
        positive.append(np.repeat([True, False], [len(part) for part in found]))
    return Sample(x, positive)


def _halves(sample: Sample, knots: np.ndarray, objective: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, float]], passes: int) -> list[np.ndarray]:
    """A fit for each half, on that half's sample."""
    width = 1 + knots.size
    return [minimise(lambda w, x=x, p=p: objective(case_control(x, p, knots, w), w), np.zeros(width), passes) for x, p in zip(sample.x, sample.positive, strict=True)]


def case_control(x: np.ndarray, positive: np.ndarray, knots: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``sums`` where positives and unlabelled rows are different rows."""
    d = len(w)
    return np.concatenate([sums(x[~positive], positive[~positive], knots, w)[: 2 + d], sums(x[positive], positive[positive], knots, w)[2 + d :]])


def estimate_prior(rows: DataFrame, sample: Sample, knots: np.ndarray, passes: int, l2: float = 1e-2, bins: int = 1000) -> float:
    """The prior by ``best_bin``; every row of ``rows`` counts, with the score that the other half's sample
    gave.  What reaches the driver is two counts a bin."""
    models = _halves(sample, knots, lambda total, w: apart(total, w, l2), passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, bins), np.int64)
        for batch in batches:
            x, positive, half = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            a = steps(x, knots)
            score = sigmoid(np.where(half == 0, a @ models[1], a @ models[0]))
            at = np.minimum((score * bins).astype(np.int64), bins - 1)
            counts += [np.bincount(at[positive], minlength=bins), np.bincount(at, minlength=bins)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins)), pa.array(counts[0]), pa.array(counts[1])], ["bin", "p", "u"])

    summed = rows.select("features", "positive", "half").mapInArrow(run, "bin long, p long, u long").groupBy("bin").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counts = np.zeros((2, bins))
    for k, n_p, n_u in summed.collect():  # one row a bin
        counts[:, k] = n_p, n_u
    return best_bin(*counts)


def choose_penalty(sample: Sample, knots: np.ndarray, prior: float, passes: int, choices: tuple[float, ...]) -> float:
    """The penalty whose fits on one half have the least risk on the other half."""

    def unseen(l2: float) -> float:
        models = _halves(sample, knots, lambda total, w: risk(total, w, prior, l2), passes)
        return sum(risk(case_control(sample.x[1 - k], sample.positive[1 - k], knots, w), w, prior, 0.0)[0] for k, w in enumerate(models))

    return min(choices, key=unseen)


def fit(rows: DataFrame, knots: np.ndarray, prior: float, passes: int, l2: float) -> np.ndarray:
    """Weights from (features, positive) rows, every one of which counts in each pass."""
    width = 1 + knots.size

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(5 + 3 * width)
            for batch in batches:
                total += sums(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), knots, w)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

        summed = rows.select("features", "positive").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
        total = np.zeros(5 + 3 * width)
        for k, v in summed.collect():  # one row per parameter
            total[k] = v
        return risk(total, w, prior, l2)

    return minimise(evaluate, np.zeros(width), passes)


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    prior: float | None = None,
    passes: int = 24,
    penalties: tuple[float, ...] = (1e-4, 1e-3, 1e-2),
    sample_rows: int = 10_000,
    threshold: float = 0.5,
) -> DataFrame:
    """(key, score, predicted) for every row of ``docs``.

    Trusted positives are the documents that ``labels`` marks 1, and nothing else of ``labels`` is read; all
    documents are the unlabelled texts.  Without ``prior`` the class prior is estimated (``estimate_prior``):
    the scores that it needs are fitted on at most ``sample_rows`` positives and as many documents, its
    counts cover all.  The penalty is the one of ``penalties`` that does best on documents of the same sample
    that a fit has not seen (``choose_penalty``).  Every document counts in every pass of the fit itself;
    only sums, one per parameter, reach the driver.

    ``score`` (0 to 1) estimates the probability of label 1, ``predicted`` is 1 from ``threshold`` on.
    Null and empty texts have all statistics 0 and are scored by them; a very long text is one row whose
    statistics cover all of it.  Texts with equal statistics tie.  Null labels are no labels; a key labelled
    1 and 0 counts as 1.  Without a positive every score is ``prior`` (0.5 if that is not given).  Repeated
    rows get equal scores; rows that share a key share its label.  An empty table gives an empty result;
    other columns are not read.
    """
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).na.drop().where("label = 1").select("key").distinct()
    stats = scored_statistics(docs, key, text).select(F.col(key).alias("key"), "features")
    place = F.xxhash64("key", "features")
    rows = stats.join(known.withColumn("positive", F.lit(True)), "key", "left")
    rows = cut(rows.select("key", "features", F.coalesce("positive", F.lit(False)).alias("positive"), place.alias("place"), F.pmod(F.xxhash64(place), F.lit(2)).alias("half")))
    if rows.where("positive").isEmpty():
        flat = 0.5 if prior is None else prior

        def score(x: np.ndarray) -> np.ndarray:
            return np.full(len(x), flat)
    else:
        knots, sample = quantiles(rows), draw_sample(rows, sample_rows)
        share = estimate_prior(rows, sample, knots, passes) if prior is None else prior
        w = fit(rows, knots, share, passes, choose_penalty(sample, knots, share, passes, penalties))

        def score(x: np.ndarray) -> np.ndarray:
            return sigmoid(steps(x, knots) @ w)

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(_matrix(batch.column(1))))], ["key", "score"])

    out = rows.select("key", "features").mapInArrow(run, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
