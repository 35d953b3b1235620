"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled 1; rows labelled 0 are never used. All other text is unlabelled, and all of it counts:
its risk, gradients and statistics are sums over every document that is not held out, added up by the tasks. A linear
model on surface features of the whole text minimises
prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the logistic loss l, so that its output is a
probability. Below zero the second term counts with its sign turned, as the estimator steps against it there; the turn
is smoothed, so that Newton's steps, which take a few passes over the features, can go along it. A step that makes the
risk larger is halved.

The class prior is estimated from positives and unlabelled text alone. A model that tells trusted from unlabelled rows
gives scores; no set of scores holds a larger share of the positives than of the unlabelled text divided by the prior, so
the prior is the least ratio of the two shares over the sets "at least this score" that hold enough positives.
"""

from __future__ import annotations

import math
import operator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bound of the labelled rows that the fit uses, drawn by a hash of the id.
LABELLED = 12_000
#: Rows of this remainder by FOLDS are held out: they are not learned from.
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
#: Passes of one fit at most, the weight of the squared weights, and how sharply the risk's second term turns at zero.
PASSES, DECAY, SOFT = 24, 1e-4, 0.01
#: Bins of the scores from which the prior is estimated, and the share of positives that a set must hold.
BINS, ENOUGH = 1000, 0.3
KEEP_LETTERS = {name: bytes(sorted(set(range(256)) - set(chars))) for name, chars in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "mark": b"!?", "bar": b"|<>{}[]\\/=_~^", "symbol": b"#$%&*@+", "stop": b".,;:", "line": b"\n", "high": range(128, 256)}.items()}


def features(text: str | None) -> list[float]:
    """Shares of kinds of bytes and of repetition; all zero for a text without words."""
    raw = (text or "").encode()
    words = raw.split()
    n, m = len(raw), len(words)
    if not m:
        return [0.0] * WIDTH
    share = [math.sqrt(len(raw.translate(None, drop)) / n) for drop in KEEP_LETTERS.values()]
    same = sum(map(operator.eq, words, islice(words, 1, None))) / m
    pairs = list(zip(words, islice(words, 1, None)))
    lines = raw.split(b"\n")
    return [
        *share,
        math.sqrt(same),
        len(set(words)) / m,
        len(set(pairs)) / max(1, len(pairs)),
        len(set(lines)) / len(lines),
        math.log1p(m) / 10,
        n / m / 10,
        math.log1p(n / len(lines)) / 10,
        math.sqrt(sum(len(w) == 1 for w in words) / m),
    ]


WIDTH = len(KEEP_LETTERS) + 8


def expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x * x], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    def __init__(self, mean, scale, weights, prior):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((expand(x) - self.mean) / self.scale, -8, 8), np.ones(len(x))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.design(x) @ self.weights) if len(x) else np.zeros(0)


#: A model without evidence: every score is one half.
NEUTRAL = Model(np.zeros(2 * WIDTH), np.ones(2 * WIDTH), np.zeros(2 * WIDTH + 1), 0.5)


def losses(design: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows, sum of l(-g), its gradient, its second derivatives and the sum of the rows: all that a pass adds up."""
    g = design @ weights
    p = sigmoid(g)
    bend = (design * (p * (1 - p))[:, None]).T @ design
    return np.concatenate([[len(design), np.logaddexp(0, g).sum()], design.T @ p, bend.ravel(), design.sum(0)])


def minimise(positive: np.ndarray, unlabelled, prior: float | None, start: np.ndarray) -> np.ndarray:
    """Weights of least risk. positive: their design rows; unlabelled: weights -> the summed losses() of all unlabelled rows.

    With no prior the two kinds of rows are told apart, each kind counted as a half.
    """
    width, w, before = positive.shape[1], start, None
    step = np.zeros(width)
    for _ in range(PASSES):
        n, value, *rest = unlabelled(w)
        gradient, bend = np.array(rest[:width]) / n, np.array(
            rest[width : width + width * width]
        ).reshape(width, width) / n
        value /= n
        g = positive @ w
        own = (positive * (sigmoid(g) * sigmoid(-g))[:, None]).T @ positive / len(g)
        if prior is None:
            value, gradient = value + np.logaddexp(0, -g).mean(), gradient - (sigmoid(-g) @ positive) / len(g)
            bend = bend + own
        else:  # the second term, held at zero from both sides: below zero the step goes against it
            rest, slope = value - prior * np.logaddexp(0, g).mean(), gradient - prior * (sigmoid(g) @ positive) / len(g)
            size = math.hypot(rest, SOFT)
            c = rest / size
            value = prior * np.logaddexp(0, -g).mean() + size
            gradient = c * slope - prior * (sigmoid(-g) @ positive) / len(g)
            bend = max(c, 0) * bend + (1 - max(c, 0)) * prior * own + SOFT**2 / size**3 * np.outer(slope, slope)
        value += DECAY * (w[:-1] ** 2).sum() / 2
        if before is not None and value > before + 1e-12:
            step = step / 2
            w = w - step
            if np.abs(step).max() < 1e-4:
                break
            continue
        if before is not None and before - value < 1e-8:
            break
        before = value
        ridge = np.full(width, DECAY)
        ridge[-1] = 1e-9
        step = -np.linalg.solve(bend + np.diag(ridge), gradient + np.r_[DECAY * w[:-1], 0])
        step *= min(1.0, 8 / max(1e-12, np.abs(step).max()))
        w = w + step
    return w


def mixture_share(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from histograms of scores, from low to high, of positives and of unlabelled rows."""
    p, u = (np.cumsum(h[::-1]) / max(1, h.sum()) for h in (positive, unlabelled))
    sets = p >= ENOUGH
    return float(np.clip(np.min(u[sets] / p[sets]), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model from arrays of features: what train() does over a table."""
    if not len(positive) or not len(unlabelled):
        return NEUTRAL
    rows = expand(unlabelled)
    shape = Model(rows.mean(0), rows.std(0) + 1e-3, None, None)
    designed = shape.design(unlabelled)
    histogram = lambda x, w: np.bincount(np.minimum((sigmoid(x @ w) * BINS).astype(int), BINS - 1), minlength=BINS)
    return solved(shape, shape.design(positive), lambda w: losses(designed, w), lambda w: histogram(designed, w))


def solved(shape: Model, positive: np.ndarray, unlabelled, histogram) -> Model:
    """Prior, then weights. unlabelled and histogram: sums over all unlabelled rows for given weights."""
    apart = minimise(positive, unlabelled, None, np.zeros(positive.shape[1]))
    # the model has seen these positives, so they score a little high and the prior errs low, the safer side
    own = np.bincount(np.minimum((sigmoid(positive @ apart) * BINS).astype(int), BINS - 1), minlength=BINS)
    prior = mixture_share(own, histogram(apart))
    start = np.r_[np.zeros(positive.shape[1] - 1), math.log(prior / (1 - prior))]
    # sums of tasks may differ in the last digits from run to run: those are cut off
    return Model(shape.mean, shape.scale, np.round(minimise(positive, unlabelled, prior, start), 6), prior)


def fold(id_col):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def featured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, trusted, x) of every row of docs, written once. labels: doc_id, quality; nulls are skipped."""
    known = labels.filter(
        "doc_id is not null and quality is not null"
    ).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter((fold(F.col("doc_id")) != HELD) & (F.col("quality") == 1))
    n = known.count()
    bound = int(min(1.0, LABELLED / max(1, n)) * (1 << 30))
    trusted = known.filter(
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < bound
    ).select("doc_id", F.lit(True).alias("trusted"))
    # about LABELLED rows at most: small enough to send to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left")
    rows = rows.select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD).alias("held_out"),
        F.coalesce("trusted", F.lit(False)).alias("trusted"),
        "text",
    )

    def run(batches):
        for batch in batches:
            x = [features(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "held_out", "trusted")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "held_out", "trusted", "x"]
            )

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, trusted boolean, x array<double>"
    return C.materialise(C.small_batches(rows).mapInArrow(C.lean_batches(run), kind), "features")


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def summed(rows: DataFrame, f, width: int) -> np.ndarray:
    """f(features) -> vector of `width` numbers, added up over all rows; each task sends one vector."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += f(matrix(batch.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["i", "v"])

    found = rows.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # `width` rows
    out = np.zeros(width)
    for r in found:
        out[r["i"]] = r["v"]
    return out


def train(table: DataFrame) -> Model:
    """Fits on a table of featured(): its trusted ids against all rows that are not held out. Of rows that repeat a trusted id
    the one with the least features stands for all, so no more than LABELLED rows come to the driver, however often an id occurs."""
    open_, wide = table.filter("not held_out"), 2 * WIDTH
    trusted = table.filter("trusted").groupBy("doc_id").agg(F.min("x").alias("x"))
    positive = matrix(trusted.select("x").toArrow().column("x").combine_chunks())  # LABELLED rows
    positive = positive[np.lexsort(positive.T)]  # in one order, whatever the tasks' was
    sums = summed(open_, lambda x: np.concatenate([[len(x)], expand(x).sum(0), (expand(x) ** 2).sum(0)]), 1 + 2 * wide)
    n = sums[0]
    if not len(positive) or not n:
        return NEUTRAL
    mean = sums[1 : 1 + wide] / n
    scale = np.sqrt(np.maximum(sums[1 + wide :] / n - mean**2, 0)) + 1e-3
    shape, width = Model(mean, scale, None, None), wide + 1

    def unlabelled(w):
        return summed(open_, lambda x: losses(shape.design(x), w), 2 + 2 * width + width * width)

    def histogram(w):
        return summed(
            open_,
            lambda x: np.bincount(
                np.minimum((sigmoid(shape.design(x) @ w) * BINS).astype(int), BINS - 1), minlength=BINS
            ).astype(float),
            BINS,
        )

    return solved(shape, shape.design(positive), unlabelled, histogram)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, whole texts.

    score: probability that the label is 1; predicted: 1 from THRESHOLD on. A score depends on the text alone. Null or
    empty text: features zero, scored like any other; very long texts are read whole. Null id: scored, held_out as the checksum of an empty string says.
    Repeated rows: one row each, with equal scores. No positive labels: every score is one half. Empty table: no rows.
    Other columns are not read.
    """
    table = featured(docs, labels)
    model = train(table)

    def run(batches):
        for batch in batches:
            scores = pa.array(model.score(matrix(batch.column("x"))), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), scores], names=["doc_id", "held_out", "score"]
            )

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double"
    out = table.select("doc_id", "held_out", "x").mapInArrow(run, kind)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns, which may have any names besides doc_id and text.

    Null or empty text: scored like any other. Null ids and repeated rows: each row by its own text. Very long texts are
    read whole. No positive labels: all stay. Empty table: no rows.
    """
    table = featured(docs, labels)
    model = train(table)
    C.discard(table)
    names = docs.columns

    @F.pandas_udf("double")
    def rate(text):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t) for t in text], dtype=np.float64).reshape(-1, WIDTH)))

    return C.small_batches(docs).filter(rate(F.col("text")) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in names])
