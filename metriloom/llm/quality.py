"""Quality by positive-unlabelled learning: trusted positives and unlabelled web text, no negatives.

Features are shares and means of the whole text (kinds of characters, words, lines, repetition, compression),
each cut into bins at fixed quantiles over all documents; a linear score adds one weight per bin.

Class prior. A scorer of positives against all documents is fitted on half of the positives; the share of
documents above a threshold over the share of the other positives above it is an upper bound of the prior, and
the least such bound, with a margin for small counts, is the estimate (best bin).

Fit. The unbiased risk with the logistic loss is prior * mean over positives of l(z) plus the negatives' part,
mean over all documents of l(-z) minus prior * mean over positives of l(-z). That part cannot be negative for
any real population; where a step has made it so, the next step goes up its gradient instead (non-negative
correction). Otherwise steps are L-BFGS, scaled by a bound of the curvature. Every pass reads all documents'
bins in Spark and brings one sum per weight to the driver, so nothing is sampled.

Null and empty texts have all features 0 and are scored like others. Labels are those above 0; labels that are
null, or of no document, are left out, and a document labelled twice is trusted only if all its labels say so. A
document in several rows counts as often. Without positives every score is 0.5. Columns named like the results
(``features``, ``score``, ``predicted``) are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriloom.llm.frames import add_arrow_column, texts
from metriloom.session import written

QUANTILES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
#: passes over all documents' bins for the prior's scorer and for the classifier
PRIOR_PASSES, PASSES = 12, 16
#: least and greatest ridge; between them a tenth over the number of positives
RIDGE = (1e-5, 1e-3)
#: step up the gradient of a negative negatives' part, as a share of the step that bounds its curvature
CORRECTION = 1.0
MEMORY = 8
FEATURES = (
    "upper lower digit blank newline stop comma bracket symbol beyond_ascii control words word_length distinct_words top_word "
    "same_neighbours capital_words symbol_words short_words longest_word line_words distinct_lines stopped_lines compressed"
).split()


def _kinds() -> np.ndarray:
    """Kind of each byte value, in the order of the first features."""
    kind = np.full(256, 8)
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\x0b\x0c\r", "\n", ".!?", ",;:'\"-", "()[]")):
        kind[[ord(c) for c in chars]] = k
    kind[128:] = 9
    kind[[b for b in range(32) if kind[b] == 8]] = 10
    return kind


KIND = _kinds()


def describe(text: str) -> np.ndarray:
    """The features of one text, in the order of ``FEATURES``."""
    out = np.zeros(len(FEATURES))
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return out
    out[:11] = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=11) / len(raw)
    out[23] = len(zlib.compress(raw, 1)) / len(raw)
    words = text.split()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not words:
        return out
    n = len(words)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    out[11:20] = (
        np.log1p(n), lengths.mean(), len(counts) / n, max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n, sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,!?;:'\")") / n,
        (lengths <= 2).mean(), np.log1p(lengths.max()),
    )
    out[20:23] = np.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines)
    return out


def featured(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and ``features``."""

    def make(batch):
        rows = [describe(t) for t in texts(batch.column(batch.schema.get_field_index(text)))]
        return pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))

    return add_arrow_column(df, "features", "array<double>", make)


@dataclass
class Model:
    """Bin edges and weights; ``prior`` is the estimated share of positives. As small as the list of bins."""

    edges: list[np.ndarray]
    weights: np.ndarray  # one per bin, the last is the bias
    prior: float

    def bins(self, features: np.ndarray) -> np.ndarray:
        """Index of each feature's weight."""
        starts = np.cumsum([0, *(len(e) + 1 for e in self.edges[:-1])])
        return np.stack([s + np.searchsorted(e, features[:, i], "right") for i, (s, e) in enumerate(zip(starts, self.edges))], axis=1)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1) + self.weights[-1]


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy().astype(dtype).reshape(len(column), -1)


def _edges(rows: DataFrame) -> list[np.ndarray]:
    """Bin edges at ``QUANTILES`` over all rows: as many numbers as there are bins."""
    wide = rows.select(*[F.col("features")[i].alias(f) for i, f in enumerate(FEATURES)])
    found = wide.agg(*[F.percentile_approx(f, list(QUANTILES), 10_000).alias(f) for f in FEATURES]).first()
    return [np.unique(np.array(found[f] or [0.0])) for f in FEATURES]


@dataclass
class Sums:
    """Of one pass at given weights: means over all documents (u) and over positives (p)."""

    n_u: float
    n_p: float
    up: np.ndarray  # mean of sigmoid(z) x over all documents
    pp: np.ndarray  # the same over positives
    soft_u: float  # mean of log(1 + exp(z))
    soft_p: float
    z_p: float


def _pass(binned: DataFrame, model: Model, folds: tuple[int, ...]) -> Sums:
    size = len(model.weights)

    def run(batches):
        total = np.zeros((2, size + 3))
        for b in batches:
            bins = _matrix(b.column(0), np.int64)
            if not len(bins):
                continue
            z = model.margins(bins)
            # sigmoid and log(1 + exp(z)) without overflow
            p, soft = 0.5 * (1 + np.tanh(z / 2)), np.logaddexp(0, z)
            positive = np.isin(b.column(1).to_numpy(), folds)
            for k, weight in enumerate((np.ones(len(z)), positive.astype(float))):
                total[k, :size] += np.bincount(bins.ravel(), np.repeat(p * weight, bins.shape[1]), size)
                total[k, size - 1] += (p * weight).sum()
                total[k, size:] += (soft * weight).sum(), (z * weight).sum(), weight.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["k", "v"])

    sums = np.zeros(2 * (size + 3))
    for r in binned.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # at most two a weight
        sums[r["k"]] = r["v"]
    u, p = sums.reshape(2, -1)
    n_u, n_p = max(1.0, u[-1]), max(1.0, p[-1])
    return Sums(u[-1], p[-1], u[:size] / n_u, p[:size] / n_p, u[size] / n_u, p[size] / n_p, p[size + 1] / n_p)


def _descend(look: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray | None]], w: np.ndarray, scale: np.ndarray, passes: int) -> np.ndarray:
    """L-BFGS from ``w``; ``look`` gives value, gradient and, where a correction is due, the step to take instead."""
    value, gradient, instead = look(w)
    best, best_value = w, value
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1.0
    for _ in range(passes):
        if instead is not None:
            pairs, direction, step = [], instead, 1.0
        else:
            q, saved = gradient.copy(), []
            for s, y in reversed(pairs):
                a = (s @ q) / (s @ y)
                q -= a * y
                saved.append(a)
            if pairs:
                s, y = pairs[-1]
                q *= (s @ y) / (y @ (y / scale))
            q /= scale
            for (s, y), a in zip(pairs, reversed(saved)):
                q += s * (a - (y @ q) / (s @ y))
            direction = -q
        there = w + step * direction
        new, new_gradient, new_instead = look(there)
        if instead is None and new_instead is None and new > value + 1e-12:
            step /= 4  # too far: try again from the same point
            if step < 1e-3:
                break
            continue
        s, y = there - w, new_gradient - gradient
        if instead is None and new_instead is None and s @ y > 1e-12:
            pairs = [*pairs[1 - MEMORY :], (s, y)]
        done = instead is None and new_instead is None and abs(value - new) < 1e-7 * max(1.0, abs(value))
        w, value, gradient, instead, step = there, new, new_gradient, new_instead, 1.0
        if value < best_value:
            best, best_value = w, value
        if done:
            break
    return best


def _scale(start: Sums, features: int, ridge: float) -> np.ndarray:
    """A bound of the curvature of each weight: a quarter of its bin's share, times the bins of a row."""
    return 0.25 * (features + 1) * 2 * start.up + ridge


def _prior(binned: DataFrame, model: Model, ridge: float) -> float:
    """Best-bin estimate of the share of positives among all documents."""
    start = _pass(binned, model, (1,))

    def look(w):
        s = _pass(binned, Model(model.edges, w, 0.0), (1,))
        return s.soft_u + s.soft_p - s.z_p + ridge / 2 * (w @ w), s.up + s.pp - 2 * start.pp + ridge * w, None

    scorer = Model(model.edges, _descend(look, model.weights, _scale(start, len(FEATURES), ridge), PRIOR_PASSES), 0.0)

    def run(batches):
        counts = np.zeros((2, 1_000))
        for b in batches:
            bins = _matrix(b.column(0), np.int64)
            if len(bins):
                at = np.minimum(999, (500 * (1 + np.tanh(scorer.margins(bins) / 2))).astype(int))
                counts[0] += np.bincount(at, minlength=1_000)
                counts[1] += np.bincount(at[b.column(1).to_numpy() == 2], minlength=1_000)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["k", "v"])

    counts = np.zeros(2_000)
    for r in binned.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # a row per bin of scores
        counts[r["k"]] = r["v"]
    u, p = counts.reshape(2, -1)[:, ::-1].cumsum(axis=1)  # documents and positives from each score up
    if not p[-1]:
        return 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (u / u[-1]) / (p / p[-1])
        margin = 1.01 * np.sqrt(np.log(40) / 2) * (u[-1] ** -0.5 + p[-1] ** -0.5) / (p / p[-1])
    return float(np.clip(share[np.nanargmin(np.where(p > 0, share + margin, np.inf))], 0.01, 0.99))


def fit(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", prior: float | None = None) -> Model:
    """Model of rows with ``features`` and the trusted positives among ``labels``; ``prior`` is estimated if not given."""
    trusted = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(F.col(label) > 0).alias("_yes")).where("_yes")
    edges = _edges(rows)
    blank = Model(edges, np.zeros(sum(len(e) + 1 for e in edges) + 1), 0.5)
    marked = rows.join(trusted, F.col(doc_id) == F.col("_id"), "left")
    # positives of fold 1 fit the prior's scorer, those of fold 2 measure it
    fold = F.when(F.col("_yes"), F.lit(1) + F.pmod(F.xxhash64("_id"), F.lit(2))).otherwise(0).cast("int").alias("fold")
    flat = marked.select("features", fold)

    def cut(batches):
        for b in batches:
            found = blank.bins(_matrix(b.column(0), np.float64)) if b.num_rows else np.zeros((0, len(edges)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32).tolist(), pa.list_(pa.int32())), b.column(1)], names=["bins", "fold"])

    binned = written(flat.mapInArrow(cut, "bins array<int>, fold int"), "bins")
    start = _pass(binned, blank, (1, 2))
    if not start.n_p:
        return blank
    ridge = float(np.clip(0.1 / start.n_p, *RIDGE))
    share = prior if prior is not None else _prior(binned, blank, ridge)
    scale = _scale(start, len(FEATURES), ridge)

    def look(w):
        s = _pass(binned, Model(edges, w, share), (1, 2))
        negatives = s.soft_u - share * s.soft_p
        rise = s.up - share * s.pp
        fall = share * (s.pp - 2 * start.pp)
        value = share * (s.soft_p - s.z_p) + max(0.0, negatives) + ridge / 2 * (w @ w)
        return value, fall + rise + ridge * w, CORRECTION * rise / scale if negatives < 0 else None

    return Model(edges, _descend(look, blank.weights, scale, PASSES), share)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """All columns but ``features``, and ``score``, ``predicted``."""

    def make(batch):
        found = _matrix(batch.column(batch.schema.get_field_index("features")), np.float64)
        return pa.array(0.5 * (1 + np.tanh(model.margins(model.bins(found)) / 2)) if len(found) else np.zeros(0))

    scored = add_arrow_column(rows.drop("predicted"), "score", "double", make)
    return scored.drop("features").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt; a null id has none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
