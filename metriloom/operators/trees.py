"""Boosted regression trees as flat arrays: growing one small series, predicting whole batches, reading Spark's.

A model is one row (``ENSEMBLE``): inputs with their centre and scale, and all nodes of all trees one after the
other. Rows of such models are joined to series, stored and read like any table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from metriloom.session import new_path

ENSEMBLE = (
    "features array<string>, center array<double>, scale array<double>, base double, root array<int>, feature array<int>, cut array<double>, "
    "left array<int>, right array<int>, leaf array<double>, gain array<double>"
)
BINS = 64


@dataclass
class TreeEnsemble:
    """Trees over scaled inputs; a row goes left where its input is at most the cut, and gets the sum of its leaves.

    ``feature`` is -1 at a leaf; ``leaf`` holds the weighted value, ``gain`` what a split took off the squared error.
    """

    features: list[str]
    center: np.ndarray
    scale: np.ndarray
    base: float
    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    gain: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """All trees step down together: one gather a level."""
        x = (np.asarray(x, dtype=float) - self.center) / self.scale
        at = np.tile(self.root, (len(x), 1))
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            if not (f >= 0).any():
                return self.base + self.leaf[at].sum(axis=1)
            down = np.where(x[row, np.maximum(f, 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(f >= 0, down, at)

    def importance(self) -> np.ndarray:
        """Share of each input in the gain of all splits."""
        total = np.bincount(np.maximum(self.feature, 0), np.where(self.feature >= 0, self.gain, 0.0), len(self.features))
        return total / total.sum() if total.sum() > 0 else total

    def row(self) -> dict:
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in out.items()}

    @classmethod
    def of(cls, row) -> TreeEnsemble:
        """From a row or mapping with the columns of ``ENSEMBLE``."""
        ints = ("root", "feature", "left", "right")
        made = {f.name: row[f.name] for f in fields(cls)}
        return cls(**{k: v if k == "base" else list(v) if k == "features" else np.asarray(v, dtype="int64" if k in ints else float) for k, v in made.items()})


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    seen = np.unique(x)
    if len(seen) <= bins:
        return (seen[1:] + seen[:-1]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def grow(x: np.ndarray, y: np.ndarray, features: Sequence[str], *, trees: int, depth: int, rate: float, penalty: float = 0.0, bins: int = BINS) -> TreeEnsemble:
    """Gradient boosting on histograms: inputs are cut into bins once, and each level of a tree is one count over
    (node, input, bin) of rows and residuals. ``penalty`` shrinks the leaves as that many rows of residual 0 would."""
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - center) / scale
    n, width = z.shape
    cuts = [_cuts(z[:, j], bins) for j in range(width)]
    place = np.stack([np.searchsorted(c, z[:, j], "left") for j, c in enumerate(cuts)], axis=1) + np.arange(width) * bins
    known = np.full((width, bins), np.nan)
    for j, c in enumerate(cuts):
        known[j, : len(c)] = c
    size = 2 ** (depth + 1) - 1  # nodes of a full tree; those never reached are not linked
    heap = np.arange(size)
    out = {k: [] for k in ("feature", "cut", "left", "right", "leaf", "gain")}
    base = float(y.mean())
    guess = np.full(n, base)
    for tree in range(trees):
        rest = y - guess
        node, open_ = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        feature, cut, gain = np.full(size, -1), np.zeros(size), np.zeros(size)
        for level in range(depth):
            rows = np.flatnonzero(open_)
            if not len(rows):
                break
            first, many = 2**level - 1, 2**level
            key = ((node[rows] - first)[:, None] * (width * bins) + place[rows]).ravel()
            total = np.bincount(key, np.repeat(rest[rows], width), many * width * bins).reshape(many, width, bins)
            count = np.bincount(key, minlength=many * width * bins).reshape(many, width, bins)
            g, c = total.cumsum(axis=2), count.cumsum(axis=2)
            g_all, c_all = g[:, :, -1:], c[:, :, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                better = g**2 / (c + penalty) + (g_all - g) ** 2 / (c_all - c + penalty) - g_all**2 / (c_all + penalty)
            better = np.where((c > 0) & (c < c_all), better, -np.inf).reshape(many, -1)
            best = better.argmax(axis=1)
            most = better[np.arange(many), best]
            split = most > 1e-12
            here = first + np.flatnonzero(split)
            feature[here], gain[here] = best[split] // bins, most[split]
            cut[here] = known[best[split] // bins, best[split] % bins]
            open_[rows] = split[node[rows] - first]
            rows = np.flatnonzero(open_)
            f = feature[node[rows]]
            # left where the bin is at most the bin of the cut
            to_left = place[rows, f] - f * bins <= best[node[rows] - first] % bins
            node[rows] = 2 * node[rows] + np.where(to_left, 1, 2)
        leaf = rate * np.bincount(node, rest, size) / np.maximum(np.bincount(node, minlength=size) + penalty, 1e-300)
        guess += leaf[node]
        for k, v in (("feature", feature), ("cut", cut), ("left", tree * size + 2 * heap + 1), ("right", tree * size + 2 * heap + 2), ("leaf", leaf), ("gain", gain)):
            out[k].append(v)
    flat = {k: np.concatenate(v) for k, v in out.items()}
    flat["left"], flat["right"] = (np.where(flat["feature"] >= 0, flat[k], 0) for k in ("left", "right"))
    return TreeEnsemble(list(features), center, scale, base, np.arange(trees) * size, **flat)


def from_pipeline(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> TreeEnsemble:
    """A fitted pipeline of scaler and boosted trees as flat arrays, read from the node table that Spark saves."""
    scaler, boosted = model.stages[-2], model.stages[-1]
    path = new_path(spark, "trees")
    boosted.write().save(path)
    node = F.col("nodeData")
    table = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["prediction"].alias("p"), node["leftChild"].alias("l"), node["rightChild"].alias("r"), node["gain"].alias("g"),
        node["split"]["featureIndex"].alias("f"), F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("c"), node["rawCount"].alias("n"),
    )
    rows = table.orderBy("treeID", "id").collect()  # at most trees * 2 ** (depth + 1) nodes
    counts = np.bincount([r["treeID"] for r in rows])
    root = np.concatenate([[0], np.cumsum(counts)[:-1]])
    weight = np.array(boosted.treeWeights)
    inner = np.array([r["l"] >= 0 for r in rows])
    start = np.array([root[r["treeID"]] for r in rows])
    return TreeEnsemble(
        list(features), np.asarray(scaler.mean.toArray()), np.where(scaler.std.toArray() > 0, scaler.std.toArray(), 1.0), 0.0, root,
        np.array([r["f"] if r["l"] >= 0 else -1 for r in rows]), np.array([r["c"] or 0.0 for r in rows]),
        np.where(inner, start + [r["l"] for r in rows], 0), np.where(inner, start + [r["r"] for r in rows], 0),
        np.array([r["p"] * weight[r["treeID"]] for r in rows]), np.array([max(r["g"], 0.0) * r["n"] for r in rows]),
    )
