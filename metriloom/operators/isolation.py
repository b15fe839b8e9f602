"""Isolation forest: a small seeded sample per tree, trees as arrays, scoring inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metriloom.functions.quantities import finite
from metriloom.operators.scale import exact_percentile, join_small
from metriloom.session import written

TREE = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def _average_path(n: np.ndarray | int):
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def _grow(features: list[str], seed: int, sample: int):
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("rank")[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []  # feature, cut, left, right, depth at a leaf
        todo = [(np.arange(len(x)), 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            here = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = here
            spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(len(features))
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(rows) <= 1 or not len(usable):
                nodes.append([-1, 0.0, -1, -1, depth + float(_average_path(len(rows)))])
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
            nodes.append([f, cut, -1, -1, 0.0])
            below = x[rows, f] < cut
            todo += [(rows[~below], depth + 1, here, 1), (rows[below], depth + 1, here, 0)]
        return pd.DataFrame([[tree, *[[n[i] for n in nodes] for i in range(5)]]], columns=["tree", "feature", "cut", "left", "right", "depth"])

    return run


@dataclass
class IsolationForest:
    """Trees as arrays, the scaling of the inputs, and the score offset at the contamination."""

    features: list[str]
    trees: list[tuple[np.ndarray, ...]]
    center: np.ndarray
    scale: np.ndarray
    sample: int
    offset: float = -0.5


def _scores(x: np.ndarray, forest: IsolationForest) -> np.ndarray:
    """Negated anomaly score in [-1, 0]; lower is more anomalous."""
    x = (x - forest.center) / forest.scale
    total = np.zeros(len(x))
    for feature, cut, left, right, depth in forest.trees:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            go = at[inner]
            below = x[inner, f[inner]] < cut[go]
            at[inner] = np.where(below, left[go], right[go])
        total += depth[at]
    return -np.power(2.0, -(total / len(forest.trees)) / float(_average_path(forest.sample)))


def score_samples(df: DataFrame, forest: IsolationForest, columns: Sequence[str] | None = None, out: str = "score_sample") -> DataFrame:
    """Add the negated anomaly score; ``columns`` are the inputs, in the order of the forest's features."""
    inputs = list(columns or forest.features)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[out] = _scores(pdf[inputs].to_numpy(dtype=float), forest)
            yield pdf

    return df.mapInPandas(run, schema)


def isolation_forest_fit(
    df: DataFrame, features: Sequence[str], *, key: str, trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42
) -> IsolationForest:
    """Fit on rows without NULLs.

    Rows are drawn by the hash of ``key``: a hash cut that leaves a little more than is needed, then an
    exact draw among those, so the draw never depends on partitioning and never sorts the table. Each
    tree is grown in its own small group; the finished trees (at most 2 * ``sample`` nodes each) are
    the only thing brought to the driver.
    """
    features = list(features)
    clean = written(df.dropna(subset=features).select(key, *features), "complete")  # read three times
    stats = clean.agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]
    ).first()
    n = stats["n"]
    if not n:
        raise ValueError("no complete rows to fit on")
    center = np.array([stats[f"m_{c}"] for c in features])
    scale = np.array([stats[f"s_{c}"] or 1.0 for c in features])
    per_tree = int(min(sample, n))
    need = trees * per_tree
    copies = max(1, -(-need // n))  # a small table is drawn from again under other hashes
    hashed = clean.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(copies)))).alias("_c"))
    hashed = hashed.withColumn("_h", F.xxhash64(F.col(key), F.col("_c"), F.lit(seed)))
    share = min(1.0, 1.3 * need / (n * copies) + 100.0 / (n * copies))
    drawn = hashed.where(F.pmod("_h", F.lit(1_000_000_007)) < int(share * 1_000_000_007))
    # a copy of the table fills whole trees before the next one starts, so no row comes twice in a tree
    whole = max(1, n // per_tree) * per_tree if copies > 1 else need
    picked = drawn.orderBy("_c", "_h", key).limit(need + copies * per_tree) if copies > 1 else drawn.orderBy("_h", key).limit(need)
    in_copy = F.row_number().over(Window.partitionBy("_c").orderBy("_h", key)) - 1  # at most trees * sample rows in all
    placed = picked.withColumn("_p", in_copy).where(F.col("_p") < whole).withColumn("rank", (F.col("_c") - 1) * whole + F.col("_p"))
    grouped = placed.where(F.col("rank") < need).withColumn("tree", F.floor(F.col("rank") / per_tree).cast("int"))
    scaled = grouped.select(
        "tree", "rank", *[((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, m, s in zip(features, center, scale)]
    )
    grown = scaled.groupBy("tree").applyInPandas(_grow(features, seed, per_tree), TREE).orderBy("tree").collect()
    arrays = [
        (np.array(r["feature"]), np.array(r["cut"]), np.array(r["left"]), np.array(r["right"]), np.array(r["depth"])) for r in grown
    ]
    forest = IsolationForest(features, arrays, center, scale, per_tree)
    scores = written(score_samples(clean, forest).select("score_sample"), "isolation")
    forest.offset = exact_percentile(scores, "score_sample", contamination)
    return forest


def isolation_forest_score(df: DataFrame, forest: IsolationForest) -> DataFrame:
    """Score, decision value and flag (decision below 0) of every complete row."""
    out = score_samples(df.dropna(subset=forest.features), forest)
    out = out.withColumn("decision", F.col("score_sample") - F.lit(forest.offset))
    return out.withColumn("flag", F.col("decision") < 0)


def isolation_score_scaled(
    df: DataFrame, forest: IsolationForest | None, *, keys: Sequence[str] = ("name",), value: str = "value", sigma: float = 2.5, min_points: int = 5
) -> DataFrame:
    """Rows whose scaled decision exceeds ``sigma``, per series of at least ``min_points``.

    The value is used for every model input. Without a model the score is the distance from the mean in
    population deviations (0.001 at least).
    """
    df = df.withColumn(value, finite(value))
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.avg(value).alias("expected"), F.greatest(F.stddev_pop(value), F.lit(0.001)).alias("_std")
    ).where(F.col("_n") >= min_points)
    rows = join_small(df.where(F.col(value).isNotNull()), stats, keys)
    if forest is None:
        scored = rows.withColumn("score", F.abs(F.col(value) - F.col("expected")) / F.col("_std"))
    else:
        scored = score_samples(rows, forest, [value] * len(forest.features)).withColumn(
            "score", F.greatest(F.lit(0.0), (F.lit(forest.offset) - F.col("score_sample")) * 5)
        ).drop("score_sample")
    return scored.where(F.col("score") > sigma).drop("_n", "_std")
